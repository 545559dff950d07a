"""Quality rules as a learned decision list. DataFrame functions only.

Every document is reduced to counts (words, symbols, repeated lines and windows, capitals, ...). From the
counts of labelled documents, sequential covering learns an ordered list of rules: a rule is a conjunction
of thresholds, grown condition by condition on two thirds of the labelled rows by information gain, pruned
on the last third, and the rows it covers are set aside before the next rule is learned. The list is
applied as one ordered ``CASE WHEN`` expression.

All labelled rows teach: a growing step is one aggregation that counts labelled rows by feature, bin and
class, so what reaches the driver is bounded by features x bins x classes.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, fold, texts
from eventloom.session import cut_lineage

SPACE, WINDOW = r"[\x20\x09-\x0D]+", 8
#: Counts of a document that the contract names, and those that only the rules read.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_runs", "n_upper", "n_digits", "n_marks", "n_loud", "longest"]
#: The features of a rule: numerator over denominator.
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "runs": ("n_runs", "n_words"), "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"), "loud": ("n_loud", "n_words"),
    "line_words": ("n_words", "n_lines"), "longest": ("longest", None), "words": ("n_words", None),
}


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matching(text: Column, cls: str) -> Column:
    """Number of characters of ``text`` in a character class."""
    return F.char_length(F.regexp_replace(text, f"[^{cls}]+", F.lit(""))).cast("long")


def twins(sorted_rows: Column) -> Column:
    """The elements (h, i) of an array sorted by h whose h another element has too."""
    return bound(sorted_rows, lambda s: F.filter(s, lambda x, at: F.coalesce(x["h"] == F.get(s, at - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, at + 1)["h"], F.lit(False))))


def repeated_words(words: Column) -> Column:
    """Words of an array inside windows of WINDOW words that occur twice or more.

    Different hashes prove windows different; only windows whose hash occurs twice are compared as text.
    """
    def window(at: Column) -> Column:
        return F.slice(words, at, F.lit(WINDOW))

    def covered(hashes: Column) -> Column:
        hashed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = F.sort_array(F.transform(twins(hashed), lambda x: F.struct(F.array_join(window(x["i"] + 1), " ").alias("h"), x["i"].alias("i"))))
        at = F.sort_array(F.transform(twins(same), lambda x: x["i"].cast("long")))
        start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(WINDOW).cast("long"))).alias("n")), lambda a: a["n"])

    def of_windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = bound(F.transform(words, lambda w: F.xxhash64(w)), of_windows)
    found = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0).cast("long"))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a row number and the counts of every whole text; a null text counts as empty."""
    text = F.col("text")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = bound(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False)))).cast("long").alias("n_runs"), repeated_words(w).alias("n_repeat_words"),
        F.coalesce(F.array_max(F.transform(w, F.char_length)), F.lit(0)).cast("long").alias("longest"),
    ))
    of_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return texts(docs, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias(ROW), of_words.alias("w"), of_lines.alias("l"), matching(text, r"#*$%&|<>").alias("n_symbols"),
        matching(text, "A-Z").alias("n_upper"), matching(text, "0-9").alias("n_digits"), matching(text, ".,;:!?").alias("n_marks"), matching(text, "!?").alias("n_loud"),
    ).select("doc_id", ROW, "w.*", "l.*", "n_symbols", "n_upper", "n_digits", "n_marks", "n_loud")


def feature(name: str) -> Column:
    top, under = RATIOS[name]
    return F.col(top).cast("double") if under is None else F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(under)), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    """``feature >= cut``, or ``feature < cut``; the bin form counts the cuts at or below a value."""

    name: str
    at_least: bool
    bin: int
    cut: float

    def on_bins(self) -> Column:
        return F.col(self.name) >= self.bin if self.at_least else F.col(self.name) < self.bin

    def on_counts(self) -> Column:
        return feature(self.name) >= self.cut if self.at_least else feature(self.name) < self.cut


@dataclass(frozen=True)
class Rule:
    """Rows that meet every condition are of class ``verdict``; ``precision`` is measured on the pruning rows."""

    conditions: tuple[Condition, ...]
    verdict: int
    precision: float

    def text(self) -> str:
        return " AND ".join(f"{c.name} {'>=' if c.at_least else '<'} {c.cut:g}" for c in self.conditions)


def all_of(conditions) -> Column:
    test = F.lit(True)
    for c in conditions:
        test = test & c
    return test


def cut_points(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Quantiles of every feature among the rows of either class, as thresholds."""
    steps = [k / bins for k in range(bins + 1)]
    found = rows.groupBy("cls").agg(*[F.percentile_approx(feature(f), F.lit(steps), F.lit(20 * bins)).alias(f) for f in RATIOS]).collect()
    return {f: sorted({v for r in found for v in r[f]}) for f in RATIOS}


def bin_counts(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(rows of class 0, other rows) of every feature and bin."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in RATIOS])).alias("x")
    counted = rows.select(pairs, "cls").groupBy("x.f", "x.b").agg(F.count_if(F.col("cls") == 0), F.count_if(F.col("cls") != 0))
    return {(r[0], r[1]): (r[2], r[3]) for r in counted.collect()}


def best_condition(counts: dict[tuple[str, int], tuple[int, int]], cuts: dict[str, list[float]]) -> tuple[float, Condition] | None:
    """The condition of the highest information gain for class 0; ties go to the first feature and cut."""
    best = None
    for name, at in cuts.items():
        cells = [counts.get((name, b), (0, 0)) for b in range(len(at) + 1)]
        poor, other = sum(c[0] for c in cells), sum(c[1] for c in cells)
        if not poor or not other:
            return None
        now, low_p, low_n = log2(poor / (poor + other)), 0, 0
        for b in range(1, len(at) + 1):
            low_p, low_n = low_p + cells[b - 1][0], low_n + cells[b - 1][1]
            for at_least, p, n in ((True, poor - low_p, other - low_n), (False, low_p, low_n)):
                if p and p + n < poor + other:
                    gain = p * (log2(p / (p + n)) - now)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Condition(name, at_least, b, at[b - 1]))
    return best


def learn_rules(rows: DataFrame, bins: int = 32, most_rules: int = 16, most_conditions: int = 4, least_precision: float = 0.9, least_rows: int = 3) -> list[Rule]:
    """An ordered list of rules for class 0 from rows with the counts, cls (0 or 1) and ``doc_id``.

    Learning stops when a pruned rule finds fewer than ``least_rows`` rows of class 0, or is right less
    often than ``least_precision``, on the rows kept for pruning. No rows, or rows of one class, give no rules.
    """
    cuts = cut_points(rows, bins)
    if not cuts["words"]:
        return []

    def bin_of(f: str) -> Column:
        value = feature(f)
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: value >= c)).alias(f)

    left = cut_lineage(rows.select(*[bin_of(f) for f in RATIOS], "cls", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prunes")))
    learned: list[Rule] = []
    while len(learned) < most_rules:
        conditions: list[Condition] = []
        growing = left.filter(~F.col("prunes"))
        while len(conditions) < most_conditions:
            found = best_condition(bin_counts(growing.filter(all_of([c.on_bins() for c in conditions]))), cuts)
            if found is None or found[0] <= 0:
                break
            conditions.append(found[1])
        if not conditions:
            break
        prefixes = [all_of([c.on_bins() for c in conditions[:k + 1]]) for k in range(len(conditions))]
        tally = left.filter("prunes").agg(*[F.count_if(p & (F.col("cls") == y)) for p in prefixes for y in (0, 1)]).first()
        worth = [(tally[2 * k], tally[2 * k + 1]) for k in range(len(conditions))]
        best = max(range(len(conditions)), key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), worth[k][0], -k))
        p, n = worth[best]
        if p < least_rows or p < least_precision * (p + n):
            break
        learned.append(Rule(tuple(conditions[:best + 1]), 0, p / (p + n)))
        left = left.filter(~prefixes[best])
    return learned


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def decision(rules: list[Rule]) -> tuple[Column, Column]:
    """The verdict (1 keeps) and the number of the rule that gave it, as ordered conditional expressions."""
    verdict, number = None, None
    for k, rule in enumerate(rules, start=1):
        test = all_of([c.on_counts() for c in rule.conditions])
        verdict = F.when(test, rule.verdict) if verdict is None else verdict.when(test, rule.verdict)
        number = F.when(test, k) if number is None else number.when(test, k)
    return (F.lit(1), F.lit(0)) if verdict is None else (verdict.otherwise(1), number.otherwise(0))


def labelled_counts(counts: DataFrame, labels: DataFrame, folds: int, id_col: str, label_col: str) -> DataFrame:
    """The counts of labelled documents outside the held-out fold, with cls; conflicting labels of a document count both."""
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("cls"))
        .filter(F.col("doc_id").isNotNull() & F.col("cls").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0)).distinct()
    )
    return counts.join(known, "doc_id")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, **learning) -> tuple[DataFrame, list[Rule]]:
    """The counts of every document with base_failed, rule and kept, and the rules.

    A document is kept when it passes the base rule (20 words, at most 30 % of them in repeated windows)
    and the learned list does not reject it; ``rule`` is the number of the rule that spoke, 0 for none.
    Labels of the documents with crc32(doc_id as text) mod ``folds`` = 0 are held out. Null and empty texts
    fail the base rule; repeated rows are judged alike; other columns never clash; an empty table gives
    no rows, and without labels there are no rules.
    """
    counts = cut_lineage(document_counts(docs, id_col, text_col))
    rules = learn_rules(labelled_counts(counts, labels, folds, id_col, label_col), **learning)
    verdict, number = decision(rules)
    judged = counts.withColumn("base_failed", base_failed()).withColumn("rule", number.cast("int")).withColumn("kept", ~F.col("base_failed") & (verdict == 1))
    return judged, rules
