"""Personal data by weak supervision. DataFrame functions only.

Regular expressions propose spans; labelers (form, gazetteer, context, boundary) vote on each span with
1, -1 or 0 (no opinion). Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is; its posteriors are the soft labels of a logistic span classifier, which is
applied as a column expression. Both are fitted on one row per pattern, at most a few thousand, counted
over the whole corpus.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import ROW, texts
from eventloom.session import cut_lineage

#: Base kinds in the order of the output. The possessive and look-behind forms match what the plain
#: patterns match, without their backtracking on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that only the classifier accepts.
ADDED = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "idnum": r"(?<![A-Za-z0-9+.-])(?:[0-9]{9}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])",
}
KINDS = {**BASE, **ADDED}
#: A text without this character has no match of the kind.
NEEDS = {"email": "@", "phone": "+"}
LABELERS = ["form", "gazetteer", "context", "boundary"]
BEFORE, AFTER = 32, 8

# Cue words, domains and prefixes of the labelers.
CUES = {
    "email": "mail|contact|write|reply|schreib|escrib|courriel|correo",
    "ip": "ip|host|server|addr|login|client",
    "card": "card|visa|credit|karte|carte|tarjeta|iban|pay",
    "phone": "phone|tel|call|fax|mobile|anruf|appel|llam",
    "secret": "token|key|secret|password|passwd|auth|bearer|credential",
    "idnum": "ssn|social|passport|license|tax|ident|nummer|numero",
}
AGAINST = "version|release|page|figure|isbn|price|chapter|sha256|commit"
DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|example|test|local"


def proposals(docs: DataFrame) -> DataFrame:
    """(doc_id, row, kind, k, match, gap, before, after): every match of every kind; a text without any gives one row of nulls.

    ``split`` with the same pattern gives the pieces between matches, so a running sum of lengths gives
    every position without a second search.
    """
    own = docs.withColumn(ROW, F.monotonically_increasing_id())
    for kind, pattern in KINDS.items():
        may = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
        own = own.withColumn(f"m_{kind}", F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    for kind, pattern in KINDS.items():
        own = own.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)))
    found = [spans_of(kind) for kind in KINDS]
    return own.select("doc_id", ROW, F.explode_outer(F.concat(*found)).alias("s")).select("doc_id", ROW, "s.*")


def spans_of(kind: str) -> Column:
    """The matches of one kind, each with the piece before it and the start of the piece after it."""
    m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    parts = F.zip_with(m, F.zip_with(F.slice(p, F.lit(1), F.size(m)), F.slice(p, F.lit(2), F.size(m)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
                       lambda a, b: F.struct(a.alias("m"), b["x"].alias("x"), b["y"].alias("y")))

    def span(z: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("k"), z["m"].alias("match"), F.char_length(z["x"]).alias("gap"),
            F.lower(F.right(z["x"], F.lit(BEFORE))).alias("before"), F.left(z["y"], F.lit(AFTER)).alias("after"),
        )

    none = F.array().cast("array<struct<kind:string,k:int,match:string,gap:int,before:string,after:string>>")
    return F.coalesce(F.when(F.size(m) > 0, F.transform(parts, span)), none)


def placed(found: DataFrame) -> DataFrame:
    """Start and end of every proposal in code points."""
    from pyspark.sql.window import Window

    so_far = Window.partitionBy(ROW, "kind").orderBy("k")
    size = F.char_length("match")
    end = F.sum(F.col("gap") + size).over(so_far)
    return found.withColumn("end", end).withColumn("start", F.col("end") - size)


def luhn(digits: Column) -> Column:
    """Luhn check of up to 19 digits."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def base_ok() -> Column:
    """Whether a match of a base kind passes the kind's own check."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.char_length(digits)
    part_ok = F.forall(F.split("match", r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", part_ok)
        .when(F.col("kind") == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15)).otherwise(F.lit(False))
    )


def by_kind(values: dict[str, Column]) -> Column:
    out = None
    for kind, value in values.items():
        out = F.when(F.col("kind") == kind, value) if out is None else out.when(F.col("kind") == kind, value)
    return out.otherwise(F.lit(0))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def voted(spans: DataFrame) -> DataFrame:
    """Votes and coarse features of every proposal."""
    m = F.col("match")
    never, digits, letters = F.lit(False), m.rlike("[0-9]"), m.rlike("[A-Za-z]")
    first_group = F.substring(m, 1, 3)
    form = by_kind({
        "email": vote(m.rlike(r"\.[A-Za-z]{2,}$"), m.rlike(r"\.\.|^\.")), "ip": vote(F.col("base"), ~F.col("base")), "card": vote(F.col("base"), ~F.col("base")),
        "phone": vote(F.col("base"), ~F.col("base")), "secret": vote(digits & letters, ~digits), "idnum": vote(m.contains("-"), never),
    })
    gazetteer = by_kind({
        "email": vote(m.rlike(rf"(?i)\.(?:{DOMAINS})$"), never), "ip": vote(~m.rlike(r"^0"), m.rlike(r"^0\.|^255\.")), "card": vote(m.rlike(r"^[3-6]"), m.rlike(r"^0")),
        "phone": vote(m.rlike(r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[1-6]|9[0-8])"), m.rlike(r"^\+0")),
        "secret": vote(m.rlike(r"^[0-9a-f]+$|^(?:sk|pk|ghp|AKIA|xox)"), m.rlike(r"^[A-Z]?[a-z]+$")), "idnum": vote(~first_group.isin("000", "666") & ~m.startswith("9"), first_group.isin("000", "666")),
    })
    near = F.col("before")
    context = vote(by_kind({k: F.when(near.rlike(rf"\b(?:{c})[a-z]*\b"), 1).otherwise(0) for k, c in CUES.items()}) == 1, near.rlike(rf"\b(?:{AGAINST})\b"))
    inside = near.rlike(r"[a-z0-9]$") | F.col("after").rlike(r"^[A-Za-z0-9]")
    n = F.char_length(m)
    return (
        spans.withColumn("form", form).withColumn("gazetteer", gazetteer).withColumn("context", context).withColumn("boundary", vote(~inside, inside))
        .withColumn("long", F.when(n < 12, 0).when(n < 24, 1).otherwise(2))
    )


def reliabilities(patterns: list[tuple], rounds: int = 100) -> list[float]:
    """Posterior that each (kind, votes..., n) pattern is personal data, by expectation-maximisation.

    Two latent classes with a prior for each kind; each labeler has, for each class, the chances of its
    three answers. Counts are smoothed, and the start trusts every labeler a little.
    """
    total = sum(p[-1] for p in patterns) or 1
    chance = [{(y, v): 1 / 3 + (0.2 if v == y else -0.2 if v == -y else 0.0) for y in (1, -1) for v in (1, 0, -1)} for _ in LABELERS]
    prior = {p[0]: 0.5 for p in patterns}
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        last = posterior
        posterior = []
        for kind, *votes, _n in patterns:
            z = log(prior[kind] / (1 - prior[kind])) + sum(log(c[1, v] / c[-1, v]) for c, v in zip(chance, votes))
            posterior.append(1 / (1 + exp(-max(-40.0, min(40.0, z)))))
        for kind in prior:
            own = [(q, p[-1]) for q, p in zip(posterior, patterns) if p[0] == kind]
            prior[kind] = (sum(q * n for q, n in own) + 1) / (sum(n for _, n in own) + 2)
        for j, c in enumerate(chance):
            for y in (1, -1):
                mass = {v: 0.01 * total * (2 if v == y else 1) for v in (1, 0, -1)}
                for q, p in zip(posterior, patterns):
                    mass[p[1 + j]] += p[-1] * (q if y == 1 else 1 - q)
                for v in mass:
                    c[y, v] = mass[v] / sum(mass.values())
        if max((abs(a - b) for a, b in zip(posterior, last)), default=0) < 1e-6:
            break
    return posterior


def span_classifier(rows: list[tuple], posterior: dict[tuple, float], steps: int = 200, rate: float = 1.0) -> dict[str, float]:
    """Logistic weights over kind, kind and vote, and length class, from soft labels weighted by counts."""
    data = [(features(r), posterior[r[:1 + len(LABELERS)]], r[-1]) for r in rows]
    total = sum(n for _, _, n in data) or 1
    weights: dict[str, float] = {}
    for _ in range(steps):
        gradient: dict[str, float] = {}
        for names, q, n in data:
            z = sum(weights.get(f, 0.0) for f in names)
            d = (1 / (1 + exp(-max(-40.0, min(40.0, z)))) - q) * n / total
            for f in names:
                gradient[f] = gradient.get(f, 0.0) + d
        seen: dict[str, float] = {}
        for names, _, n in data:
            for f in names:
                seen[f] = seen.get(f, 0.0) + n / total
        for f, g in gradient.items():
            weights[f] = weights.get(f, 0.0) - rate * g / (seen[f] + 1e-9)
    return weights


def features(row: tuple) -> list[str]:
    kind, votes, size = row[0], row[1:1 + len(LABELERS)], row[1 + len(LABELERS)]
    return [f"{kind}", *[f"{kind} {name} {v}" for name, v in zip(LABELERS, votes)], f"{kind} long {size}"]


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal-data spans of every whole text: doc_id, spans (array of kind, start, end, base, p).

    Base spans are the matches of the four base patterns that pass their check; they always stay.
    Added spans (secrets, identity numbers) stay where the classifier gives ``threshold`` or more. Null
    and empty texts have no spans; repeated rows have their own; an empty table gives no rows.
    """
    found = cut_lineage(voted(placed(proposals(texts(docs, id_col, text_col))).withColumn("base", base_ok())).drop("match", "gap", "before", "after", "k"))
    keys = ["kind", *LABELERS]
    # at most kinds x 3^labelers x length classes rows
    rows = sorted(tuple(r) for r in found.filter(F.col("kind").isNotNull()).groupBy(*keys, "long").count().collect())
    merged: dict[tuple, int] = {}
    for r in rows:
        merged[r[:len(keys)]] = merged.get(r[:len(keys)], 0) + r[-1]
    patterns = [(*k, n) for k, n in sorted(merged.items())]
    posterior = dict(zip([p[:-1] for p in patterns], reliabilities(patterns)))
    weights = span_classifier(rows, posterior)
    z = F.lit(0.0)
    for name, weight in sorted(weights.items()):
        kind, *more = name.split(" ")
        test = F.col("kind") == kind
        if more:
            test = test & (F.col(more[0]) == int(more[1]))
        z = z + F.when(test, F.lit(weight)).otherwise(0.0)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    kept = F.col("base") | (F.col("kind").isin(*ADDED) & (F.col("p") >= threshold))
    span = F.struct(order[F.col("kind")].alias("at"), "start", "end", "kind", "base", "p")
    return (
        found.withColumn("p", 1 / (1 + F.exp(-z))).groupBy("doc_id", ROW)
        .agg(F.array_sort(F.collect_list(F.when(kept, span))).alias("spans"))
    )


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def same(kind: str):
        return lambda s: s["kind"] == kind

    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, same(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
