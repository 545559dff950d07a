"""Candidate sweeps and lookup learning.

Sweeps never emit (record, spec) rows: every Arrow batch reduces to one partial-sum row per
(spec, target, entity), so the shuffle carries specs, not records. Learning works on
(spec, value, label) counts for the same reason.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import ordered as o

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "exact", "floor_hits", "round_hits", "abs_err", "valid")
#: Sums that a task holds before it emits them.
HELD = 4_000_000


@dataclass(frozen=True)
class Field:
    """One reading of a record: ``width`` bytes every ``stride`` from ``offset``, or bits."""

    spec: int
    offset: int
    kind: str  # "u" unsigned, "f" float32, "bits"
    width: int  # bytes, or bits
    little: bool = True
    stride: int = 1
    from_end: bool = False

    def read(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Values as float64; NaN where the record is too short."""
        if self.kind == "bits":
            byte, inner = divmod(self.offset, 8)
            raw, ok = self._word(data, size, byte, -(-(inner + self.width) // 8), 1)
            total = 8 * -(-(inner + self.width) // 8)
            shift = inner if self.little else total - inner - self.width
            return np.where(ok, ((raw >> shift) & ((1 << self.width) - 1)).astype(np.float64), np.nan)
        raw, ok = self._word(data, size, self.offset, self.width, self.stride)
        value = raw.astype(np.uint32).view(np.float32) if self.kind == "f" else raw
        return np.where(ok, value.astype(np.float64), np.nan)

    def _word(self, data, size, first, width, stride):
        base = size - first - ((width - 1) * stride + 1) if self.from_end else np.full(len(data), first)
        at = base[:, None] + stride * np.arange(width)[None, :]
        ok = ((at >= 0) & (at < size[:, None])).all(axis=1)
        if not ok.any():
            return np.zeros(len(data), np.int64), ok
        cells = np.take_along_axis(data, np.where(ok[:, None], at, 0), axis=1).astype(np.int64)
        places = np.arange(width) if self.little else np.arange(width)[::-1]
        return (cells << (8 * places)[None, :]).sum(axis=1), ok


def moments(df: DataFrame, entity: Sequence[str], arr: str, targets: Sequence[str], fields: Sequence[Field], center: Mapping[str, float] | None = None) -> DataFrame:
    """Mergeable sums per (spec, target, entity).

    Raw values are centred on the middle of their range and targets on ``center`` before
    squaring, which keeps the sums accurate for large means; hits compare uncentred values. A task
    adds up its batches and emits one row per (entity, spec, target), or earlier at ``HELD`` sums.
    """
    entity, targets, fields = list(entity), list(targets), list(fields)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"`{e}` {kinds[e]}" for e in entity)
    ddl += (", " if ddl else "") + "spec int, target string, cx double, " + ", ".join(f"{c} double" for c in SUMS)
    mids = {t: float((center or {}).get(t, 0.0)) for t in targets}

    middle = {"u": lambda f: 2.0 ** (8 * f.width - 1), "bits": lambda f: 2.0 ** (f.width - 1), "f": lambda f: 0.0}
    index = [(f.spec, t, middle[f.kind](f)) for f in fields for t in targets]

    def emit(held: dict) -> Iterator[pd.DataFrame]:
        for key, total in held.items():
            frame = pd.DataFrame(index, columns=["spec", "target", "cx"])
            for name, column in zip(SUMS, total.T):
                frame[name] = column
            for name, value in zip(entity, key):
                frame.insert(0, name, value)
            yield frame[[*entity, "spec", "target", "cx", *SUMS]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            groups = pdf.groupby(entity, sort=False, dropna=False) if entity else [((), pdf)]
            for key, part in groups:
                size = part[arr].map(len).to_numpy()
                data = np.zeros((len(part), int(size.max()) if len(part) else 0), dtype=np.uint8)
                for i, row in enumerate(part[arr]):
                    data[i, : size[i]] = np.asarray(row, dtype=np.int64)
                ys = {t: part[t].to_numpy(dtype=np.float64, na_value=np.nan) for t in targets}
                out = []
                for f in fields:
                    x, cx = f.read(data, size), middle[f.kind](f)
                    for t in targets:
                        y = ys[t]
                        ok = np.isfinite(x) & np.isfinite(y)
                        a, b = x[ok], y[ok]
                        u, v = a - cx, b - mids[t]
                        out.append(
                            (len(a), u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum(),
                             (a == b).sum(), (np.floor(a) == np.floor(b)).sum(), (np.floor(a + 0.5) == np.floor(b + 0.5)).sum(),
                             np.abs(a - b).sum(), ok.sum() / max(len(ok), 1) * len(ok))
                        )
                key = tuple(None if pd.isna(v) else v for v in (key if isinstance(key, tuple) else (key,)))
                held[key] = held.get(key, 0.0) + np.array(out, dtype=np.float64).reshape(len(index), len(SUMS))
            if len(held) * len(index) * len(SUMS) > HELD:
                yield from emit(held)
                held = {}
        yield from emit(held)

    partial = df.select(*dict.fromkeys([*entity, arr, *targets])).mapInPandas(run, ddl)
    return partial.groupBy(*entity, "spec", "target", "cx").agg(*[F.sum(c).alias(c) for c in SUMS])


def field_scores(sums: DataFrame, entity: Sequence[str], rows: int | None = None) -> DataFrame:
    """Per (spec, target): global and within-entity correlation, fit error and the mixed score.

    Score .68*|within| + .32*|global|; constant specs and specs with unreadable records drop out.
    """
    c = F.col
    sums = sums.withColumns(
        {
            "_wxy": c("sxy") - c("sx") * c("sy") / c("n"), "_wxx": c("sxx") - c("sx") * c("sx") / c("n"),
            "_wyy": c("syy") - c("sy") * c("sy") / c("n"),
        }
    )
    t = sums.groupBy("spec", "target").agg(
        *[F.sum(x).alias(x) for x in (*SUMS, "_wxy", "_wxx", "_wyy")], F.max("cx").alias("cx")
    )
    gxy = c("sxy") - c("sx") * c("sy") / c("n")
    gxx = c("sxx") - c("sx") * c("sx") / c("n")
    gyy = c("syy") - c("sy") * c("sy") / c("n")
    zero = F.lit(0.0)

    def corr(xy, xx, yy):
        return F.when((c("n") < 3) | (xx <= 1e-9) | (yy <= 1e-9), zero).otherwise(xy / F.sqrt(xx * yy))

    out = t.withColumns(
        {
            "global_r": corr(gxy, gxx, gyy), "within_r": corr(c("_wxy"), c("_wxx"), c("_wyy")), "spread": gxx,
            "slope": F.when(gxx > 1e-9, gxy / gxx).otherwise(zero),
            "rmse": F.sqrt(F.greatest(zero, gyy - F.coalesce(F.try_divide(gxy * gxy, gxx), zero)) / c("n")),
            "sd": F.sqrt(gyy / c("n")), "mae": c("abs_err") / c("n"),
        }
    )
    out = out.filter(c("spread") > 1e-9)
    if rows is not None:
        out = out.filter(c("valid") == rows)
    return out.withColumn("score", 0.68 * F.abs("within_r") + 0.32 * F.abs("global_r"))


def transform_errors(sums: DataFrame, transforms: Sequence[tuple[str, float, float]], center: Mapping[str, float] | None = None) -> DataFrame:
    """RMSE of scale*raw+offset for each fixed transform, from the sums alone; best per spec and target."""
    c = F.col
    cy = F.lit(0.0)
    for t, m in (center or {}).items():
        cy = F.when(c("target") == t, F.lit(float(m))).otherwise(cy)
    tot = sums.groupBy("spec", "target").agg(*[F.sum(x).alias(x) for x in SUMS], F.max("cx").alias("cx"))
    dim = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("scale"), F.lit(b).alias("shift")) for i, a, b in transforms])
    tot = tot.withColumn("_t", F.explode(dim)).select("*", "_t.*")
    # residual scale*(u+cx)+shift-(v+cy) = scale*u - v + k
    k = c("scale") * c("cx") + c("shift") - cy
    sse = (
        c("scale") * c("scale") * c("sxx") + c("syy") - 2 * c("scale") * c("sxy")
        + 2 * k * (c("scale") * c("sx") - c("sy")) + k * k * c("n")
    )
    tot = tot.withColumn("rmse", F.sqrt(F.greatest(F.lit(0.0), sse / c("n"))))
    return o.best(tot, ["spec", "target"], [F.asc("rmse"), F.asc("id")]).select("spec", "target", "n", F.col("id").alias("transform"), "scale", "shift", "rmse")


def smallest_values(df: DataFrame, arr: str, fields: Sequence[Field], keep: int) -> DataFrame:
    """Number of distinct values per spec, counted up to ``keep``.

    The ``keep`` smallest values of all records are among the ``keep`` smallest of each task.
    """
    fields = list(fields)

    def run(batches):
        least = {f.spec: np.zeros(0) for f in fields}
        for pdf in batches:
            size = pdf[arr].map(len).to_numpy()
            data = np.zeros((len(pdf), int(size.max()) if len(pdf) else 0), dtype=np.uint8)
            for i, row in enumerate(pdf[arr]):
                data[i, : size[i]] = np.asarray(row, dtype=np.int64)
            for f in fields:
                x = f.read(data, size)
                least[f.spec] = np.unique(np.concatenate([least[f.spec], x[np.isfinite(x)]]))[:keep]
        yield pd.DataFrame([(spec, v) for spec, values in least.items() for v in values], columns=["spec", "v"])

    vals = df.select(arr).mapInPandas(run, "spec int, v double").distinct()
    return o.top_k(vals, ["spec"], [F.asc("v")], keep).groupBy("spec").agg(F.count("*").alias("distinct_values"))


def pair_moments(df: DataFrame, keys: Sequence[str], arr: str) -> DataFrame:
    """Correlation of every pair of record fields, from per-batch Gram matrices.

    A batch emits one row per (key, pair) instead of one row per (record, pair).
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"

    def run(batches):
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in part[arr]]) - 128.0
                gram, tot = x.T @ x, x.sum(axis=0)
                a, b = np.triu_indices(x.shape[1], k=1)
                frame = pd.DataFrame(
                    {"a": a, "b": b, "n": float(len(x)), "sa": tot[a], "sb": tot[b], "saa": gram[a, a], "sbb": gram[b, b], "sab": gram[a, b]}
                )
                for i, (name, value) in enumerate(zip(keys, key)):
                    frame.insert(i, name, value)
                yield frame

    sums = ("n", "sa", "sb", "saa", "sbb", "sab")
    tot = df.select(*keys, arr).mapInPandas(run, ddl).groupBy(*keys, "a", "b").agg(*[F.sum(c).alias(c) for c in sums])
    c = F.col
    xx, yy = c("saa") - c("sa") * c("sa") / c("n"), c("sbb") - c("sb") * c("sb") / c("n")
    r = (c("sab") - c("sa") * c("sb") / c("n")) / F.sqrt(xx * yy)
    return tot.select(*keys, "a", "b", c("n").cast("long").alias("n"), F.when((c("n") < 3) | (xx <= 1e-9) | (yy <= 1e-9), 0.0).otherwise(r).alias("correlation"))


def learn_lookup(train: DataFrame, spec: Sequence[str], key: str, label: str, strict: bool = True) -> DataFrame:
    """Lookup per spec: conflict-free keys only, or the majority label with string-order ties."""
    counts = train.groupBy(*spec, key, label).agg(F.count("*").alias("n"))
    per = counts.groupBy(*spec, key).agg(
        F.count("*").alias("labels"), F.min_by(label, F.struct(-F.col("n"), F.col(label).cast("string"))).alias("predicted"), F.sum("n").alias("support")
    )
    return per.filter("labels = 1") if strict else per


def score_lookup(test: DataFrame, lookup: DataFrame, spec: Sequence[str], key: str, label: str) -> DataFrame:
    """exact / wrong / unavailable per spec."""
    out = test.join(lookup.select(*spec, key, "predicted"), [*spec, key], "left")
    hit = F.col("predicted").eqNullSafe(F.col(label))
    return out.groupBy(*spec).agg(
        F.count("*").alias("rows"), F.count_if(hit).alias("exact"), F.count_if(F.col("predicted").isNotNull() & ~hit).alias("wrong"),
        F.count_if(F.col("predicted").isNull()).alias("unavailable"),
    )


def xor_linkage(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Most frequent XOR between two fields and its share."""
    x = F.col(a).bitwiseXOR(F.col(b)).alias("xor")
    n = df.groupBy(*keys, x).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(
        F.min_by("xor", F.struct(-F.col("n"), F.col("xor"))).alias("constant"), F.max("n").alias("support"), F.sum("n").alias("rows")
    ).withColumn("rate", F.col("support") / F.col("rows"))


def mask_models(counts: DataFrame, keys: Sequence[str], value: str, label: str, n: str) -> DataFrame:
    """XOR-of-bits models: accuracy of parity(value & mask) (or its inverse) for a 0/1 label.

    Works on (value, label) counts, so 255 masks multiply at most 512 rows per spec.
    """
    masks = F.sequence(F.lit(1), F.lit(255))
    rows = counts.withColumn("mask", F.explode(masks))
    bit = F.pmod(F.bit_count(F.col(value).bitwiseAND(F.col("mask").cast("long"))), F.lit(2))
    out = rows.groupBy(*keys, "mask").agg(
        F.sum(F.when(bit == F.col(label), F.col(n)).otherwise(0)).alias("same"), F.sum(n).alias("rows")
    )
    return out.withColumns(
        {"accuracy": F.greatest("same", F.col("rows") - F.col("same")) / F.col("rows"), "inverted": F.col("same") * 2 < F.col("rows")}
    )


def mask_classifier(counts: DataFrame, keys: Sequence[str], value: str, positive: str, negative: str) -> DataFrame:
    """Accepted masked values are those of the positives; the mask with the fewest false positives wins."""
    rows = counts.withColumn("mask", F.explode(F.sequence(F.lit(1), F.lit(255))))
    masked = F.col(value).bitwiseAND(F.col("mask").cast("long"))
    per = rows.groupBy(*keys, "mask", masked.alias("code")).agg(F.sum(positive).alias("p"), F.sum(negative).alias("q"))
    out = per.groupBy(*keys, "mask").agg(
        F.count_if(F.col("p") > 0).alias("accepted"), F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("q"))), F.lit(0)).alias("false_positives"), F.sum("p").alias("positives")
    )
    return o.best(out, keys, [F.asc("false_positives"), F.asc("accepted"), F.asc("mask")])


def subset_masks(handles: DataFrame, mask: str, label: str, bits: int) -> DataFrame:
    """Token-subset classifiers: handles holding every token of a mask, scored per mask.

    Handles collapse to (mask, label) counts before meeting the 2^k masks.
    """
    counts = handles.groupBy(mask, label).agg(F.count("*").alias("n"))
    rows = counts.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.lit((1 << bits) - 1).cast("long"))))
    hit = F.col(mask).bitwiseAND(F.col("m")) == F.col("m")
    total = F.sum(F.when(F.col(label), F.col("n")).otherwise(0))
    return rows.groupBy("m").agg(
        F.sum(F.when(hit & F.col(label), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(hit & ~F.col(label), F.col("n")).otherwise(0)).alias("fp"), total.alias("positives")
    ).withColumn("size", F.bit_count("m"))


def leave_one_out_fit(per: DataFrame, match: str, group: Sequence[str]) -> DataFrame:
    """Linear fit without each match, and its error on that match: total minus own moments.

    ``per`` holds n, sx, sy, sxx, syy, sxy per (group, match).
    """
    group = list(group)
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    tot = per.groupBy(*group).agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    r = per.join(tot, group) if group else per.crossJoin(F.broadcast(tot))
    rest = {c: F.col(f"t_{c}") - F.col(c) for c in sums}
    den = rest["n"] * rest["sxx"] - rest["sx"] * rest["sx"]
    slope = F.when(F.abs(den) < 1e-9, 0.0).otherwise((rest["n"] * rest["sxy"] - rest["sx"] * rest["sy"]) / den)
    icpt = (rest["sy"] - slope * rest["sx"]) / rest["n"]
    r = r.withColumns({"slope": slope, "intercept": icpt})
    a, b, c = F.col("slope"), F.col("intercept"), F.col
    sse = c("syy") - 2 * a * c("sxy") - 2 * b * c("sy") + a * a * c("sxx") + 2 * a * b * c("sx") + b * b * c("n")
    return r.filter(rest["n"] >= 3).select(*group, match, "n", "slope", "intercept", F.sqrt(F.greatest(F.lit(0.0), sse / c("n"))).alias("rmse"))


def leave_one_out_lookup(rows: DataFrame, match: str, spec: Sequence[str], key: str, label: str) -> DataFrame:
    """Conflict-free lookup learned from all other matches: total minus own label counts."""
    spec = list(spec)
    own = rows.groupBy(*spec, key, label, match).agg(F.count("*").alias("own"))
    tot = own.groupBy(*spec, key, label).agg(F.sum("own").alias("all"))
    # a label remains for a match when others hold it too
    labels = tot.groupBy(*spec, key).agg(F.count("*").alias("labels"))
    exclusive = own.join(tot, [*spec, key, label]).filter("own = all").groupBy(*spec, key, match).agg(F.count("*").alias("gone"))
    r = own.join(tot, [*spec, key, label]).join(labels, [*spec, key]).join(exclusive, [*spec, key, match], "left")
    left = F.col("labels") - F.coalesce("gone", F.lit(0))
    mine = F.col("all") > F.col("own")
    return r.groupBy(*spec, match).agg(
        F.sum("own").alias("rows"), F.sum(F.when((left == 1) & mine, F.col("own")).otherwise(0)).alias("exact"),
        F.sum(F.when((left == 1) & ~mine, F.col("own")).otherwise(0)).alias("wrong"), F.sum(F.when(left != 1, F.col("own")).otherwise(0)).alias("unavailable"),
    )


def projection_interval(df: DataFrame, keys: Sequence[str], raw: str, label: str) -> DataFrame:
    """Offsets ε with floor(raw + ε) = label for every row: [max lower, min upper)."""
    low = F.max(F.col(label) - F.col(raw))
    high = F.min(F.col(label) + 1 - F.col(raw))
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), low.alias("lower"), high.alias("upper"), (low < high).alias("feasible"))


def change_patterns(changes: DataFrame, offsets: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Per-offset coverage, and the labelled change patterns over offsets without a false positive.

    ``changes`` has one row per transition with its changed offsets. Equal patterns collapse to
    one row with a count, so later steps work on patterns instead of transitions.
    """
    cover = changes.select(label, F.explode(offsets).alias("offset")).groupBy("offset").agg(
        F.count_if(label).alias("covered"), F.count_if(~F.col(label)).alias("false_positives")
    )
    clean = cover.filter("false_positives = 0").agg(F.array_sort(F.collect_list("offset")).alias("clean"))  # offsets of one record
    hits = changes.filter(label).crossJoin(F.broadcast(clean))  # one-row side
    pattern = F.array_sort(F.array_intersect(offsets, F.coalesce("clean", F.array().cast("array<int>"))))
    return cover, hits.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))


def exact_unions(patterns: DataFrame) -> DataFrame:
    """Unions of one to three clean offsets that cover every labelled change.

    A levelwise search: pairs grow from single offsets, triples from pairs, and a candidate is kept only while
    its coverages and the best one still to come could add up to all changes. |A ∪ B ∪ C| then follows from how
    often offsets change together, which patterns of a record's few clean offsets emit as weighted subsets;
    transitions never meet each other, and all joins are on offsets.
    """
    from eventloom.session import cut_lineage

    patterns, whole = cut_lineage(patterns), F.lit(-1)  # -1 stands for all changes
    one = patterns.select("n", "pattern", F.explode("pattern").alias("a"))
    two = one.withColumn("b", F.explode(F.filter("pattern", lambda v: v > F.col("a"))))
    three = two.withColumn("c", F.explode(F.filter("pattern", lambda v: v > F.col("b"))))
    n1 = patterns.select("n", F.explode(F.concat("pattern", F.array(whole))).alias("a")).groupBy("a").agg(F.sum("n").alias("n"))
    n2 = two.groupBy("a", "b").agg(F.sum("n").alias("n"))
    n3 = three.groupBy("a", "b", "c").agg(F.sum("n").alias("n_abc"))
    # one row: the offsets of one record with their coverage
    level = n1.agg(F.array_sort(F.collect_list(F.when(F.col("a") != whole, F.struct("a", "n")))).alias("s"), F.max(F.when(F.col("a") == whole, F.col("n"))).alias("total"))
    level = level.withColumn("most", F.coalesce(F.array_max(F.transform("s", lambda v: v["n"])), F.lit(0)))

    def grown(rows: DataFrame, last: str | None, name: str, left: int) -> DataFrame:
        """Candidates with one more offset, ``left`` of which may still follow."""
        more = F.explode(F.col("s") if last is None else F.filter("s", lambda v: v["a"] > F.col(last))).alias("_v")
        rows = rows.select("*", more).withColumns({name: F.col("_v.a"), f"n_{name}": F.col("_v.n"), "sum": F.col("sum") + F.col("_v.n")}).drop("_v")
        return rows.filter(F.col("sum") + left * F.col("most") >= F.col("total"))

    def both(x: str, y: str) -> DataFrame:
        return n2.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n").alias(f"n_{x}{y}"))

    def kept(rows: DataFrame, names: Sequence[str], covered: Column) -> DataFrame:
        return rows.select(F.concat_ws("+", *names).alias("union_of"), F.lit(len(names)).alias("size"), covered.alias("covered"), "total").filter("covered = total").drop("total")

    def c(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    a = grown(level.withColumn("sum", F.lit(0).cast("long")), None, "a", 2)
    ab = grown(a, "a", "b", 1)
    abc = grown(ab, "b", "c", 0)
    ab = ab.join(both("a", "b"), ["a", "b"], "left")
    abc = abc.join(both("a", "b"), ["a", "b"], "left").join(both("a", "c"), ["a", "c"], "left").join(both("b", "c"), ["b", "c"], "left").join(n3, ["a", "b", "c"], "left")
    out = kept(a, ["a"], F.col("n_a"))
    out = out.unionByName(kept(ab, ["a", "b"], F.col("sum") - c("n_ab")))
    return out.unionByName(kept(abc, ["a", "b", "c"], F.col("sum") - c("n_ab") - c("n_ac") - c("n_bc") + c("n_abc")))


def greedy_cover(patterns: DataFrame) -> DataFrame:
    """Clean offsets in greedy order: each takes the offset covering most of what is left.

    Every round settles one offset, so there are at most as many rounds (and result rows) as offsets.
    """
    from eventloom.session import cut_lineage

    spark, left, steps = patterns.sparkSession, cut_lineage(patterns), []
    for step in count(1):
        gain = left.select("n", F.explode("pattern").alias("offset")).groupBy("offset").agg(F.sum("n").alias("gain"))
        best = gain.orderBy(F.desc("gain"), "offset").first()  # one row
        if best is None:
            break
        steps.append((step, int(best["offset"]), int(best["gain"])))
        left = cut_lineage(left.filter(~F.array_contains("pattern", best["offset"])))
    return spark.createDataFrame(steps, "step int, offset int, gain long")
