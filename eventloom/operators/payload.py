"""Profiles of binary payloads and fixed-size records.

Histograms and n-grams are counted over Arrow batches before anything is shuffled. Other profiles explode
payloads to one row per byte or word and aggregate with map-side combine; a hot family therefore costs
one partial row per (task, group). Records are whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import binary as bn
from eventloom.functions import stats as s
from eventloom.operators import ordered as o
from eventloom.session import cut_lineage


def explode_bytes(df: DataFrame, payload: str) -> DataFrame:
    keep = [c for c in df.columns if c != payload]
    out = df.select(*keep, F.posexplode(bn.bytes_array(payload)).alias("pos", "b"))
    return out.withColumns({"pos": F.col("pos").cast("long"), "b": F.col("b").cast("long")})


def explode_words(df: DataFrame, payload: str, width: int, stride: int) -> DataFrame:
    keep = [c for c in df.columns if c != payload]
    out = df.select(*keep, F.explode(bn.words_array(payload, width, stride)).alias("_w"))
    return out.select(*keep, F.col("_w.pos").cast("long").alias("pos"), F.col("_w.word").alias("word"))


def _slices(batches: Iterator[pa.RecordBatch], payload: str, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a few payloads: the rows, all their bytes laid end to end, and the row of every byte."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            some = batch.slice(start, rows)
            raw = [v or b"" for v in some.column(payload).to_pylist()]
            data = np.frombuffer(b"".join(raw), np.uint8)
            yield some, data, np.repeat(np.arange(len(raw)), [len(v) for v in raw])


def _with_keys(some: pa.RecordBatch, keys: Sequence[str], row: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    own = some.select(list(keys)).take(pa.array(row))
    return pa.RecordBatch.from_arrays([*own.columns, *[pa.array(v.astype(np.int64)) for v in columns.values()]], names=[*keys, *columns])


def byte_counts(df: DataFrame, keys, payload: str) -> DataFrame:
    """(keys, b, n): a histogram of every payload, made over Arrow batches; bytes never become rows."""
    keys = list(keys)

    def run(batches):
        for some, data, row in _slices(batches, payload):
            counts = np.bincount(row * 256 + data, minlength=256 * some.num_rows)
            at = np.flatnonzero(counts)
            yield _with_keys(some, keys, at // 256, b=at % 256, n=counts[at])

    own = df.select(*keys, payload)
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], T.StructField("b", T.LongType()), T.StructField("n", T.LongType())]))


def gram_counts(df: DataFrame, keys, payload: str, size: int) -> DataFrame:
    """(keys, gram, pos, n): byte n-grams of up to eight bytes as numbers, counted over a few payloads of a key at a time."""
    keys = list(keys)

    def run(batches):
        for some, data, row in _slices(batches, payload):
            if len(data) < size:
                continue
            gram = np.zeros(len(data) - size + 1, np.uint64)
            for k in range(size):
                gram = gram << np.uint64(8) | data[k:k + len(gram)]
            first = np.searchsorted(row, np.arange(some.num_rows))
            whole = row[:len(gram)] == row[size - 1:]
            # one number for each different key of the slice
            names: dict[tuple, int] = {}
            of_row = np.array([names.setdefault(k, r) for r, k in enumerate(zip(*[some.column(c).to_pylist() for c in keys]))] if keys else np.zeros(some.num_rows, int))
            gram, owner, pos = gram[whole], of_row[row[:len(whole)][whole]], (np.arange(len(whole)) - first[row[:len(whole)]])[whole]
            order = np.lexsort((pos, gram, owner))
            gram, owner, pos = gram[order], owner[order], pos[order]
            new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]) | (pos[1:] != pos[:-1]))) if len(gram) else np.zeros(0, int)
            yield _with_keys(some, keys, owner[new], gram=gram[new].view(np.int64), pos=pos[new], n=np.diff(np.append(new, len(gram))))

    own = df.select(*keys, payload)
    return own.mapInArrow(run, T.StructType([*own.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in ("gram", "pos", "n")]]))


def entropy(cells: DataFrame, keys, value: str = "b", weight: str | None = None) -> DataFrame:
    """Bits per byte, zero share and entropy normalised by the number of values."""
    keys = list(keys)
    counts = cells.groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    # H = log2(N) - sum(n log2 n)/N needs no second pass for the total
    total = F.sum("n")
    bits = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    out = counts.groupBy(*keys).agg(
        total.alias("bytes"), F.count("*").alias("distinct_values"), bits.alias("bits"),
        (F.coalesce(F.sum(F.when(F.col(value) == 0, F.col("n"))), F.lit(0)) / total).alias("zero_rate"),
    )
    return out.withColumn(
        "normalized", F.when(F.col("distinct_values") <= 1, 0.0).otherwise(F.col("bits") / F.log2("distinct_values"))
    )


def differential(pairs: DataFrame, left: str, right: str, top: int) -> DataFrame:
    """Per offset of paired arrays: equality rate and distinct values; the ``top`` offsets."""
    size = F.least(F.size(left), F.size(right))
    both = F.arrays_zip(F.slice(left, 1, size).alias("l"), F.slice(right, 1, size).alias("r"))
    rows = pairs.select(F.posexplode(both).alias("pos", "_p")).select("pos", "_p.l", "_p.r")
    out = rows.groupBy(F.col("pos").cast("long").alias("pos")).agg(
        F.count("*").alias("pairs"), s.ratio(F.col("l") == F.col("r")).alias("equal_rate"),
        F.count_distinct("l").alias("left_values"), F.count_distinct("r").alias("right_values"),
    )
    return out.orderBy(F.desc("equal_rate"), F.desc("pairs"), "pos").limit(top)


def gram_rows(df: DataFrame, keys, payload: str, size: int) -> DataFrame:
    """Every byte n-gram of every payload with its offset."""
    p = F.col(payload)
    last = F.octet_length(p) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.struct(i.cast("long").alias("pos"), F.hex(F.substring(p, i + 1, F.lit(size))).alias("gram")))
    return df.select(*keys, F.explode(grams).alias("_g")).select(*keys, "_g.*")


def ngrams(df: DataFrame, keys, payload: str, size: int) -> DataFrame:
    """Byte n-grams (up to eight bytes) of whole payloads with counts and distinct offsets."""
    if not 1 <= size <= 8:
        raise ValueError("n-grams of one to eight bytes")
    # collapse to (gram, offset) first: a hot gram then merges from few rows
    spots = gram_counts(df, keys, payload, size).groupBy(*keys, "gram", "pos").agg(F.sum("n").alias("n"))
    out = spots.groupBy(*keys, "gram").agg(F.sum("n").alias("n"), F.count("*").alias("offsets"))
    return out.withColumn("gram", F.lpad(F.hex("gram"), 2 * size, "0")).select(*keys, "gram", "n", "offsets")


def identifier_hits(rows: DataFrame, keys, value: str, token: str, match: str, min_support: int = 3, min_rate: float = 0.75) -> DataFrame:
    """Per key: comparable rows, those whose value is the expected token, in how many matches, and the rate.

    A key needs ``min_support`` hits and a rate of ``min_rate``. Rows without value or token are not comparable.
    """
    same = F.col(value) == F.col(token)
    out = rows.dropna(subset=[value, token]).groupBy(*keys).agg(
        F.count("*").alias("comparable"), F.count_if(same).alias("hits"), F.count_distinct(F.when(same, F.col(match))).alias("matches"), s.ratio(same).alias("hit_rate")
    )
    return out.filter((F.col("hits") >= min_support) & (F.col("hit_rate") >= min_rate))


def common_prefix(cells: DataFrame, keys) -> DataFrame:
    """Leading offsets on which all records of a key agree."""
    keys = list(keys)
    per = cells.groupBy(*keys, "pos").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n"))
    records = per.groupBy(*keys).agg(F.max("n").alias("records"), F.max("pos").alias("last"))
    varied = per.join(records, keys).filter((F.col("lo") != F.col("hi")) | (F.col("n") < F.col("records")))
    first = varied.groupBy(*keys).agg(F.min("pos").alias("first"))
    out = records.join(first, keys, "left")
    return out.select(*keys, F.coalesce("first", F.col("last") + 1).alias("prefix"))


def stability(cells: DataFrame, keys, strong: float) -> DataFrame:
    """Per offset ``X`` constant, ``*`` mostly one value, ``.`` varied."""
    keys = list(keys)
    counts = cells.groupBy(*keys, "pos", "b").agg(F.count("*").alias("n"))
    per = counts.groupBy(*keys, "pos").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    mark = F.when(F.col("top") == F.col("all"), "X").when(F.col("top") >= strong * F.col("all"), "*").otherwise(".")
    return per.select(*keys, "pos", mark.alias("mark"), (F.col("top") / F.col("all")).alias("share"))


def grid(cells: DataFrame, row_size: int, header: int = 0) -> DataFrame:
    """Byte cells with their row and in-row offset."""
    at = F.col("pos") - header
    return cells.filter(at >= 0).withColumns(
        {"row": F.floor(at / row_size).cast("long"), "offset": F.pmod(at, F.lit(row_size)).cast("long")}
    )


def column_profile(gridded: DataFrame, keys, record: str, rows: int) -> DataFrame:
    """Per in-row offset: distinct values, constant rows, spread within a record, discriminator flags."""
    keys = list(keys)
    distinct = gridded.groupBy(*keys, "offset").agg(F.count_distinct("b").alias("distinct_values"))
    by_row = gridded.groupBy(*keys, "offset", "row").agg(F.count_distinct("b").alias("d"))
    by_row = by_row.groupBy(*keys, "offset").agg(F.count_if(F.col("d") == 1).alias("constant_rows"), F.max("d").alias("max_row_distinct"))
    by_rec = gridded.groupBy(*keys, "offset", record).agg(F.count_distinct("b").alias("d"))
    by_rec = by_rec.groupBy(*keys, "offset").agg(F.avg("d").alias("mean_record_distinct"))
    out = distinct.join(by_row, [*keys, "offset"]).join(by_rec, [*keys, "offset"])
    return out.withColumns(
        {
            "discriminator": (F.col("mean_record_distinct") >= min(4, rows)) & (F.col("constant_rows") >= -(-rows * 6 // 10)),
            "record_constant": (F.col("distinct_values") <= 2) & (F.col("constant_rows") >= -(-rows * 8 // 10)),
        }
    )


def row_coherence(records: DataFrame, keys, order: str, block: Column, arr: str, rows: int, row_size: int, metric: str) -> DataFrame:
    """Does row i stay nearest to itself in the next record? Ties are counted apart.

    The grid has a fixed handful of rows, so the row-to-row distances are computed inside
    the record pair with array functions; no row join is needed.
    """
    keys = list(keys)
    cut = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(F.col(arr), i * row_size + 1, F.lit(row_size)))
    rec = records.select(*keys, order, cut.alias("rows"))
    if block is not None:
        rec = rec.withColumn("_blk", block)
    pairs = o.scan(rec, keys, [order], F.col("_blk") if block is not None else None, {"next": o.following("rows")}).filter("next IS NOT NULL")
    dist = bn.hamming if metric == "hamming" else bn.l1_distance
    pairs = pairs.select(*keys, order, "next", F.posexplode("rows").alias("row", "cells"))
    d = F.transform("next", lambda r: dist(F.col("cells"), r))
    scored = pairs.select(*keys, order, F.col("row").cast("long").alias("row"), d.alias("d"))
    own = F.element_at("d", (F.col("row") + 1).cast("int"))
    low = F.array_min("d")
    ties = F.size(F.filter("d", lambda v: v == low))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("comparisons"), F.count_if(own == 0).alias("same_row_wins"),
        F.count_if(own == low).alias("at_minimum"), F.count_if(ties > 1).alias("ambiguous"),
        F.count_if((ties == 1) & (own == low)).alias("nearest_wins"),
    )


def duplicate_rows(gridded: DataFrame, keys, record: str) -> DataFrame:
    """Share of grid rows that repeat inside their record."""
    keys = list(keys)
    cells = F.array_sort(F.collect_list(F.struct("offset", "b")))  # at most one row of the grid
    rows = gridded.groupBy(*keys, record, "row").agg(F.sha2(F.to_json(cells), 256).alias("h"))
    per = rows.groupBy(*keys, record, "h").agg(F.count("*").alias("n"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"))
    return out.withColumn("rate", F.col("duplicates") / F.col("rows"))


def column_stats(df: DataFrame, keys, order, block, value: str) -> DataFrame:
    """Range, distinct, zeros, small-integer and coordinate likelihood, monotonicity."""
    out = o.scan(df, keys, order, block, {"_p": o.prev(value)})
    v = F.col(value)
    return out.groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count_distinct(value).alias("distinct_values"),
        F.count_if(v == 0).alias("zeros"), F.count("*").alias("samples"),
        s.ratio((v == F.floor(v)) & v.between(0, 20000)).alias("small_integer"), s.ratio(v.between(0, 16000)).alias("coordinate"),
        F.try_divide(F.count_if(v >= F.col("_p")), F.count("_p")).alias("monotonicity"),
    )


def signature_clusters(words: DataFrame, keys, known: Sequence[int], word: str) -> DataFrame:
    """Tokens with at least two known motif bytes, counted per key."""
    hits = sum(
        (F.when(bn.bit_slice(word, 8 * i, 8).isin(*known), 1).otherwise(0) for i in range(4)), F.lit(0)
    )
    out = words.filter((F.col(word) != 0) & (hits >= 2))
    return out.groupBy(*keys, bn.fixed_hex(word, 8).alias("token")).agg(F.count("*").alias("n"))


def classify_token(value, row_count: Column) -> Column:
    """Token class by magnitude: row index, team, ordinal, medium id or high handle."""
    v = F.col(value)
    return (
        F.when(v == 0, "zero").when(v.isin(100, 200), "team").when(v <= 10, "ordinal")
        .when(v < row_count, "row_index").when(v <= 1000, "medium").otherwise("high")
    )


def handle_score(matches, families, rows, count, value, kind, high, row_hits, team_hits, ordinal_hits) -> Column:
    """Handle-likeness of a token bucket (fixed gates and points)."""
    v = F.col(value)
    points = (
        F.col(matches) * 10 + F.col(families) * 5 + F.least(F.col(rows), F.lit(100)) * 0.25
        + F.when(F.col(kind) == "u32", 15).when(F.col(kind) == "u64", 10).otherwise(0)
        + F.when(F.col(high) > 0, 8).otherwise(0) + F.when(F.col(row_hits) > 0, 6).otherwise(0)
        - F.when(F.col(team_hits) > 0, 20).otherwise(0) - F.when(F.col(ordinal_hits) > 0, 20).otherwise(0)
    )
    closed = (
        (v <= 10) | (F.col(matches) < 2) | (F.col(families) < 2) | (F.col(families) > 10) | (F.col(rows) > 400)
        | (F.col(count) > 2000) | ((F.col(kind) == "u16") & (v < 1024))
    )
    return F.when(closed, 0.0).otherwise(points.cast("double"))


def handle_edges(words: DataFrame, family: str, offset: str, word: str, dims: DataFrame, match: str, row: str) -> DataFrame:
    """Edges source family/offset -> target family where the token is below the target's row count.

    Tokens first collapse to counts per value; the small per-family dimension is then probed
    by value range through power-of-two buckets, an equi-join instead of a range join.
    """
    level = F.ceil(F.log2(F.col(word) + 1)).cast("int")
    tokens = words.filter(F.col(word) > 0).groupBy(family, offset, word, match, row).agg(F.count("*").alias("n")).withColumn("_lv", level)
    reach = dims.select(
        F.col(family).alias("target"), "row_count",
        F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("row_count") + 1)).cast("int"))).alias("_lv"),
    )
    hits = tokens.join(reach, "_lv").filter(F.col(word) < F.col("row_count"))
    return hits.groupBy(family, offset, "target").agg(
        F.sum("n").alias("n"), F.count_distinct(match).alias("matches"),
        F.count_distinct(row).alias("source_rows"), F.count_distinct(word).alias("target_rows"),
    )


def handle_pattern_score(coverage, assigned, within, rows, source_rows, target_rows, entropy_, width: int, same_family) -> Column:
    """Weighted handle-pattern score (fixed weights)."""
    specificity = F.when(rows > 0, 1 - s.clamp((rows - 1) / 24)).otherwise(0.0)
    bonus = {4: 0.04, 8: 0.02}.get(width, 0.0)
    return (
        0.18 * coverage + 0.30 * assigned + 0.20 * within + 0.16 * specificity + bonus
        - 0.10 * s.clamp((source_rows - 10) / 40) - 0.10 * s.clamp((target_rows - 10) / 40)
        - 0.08 * s.clamp(entropy_) - F.when(same_family, 0.08).otherwise(0.0)
    )


def mirror_ranges(records: DataFrame, arr: str, window: int) -> DataFrame:
    """Offset ranges that hold the same bytes at a constant distance in every record.

    Each window start is fingerprinted over all records with an order-free XOR of
    (record, window) hashes, so no start needs all records in one task. Pairs of starts with
    equal fingerprints group by distance into runs.
    """
    ident = [c for c in records.columns if c != arr]
    n = F.size(arr)
    starts = F.sequence(F.lit(0), n - window)
    win = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.array_join(F.slice(F.col(arr), i + 1, F.lit(window)).cast("array<string>"), ",").alias("w")))
    rows = records.select(*ident, F.explode(win).alias("_w")).select(*ident, "_w.*")
    sig = rows.groupBy("start").agg(
        F.bit_xor(F.xxhash64(*ident, "w")).alias("a"), F.sum(F.xxhash64("w", *ident).cast("decimal(38,0)")).alias("b"),
        (F.min("w") != F.max("w")).alias("varies"),
    ).filter("varies")
    pairs = sig.select("a", "b", F.col("start").alias("left_start")).join(sig.select("a", "b", F.col("start").alias("right_start")), ["a", "b"])
    pairs = pairs.filter("left_start < right_start").withColumn("distance", F.col("right_start") - F.col("left_start"))
    runs = o.gap_islands(pairs, ["distance"], "left_start", ["left_start"], None, 1, "run")
    return runs.groupBy("distance", "run").agg(
        F.min("left_start").alias("left_start"), (F.max("left_start") - F.min("left_start") + window).alias("length")
    ).drop("run")


def grid_hypotheses(lengths: DataFrame, length: str) -> DataFrame:
    """Row-grid shapes: 10 or 5 rows, header 0..16, rows of 4..128 bytes that divide the rest."""
    out = lengths.withColumn("row_count", F.explode(F.array(F.lit(10), F.lit(5)))).withColumn("header", F.explode(F.sequence(F.lit(0), F.lit(16))))
    rest = F.col(length) - F.col("header")
    out = out.withColumn("row_size", F.try_divide(rest, F.col("row_count")))
    fits = (rest > 0) & (F.pmod(rest, F.col("row_count")) == 0) & F.col("row_size").between(4, 128)
    return out.filter(fits).withColumn("row_size", F.col("row_size").cast("long"))


def stride_guess(records: DataFrame, keys, arr: str, lags: Sequence[int]) -> DataFrame:
    """Lag with the highest share of bytes equal to the byte one lag later; smaller lag on ties.

    Agreement is counted inside each record, so only one partial count per lag leaves it.
    """
    keys = list(keys)

    def agree(lag: int) -> Column:
        size = F.greatest(F.size(arr) - lag, F.lit(0))
        pair = F.zip_with(F.slice(arr, 1, size), F.slice(arr, lag + 1, size), lambda a, b: F.when(a == b, 1).otherwise(0))
        hits = F.aggregate(pair, F.lit(0), lambda acc, v: acc + v)
        return F.struct(F.lit(lag).cast("long").alias("lag"), hits.cast("long").alias("hits"), size.cast("long").alias("n"))

    rows = records.select(*keys, F.explode(F.array(*[agree(x) for x in lags])).alias("_a")).select(*keys, "_a.*")
    per = rows.groupBy(*keys, "lag").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    per = per.withColumn("agreement", F.try_divide("hits", "n"))
    return o.best(per, keys, [F.desc("agreement"), F.asc("lag")])


def row_offset_fields(lanes: DataFrame, keys, order, block, min_active: int) -> DataFrame:
    """Per slot, offset and decode: activity, change and range of the decoded series.

    A field is active where it is nonzero; fields with fewer active samples are dropped.
    """
    out = o.scan(lanes, keys, order, block, {"_p": o.prev("decoded")})
    v = F.col("decoded")
    return out.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count_if(v != 0).alias("active"), F.count_distinct("decoded").alias("unique_values"),
        F.count_if(F.col("_p").isNotNull() & (v != F.col("_p"))).alias("changed"), F.min(v).alias("low"), F.max(v).alias("high"),
    ).filter(F.col("active") >= min_active)


#: Places of the map of known words, a prime; and bytes that are read at once.
PLACES, SEGMENT = 16_777_213, 1 << 20


def known_words(df: DataFrame, keys: Sequence[str], payload: str, words: DataFrame) -> DataFrame:
    """Per payload, how often the known 32-bit ``words`` (word, distinct) occur in it at any byte, in both byte orders.

    A map of 2 MB, with a bit for the remainder of every known word, goes to the tasks. Only words that it may hold
    leave an Arrow batch, once for each payload (or megabyte of it) with their counts; the join then decides exactly.
    """
    keys = list(keys)
    words = cut_lineage(words.filter(F.col("word").isNotNull()))
    place = F.col("word") % PLACES
    found = words.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((word % {PLACES}) & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros((PLACES >> 6) + 1, np.uint64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(bits)  # of fixed size
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        held = shared.value
        for batch in batches:
            cells = pc.fill_null(batch.column(payload).cast(pa.large_binary()), b"")
            ends = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset:cells.offset + len(cells) + 1]
            if ends[-1] - ends[0] < 4:
                continue
            flat, ends = np.frombuffer(cells.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends[1:] - ends[0]
            for start in range(0, len(flat) - 3, SEGMENT):
                part = flat[start:start + SEGMENT + 3].astype(np.uint32)
                word = part[:-3] | part[1:-2] << 8 | part[2:-1] << 16 | part[3:] << 24
                at = start + np.arange(len(word))
                row = np.searchsorted(ends, at, side="right")
                inside = at + 4 <= ends[row]
                seen = []
                for big, read in enumerate((word, word.byteswap())):
                    spot = (read % np.uint32(PLACES)).astype(np.int64)
                    hit = np.flatnonzero(inside & ((held[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)) == 1))
                    seen.append((row[hit] << 32 | read[hit].astype(np.int64), np.full(len(hit), big)))
                key, place_ = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
                if not len(key):
                    continue
                big = np.bincount(place_, weights=np.concatenate([b for _, b in seen]), minlength=len(key)).astype(np.int64)
                every = np.bincount(place_, minlength=len(key))
                rows = pa.array(key >> 32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(rows) for k in keys], pa.array(key & 0xFFFFFFFF), pa.array(every - big), pa.array(big)], names=[*keys, "word", "little", "big"]
                )

    ddl = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "word long, little long, big long"])
    hits = df.select(*keys, payload).mapInArrow(run, ddl).join(words, "word", "left_semi")
    return hits.groupBy(*keys).agg(F.sum("little").alias("little"), F.sum("big").alias("big"))
