"""One-to-one matching, pairing and comparison of event streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import ordered as o
from eventloom.operators import timejoin as tj
from eventloom.operators.monotone import optimal_pairs


def _tolerance_components(decoded, oracle, keys, t, ident, tolerance, block_ms) -> DataFrame:
    """Stack both streams and number the runs no match can cross.

    Two rows further apart than the tolerance never match, so a gap wider than it splits a
    key into independent components. That spreads a hot key over many tasks and is exact.
    Null keys count as equal: the scan runs on one struct of the keys.
    """
    keys = list(keys)
    stack = decoded.select(*keys, F.lit(0).alias("side"), F.col(ident).alias("id"), F.col(t).alias("t")).unionByName(
        oracle.select(*keys, F.lit(1).alias("side"), F.col(ident).alias("id"), F.col(t).alias("t"))
    )
    block = o.time_block("t", block_ms) if block_ms else None
    whole = stack.select(F.struct(*keys).alias("_key"), "side", "id", "t")
    return o.gap_islands(whole, ["_key"], "t", ["t", "side", "id"], block, tolerance, "component").select("_key.*", "side", "id", "t", "component")


def _match_schema(df: DataFrame, keys) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = [f"`{k}` {kinds[k]}" for k in keys]
    return ", ".join(cols + [f"decoded_id {kinds['id']}", f"oracle_id {kinds['id']}", "decoded_t long", "oracle_t long"])


def _run_components(df: DataFrame, keys, matcher) -> DataFrame:
    """Stream sorted components through ``matcher`` inside each task."""
    keys = list(keys)
    group = [*keys, "component"]
    placed = df.repartition(*group).sortWithinPartitions(*group, "t", "side", "id")
    names = [*keys, "decoded_id", "oracle_id", "decoded_t", "oracle_t"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = matcher()
        for pdf in batches:
            out = []
            # a null key comes as NaN, which equals nothing
            heads = zip(*[[None if v != v else v for v in pdf[c].tolist()] for c in group])
            for head, side, ident, t in zip(heads, pdf["side"].tolist(), pdf["id"].tolist(), pdf["t"].tolist()):
                out.extend(state.push(head, side, ident, t))
            if out:
                yield pd.DataFrame(out, columns=names).convert_dtypes()
        out = list(state.flush())
        if out:
            yield pd.DataFrame(out, columns=names).convert_dtypes()

    return placed.mapInPandas(run, _match_schema(df, keys))


def greedy_match(decoded, oracle, keys, t, ident, tolerance: int, block_ms: int | None = None) -> DataFrame:
    """Each decoded event, in time order, takes the first unused oracle event in tolerance.

    Equality attributes (ordered arrays too) belong in ``keys``. Output rows carry both
    ids for a match, only ``decoded_id`` for an extra and only ``oracle_id`` for a missing
    event. Both streams advance together, so a task holds only rows inside the tolerance.
    """

    class TwoPointer:
        def __init__(self):
            self.head, self.wait = None, (deque(), deque())

        def _row(self, decoded_ev, oracle_ev):
            d, r = decoded_ev or (None, None), oracle_ev or (None, None)
            return (*self.head[:-1], d[0], r[0], d[1], r[1])

        def flush(self):
            for ev in self.wait[0]:
                yield self._row(ev, None)
            for ev in self.wait[1]:
                yield self._row(None, ev)
            self.wait = (deque(), deque())

        def push(self, head, side, ident, t):
            if head != self.head:
                yield from self.flush()
                self.head = head
            for queue_side, queue in enumerate(self.wait):
                while queue and queue[0][1] < t - tolerance:
                    ev = queue.popleft()
                    yield self._row(ev, None) if queue_side == 0 else self._row(None, ev)
            other = self.wait[1 - side]
            if other:
                ev = other.popleft()
                yield self._row((ident, t), ev) if side == 0 else self._row(ev, (ident, t))
            else:
                self.wait[side].append((ident, t))

    return _run_components(
        _tolerance_components(decoded, oracle, keys, t, ident, tolerance, block_ms), keys, TwoPointer
    )


def optimal_match(decoded, oracle, keys, t, ident, tolerance: int, block_ms: int | None = None, slices: int = 64) -> DataFrame:
    """Order-keeping matching with the most pairs, then the least total |Δt|, then the smallest largest |Δt|.

    Components that no match can cross are solved apart; one that is longer than ``slices`` tolerances is
    solved in time slices whose programs are composed (see ``monotone``).
    """
    timed = _tolerance_components(*[side.filter(F.col(t).isNotNull()) for side in (decoded, oracle)], keys, t, ident, tolerance, block_ms)
    found = optimal_pairs(timed, keys, tolerance, slices)
    none = [F.lit(None).cast(f.dataType) for f in found.schema.fields[-4:]]
    for k, side in enumerate((decoded, oracle)):
        cells = [F.col(ident) if at == k else c for at, c in enumerate(none)]
        found = found.unionByName(side.filter(F.col(t).isNull()).select(*keys, *[c.alias(n) for c, n in zip(cells, found.columns[-4:])]))
    return found


def exact_match(decoded, oracle, keys, t, ident) -> DataFrame:
    """Same-time one-to-one match: the n-th decoded with the n-th oracle of equal attributes and time."""
    spot = [*keys, t]
    d = o.position(decoded.select(*spot, ident), spot, [ident], None, "n")
    r = o.position(oracle.select(*spot, ident), spot, [ident], None, "n")
    return d.withColumnRenamed(ident, "decoded_id").join(r.withColumnRenamed(ident, "oracle_id"), [*spot, "n"], "full")


def match_summary(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched, extra, missing and the largest |Δt| per key."""
    hit = F.col("decoded_id").isNotNull() & F.col("oracle_id").isNotNull()
    return matches.groupBy(*keys).agg(
        F.count(F.when(hit, 1)).alias("matched"),
        F.count(F.when(F.col("oracle_id").isNull(), 1)).alias("extra"),
        F.count(F.when(F.col("decoded_id").isNull(), 1)).alias("missing"),
        F.coalesce(F.max(F.when(hit, F.abs(F.col("decoded_t") - F.col("oracle_t")))), F.lit(0)).alias("max_delta"),
    )


def label_outcomes(decoded, oracle, entity, value, t, ident, tolerance, block_ms=None) -> DataFrame:
    """Matched / extra / missing plus ``wrong``: an unmatched event with an unmatched label of
    another value at the same entity and time."""
    pairs = greedy_match(decoded, oracle, [*entity, *value], t, ident, tolerance, block_ms)
    lone = pairs.filter(F.col("oracle_id").isNull()).select(*entity, F.col("decoded_id").alias("id"), F.col("decoded_t").alias("t"))
    left = pairs.filter(F.col("decoded_id").isNull()).select(*entity, F.col("oracle_id").alias("id"), F.col("oracle_t").alias("t"))
    wrong = tj.within(lone, left, entity, "t", tolerance).select(F.col("id").alias("decoded_id")).distinct()
    wrong = wrong.withColumn("_wrong", F.lit(True))
    out = pairs.join(wrong, "decoded_id", "left")
    return out.withColumn(
        "outcome",
        F.when(F.col("decoded_id").isNull(), "missing")
        .when(F.col("oracle_id").isNotNull(), "matched")
        .when(F.col("_wrong"), "wrong")
        .otherwise("extra"),
    ).drop("_wrong")


def entity_flags(left: DataFrame, right: DataFrame, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Left join on all ``on`` columns with one equality flag per field."""
    renamed = right.select(*on, *[F.col(f).alias(f"_r_{f}") for f in fields])
    out = left.join(renamed, list(on), "left")
    return out.withColumns({f"{f}_equal": F.col(f).eqNullSafe(F.col(f"_r_{f}")) for f in fields}).drop(
        *[f"_r_{f}" for f in fields]
    )


def best_scored(left: DataFrame, right: DataFrame, keys: Sequence[str], weights: dict[str, int], left_id: str, right_order: str) -> DataFrame:
    """Best row of the roster of the same ``keys`` (the match) per left row, by summed weights of equal fields; the first maximum wins.

    The score is a sum of weights over which fields agree, so it is enough to look up, per
    subset of agreeing fields, the first roster row. Each subset is one equi-join against a
    roster reduced to one row per field combination; no cross join arises.
    """
    keys, fields = list(keys), list(weights)
    found = None
    for mask in range(1, 1 << len(fields)):
        chosen = [f for i, f in enumerate(fields) if mask >> i & 1]
        first = (
            right.dropna(subset=chosen).groupBy(*keys, *chosen).agg(F.min(right_order).alias("candidate"))
        )
        part = left.join(first, [*keys, *chosen]).select(
            left_id, "candidate", F.lit(sum(weights[f] for f in chosen)).cast("long").alias("score")
        )
        found = part if found is None else found.unionByName(part)
    # with no agreeing field at all the first roster row of the match stands, at score 0
    first_row = right.groupBy(*keys).agg(F.min(right_order).alias("candidate"))
    none = left.join(found.select(left_id).distinct(), left_id, "left_anti").select(left_id, *keys)
    none = none.join(first_row, keys).select(left_id, "candidate", F.lit(0).cast("long").alias("score"))
    return o.best(found.unionByName(none), [left_id], [F.desc("score"), F.asc("candidate")])


def exclusive_owner(df, keys, order, block, is_owner: Column, is_marker: Column, t: str, owner: str, tolerance: int):
    """Markers with the latest preceding owner, when no other marker came since that owner.

    Needs time to be non-decreasing along the order.
    """
    spot = F.struct(*[F.col(c) for c in order])
    info = F.struct(spot.alias("at"), F.col(t).alias("t"), F.col(owner).alias("owner"))
    out = o.scan(
        df, keys, order, block,
        {"_owner": o.before(F.when(is_owner, info)), "_marker": o.before(F.when(is_marker, spot))},
    )
    fresh = F.col("_marker").isNull() | (F.col("_marker") < F.col("_owner.at"))
    near = F.abs(F.col("_owner.t") - F.col(t)) <= tolerance
    out = out.filter(is_marker & F.col("_owner").isNotNull() & fresh & near)
    return out.withColumn("owner_of", F.col("_owner.owner")).drop("_owner", "_marker")


def preceding_candidates(markers, owners, keys, t, index, owner, tolerance: int) -> DataFrame:
    """Latest owner before each marker inside the tolerance, and how many there are.

    Needs time to be non-decreasing along ``index``. Counts are differences of one running count,
    read at the marker and at the start of its window; no pairs are made.
    """
    keys = list(keys)

    def marks(df, at: Column, rank: int, kind: str, who: Column) -> DataFrame:
        one = F.lit(int(kind == "owner")).cast("long")
        return df.select(*keys, at.alias("_at"), F.lit(rank).alias("_rank"), F.col(index).alias("_id"), F.lit(kind).alias("_kind"), who.alias("_who"), one.alias("_one"))

    nobody = F.lit(None).cast(owners.schema[owner].dataType)
    rows = marks(owners, F.col(t), 1, "owner", F.col(owner)).unionByName(marks(markers, F.col(t), 1, "end", nobody))
    rows = rows.unionByName(marks(markers, F.col(t) - tolerance, 0, "start", nobody))
    seen = F.when(F.col("_kind") == "owner", F.struct("_who"))
    run = o.scan(rows, keys, ["_at", "_rank", "_id"], o.time_block("_at", 8 * (tolerance + 1)), {"_n": o.run_sum("_one"), "_last": o.before(seen)})
    end = F.col("_kind") == "end"
    out = run.filter("_kind <> 'owner'").groupBy(*keys, F.col("_id").alias(index)).agg(
        F.max(F.when(end, F.col("_last._who"))).alias("latest_owner"), (F.max(F.when(end, F.col("_n"))) - F.max(F.when(~end, F.col("_n")))).alias("candidates")
    )
    return out.filter("candidates > 0")


def lifecycle(placements, removals, keys, t) -> DataFrame:
    """Placements with the earliest removal of the same id, if any."""
    first = removals.groupBy(*keys).agg(F.min(t).alias("removed_t"))
    return placements.join(first, list(keys), "left")


def lifecycle_counts(handles, removals, keys, t) -> DataFrame:
    """Per id with a removal: how many handle rows lie before, at and after it."""
    first = removals.groupBy(*keys).agg(F.min(t).alias("removed_t"))
    return handles.join(first, list(keys)).groupBy(*keys, "removed_t").agg(
        F.count_if(F.col(t) < F.col("removed_t")).alias("before"),
        F.count_if(F.col(t) == F.col("removed_t")).alias("at"),
        F.count_if(F.col(t) > F.col("removed_t")).alias("after"),
    )


def adjacent_pairs(df, keys, order, block, same: Sequence[str], index: str) -> DataFrame:
    """Rows whose next row agrees on ``same`` and has index+1."""
    nxt = F.struct(*[F.col(c) for c in [*same, index]])
    out = o.scan(df, keys, order, block, {"_n": o.following(nxt)})
    agree = F.col(f"_n.{index}") == F.col(index) + 1
    for c in same:
        agree = agree & (F.col(f"_n.{c}") == F.col(c))
    return out.filter(agree).drop("_n")


def add_before_removal(df, keys, order, block, is_add: Column, is_removal: Column, add_info: Column) -> DataFrame:
    """Removals with the latest add of the same key since the previous removal."""
    spot = F.struct(*[F.col(c) for c in order])
    out = o.scan(
        df, keys, order, block,
        {
            "_add": o.before(F.when(is_add, F.struct(spot.alias("at"), add_info.alias("info")))),
            "_rem": o.before(F.when(is_removal, spot)),
        },
    )
    open_add = F.col("_add").isNotNull() & (F.col("_rem").isNull() | (F.col("_add.at") > F.col("_rem")))
    return out.filter(is_removal & open_add).withColumn("add_info", F.col("_add.info")).drop("_add", "_rem")


def association(labels, groups, keys, t, ident, tolerance: int) -> DataFrame:
    """Labels classed one / none / ambiguous by how many groups lie within the tolerance.

    A label with a null key, time or identifier has no groups.
    """
    counts = tj.window_counts(labels, groups, keys, t, ident, tolerance, "groups")
    out = labels.join(counts, [*keys, ident], "left").withColumn("groups", F.coalesce("groups", F.lit(0).cast("long")))
    return out.withColumn(
        "association", F.when(F.col("groups") == 0, "none").when(F.col("groups") == 1, "one").otherwise("ambiguous")
    )


def companions(labels, blocks, keys, t, ident, family: str, tolerance: int) -> DataFrame:
    """Per label time and family: how many blocks lie nearby and the closest one's distance.

    Every label sets three marks for each family of its key, at the ends of its window and at its own time.
    A scan per family reads a running count and the last and next block there, so no pairs are made.
    """
    keys = list(keys)
    times = blocks.groupBy(*keys, family, t).agg(F.count("*").alias("_one"))
    rows = times.select(*keys, family, F.col(t).alias("_at"), F.lit(1).alias("_rank"), "_one", F.col(t).alias("_t"), F.lit(None).cast(labels.schema[ident].dataType).alias("_id"))
    spots = F.explode(F.array(*[F.struct((F.col(t) + shift).alias("_at"), F.lit(rank).alias("_rank")) for shift, rank in ((-tolerance, 0), (0, 2), (tolerance, 3))])).alias("_m")
    marks = labels.select(*keys, t, ident).join(times.select(*keys, family).distinct(), keys).select(*keys, family, F.col(ident).alias("_id"), spots)
    marks = marks.select(*keys, family, "_m._at", "_m._rank", F.lit(0).cast("long").alias("_one"), F.lit(None).cast(times.schema[t].dataType).alias("_t"), "_id")
    run = o.scan(
        rows.unionByName(marks), [*keys, family], ["_at", "_rank", "_id"], o.time_block("_at", 8 * (tolerance + 1)),
        {"_n": o.run_sum("_one"), "_last": o.last_seen("_t"), "_next": o.after("_t")},
    )
    rank, gap = F.col("_rank"), F.least(F.col("_at") - F.col("_last"), F.col("_next") - F.col("_at"))
    return run.filter("_rank <> 1").groupBy(*keys, F.col("_id").alias(ident), family).agg(
        (F.max(F.when(rank == 3, F.col("_n"))) - F.max(F.when(rank == 0, F.col("_n")))).alias("blocks"), F.min(F.when(rank == 2, gap)).alias("closest")
    ).filter("blocks > 0")


def neighbourhood(df, keys, order, block, offsets: Sequence[int], cols: Sequence[str]) -> DataFrame:
    """Each row joined with the rows ``offsets`` positions away, via position equi-joins."""
    placed = o.position(df, keys, order, block, "pos")
    right = placed.select(*keys, F.col("pos").alias("_at"), *[F.col(c).alias(f"near_{c}") for c in cols])
    left = placed.withColumn("offset", F.explode(F.array(*[F.lit(int(x)) for x in offsets])))
    left = left.withColumn("_at", F.col("pos") + F.col("offset"))
    return left.join(right, [*keys, "_at"]).drop("_at")


def shuffled_control(df, keys, order, shift: int, cols: Sequence[str], block: Column | None = None) -> DataFrame:
    """Pair row i with row (i+shift) mod n of its group: a negative control."""
    placed = o.position(df, keys, order, block, "_i").withColumn("_i", F.col("_i") - 1)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = placed.join(sizes, list(keys))
    right = placed.select(*keys, F.col("_i").alias("_j"), *[F.col(c).alias(f"control_{c}") for c in cols])
    left = placed.withColumn("_j", F.pmod(F.col("_i") + shift, F.col("_n")))
    return left.join(right, [*keys, "_j"]).drop("_i", "_j", "_n")


def cell_compare(left, right, keys, value: str, tolerance: float) -> DataFrame:
    """Cell outcome after null normalisation: equal, close, different, missing or extra."""
    a, b = F.col("_a"), F.col("_b")
    joined = left.select(*keys, F.nullif(F.col(value).cast("string"), F.lit("")).alias("_a")).join(
        right.select(*keys, F.nullif(F.col(value).cast("string"), F.lit("")).alias("_b")), list(keys), "full"
    )
    da, db = F.expr("try_cast(_a AS double)"), F.expr("try_cast(_b AS double)")
    return joined.withColumn(
        "cell",
        F.when(a.eqNullSafe(b), "equal")
        .when(F.abs(da - db) <= tolerance, "close")
        .when(a.isNull(), "extra")
        .when(b.isNull(), "missing")
        .otherwise("different"),
    )


def anti_both(left, right, keys) -> DataFrame:
    """Keys only on one side."""
    keys = list(keys)
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    missing = l.join(r, keys, "left_anti").withColumn("status", F.lit("missing"))
    return missing.unionByName(r.join(l, keys, "left_anti").withColumn("status", F.lit("extra")))


def multiset_difference(left, right, keys, value) -> DataFrame:
    """Values with their surplus count on each side, per key."""
    spot = [*keys, value]
    signed = left.select(*spot, F.lit(1).alias("s")).unionByName(right.select(*spot, F.lit(-1).alias("s")))
    net = signed.groupBy(*spot).agg(F.sum("s").alias("surplus"))
    return net.filter(F.col("surplus") != 0)


def multiset_relation(left, right, keys, value) -> DataFrame:
    """Per key: are the two multisets equal, and is left contained in right?"""
    spot = [*keys, value]
    signed = left.select(*spot, F.lit(1).alias("s")).unionByName(right.select(*spot, F.lit(-1).alias("s")))
    # by value first, so that the values of one key lie in many tasks while they are counted
    tasks = o.task_count(signed)
    net = signed.repartition(tasks, *spot).groupBy(*spot).agg(F.sum("s").alias("surplus"))
    return net.repartition(tasks, *keys).groupBy(*keys).agg(
        F.bool_and(F.col("surplus") == 0).alias("equal"), F.bool_and(F.col("surplus") <= 0).alias("subset")
    )
