"""Event assembly and per-entity state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import ordered as o
from eventloom.operators import timejoin as tj
from eventloom.session import cut_lineage


def roles(kills: DataFrame, keys, killer: str, victim: str, assists: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per participant and role of each kill event."""
    parts = F.concat(
        F.array(
            F.struct(F.col(killer).alias("participant_id"), F.lit("kill").alias("role")),
            F.struct(F.col(victim).alias("participant_id"), F.lit("death").alias("role")),
        ),
        F.transform(assists, lambda a: F.struct(a.alias("participant_id"), F.lit("assist").alias("role"))),
    )
    return kills.select(*keys, *extra, F.explode(parts).alias("_r")).select(*keys, *extra, "_r.*")


def combat_totals(kills: DataFrame, keys, killer: str, victim: str, assists: str) -> DataFrame:
    return roles(kills, keys, killer, victim, assists).groupBy(*keys, "participant_id").agg(
        *[F.count_if(F.col("role") == r).alias(n) for r, n in (("kill", "kills"), ("death", "deaths"), ("assist", "assists"))]
    )


def kill_events(df, keys, order, block, t: str, who: str, is_owner: Column, is_marker: Column, tolerance: int, valid: Column) -> DataFrame:
    """Owners since the previous marker and within the tolerance, closed by a marker.

    First owner is the victim, last the killer, the middle the assists; a single owner is an
    execution (killer 0). Each owner finds its next marker by a scan; only owners inside the
    tolerance are gathered, so a long run without a marker is never collected.
    """
    spot = F.struct(*[F.col(c) for c in order])
    mark = F.struct(spot.alias("at"), F.col(t).alias("t"), F.col(who).alias("who"))
    df = df.withColumn("_valid", valid)
    out = o.scan(df, keys, order, block, {"_m": o.next_seen(F.when(is_marker, mark))})
    owners = out.filter(is_owner & F.col("_m").isNotNull() & (F.abs(F.col("_m.t") - F.col(t)) <= tolerance))
    seq = F.array_sort(F.collect_list(F.struct(spot.alias("at"), F.col(who).alias("who"))))
    runs = owners.groupBy(*keys, "_m").agg(seq.alias("_s"), F.bool_and("_valid").alias("_ok"))
    ids = F.transform("_s", lambda v: v["who"])
    n = F.size("_s")
    code = (
        F.when(~F.col("_ok"), "owner-outside-range")
        .when(F.element_at(ids, 1) != F.col("_m.who"), "victim-mismatch")
        .otherwise("ok")
    )
    return runs.select(
        *keys, F.col("_m.t").alias("t"), F.col("_m.at").alias("marker"), code.alias("code"), F.col("_m.who").alias("victim"),
        F.when(n == 1, F.lit(0)).otherwise(F.element_at(ids, -1)).alias("killer"),
        F.when(n <= 2, F.array().cast("array<long>")).otherwise(F.slice(ids, 2, F.greatest(n - 2, F.lit(0)))).alias("assists"),
    )


def classify_by_rules(df, rules: DataFrame, kind: str, length: str, payload: str, byte_at) -> DataFrame:
    """Rule join on type, then length range and a discriminator byte from the start or the end.

    The rule table is a fixed, hand-written dimension, so it is broadcast.
    """
    out = df.join(F.broadcast(rules), kind)
    at = F.when(F.col("anchor") == "start", F.col("offset")).otherwise(F.col(length) - 1 - F.col("offset"))
    hit = F.col(length).between(F.col("min_length"), F.col("max_length")) & (byte_at(payload, at) == F.col("byte"))
    return out.filter(hit)


def multiset_fold(df, keys, item: str, order, block, delta: Column) -> DataFrame:
    """Item count after each event, where removing an absent item does nothing.

    The floored running sum gives the count before and after each event, and ``change``, the
    effective change between them; ``held`` sums those over all items of the key. No sequential
    state is needed.
    """
    df = df.withColumn("_d", delta)
    out = o.floored_sum(df, [*keys, item], order, block, "_d", "count", "_before")
    out = out.withColumn("change", F.col("count") - F.col("_before"))
    return o.scan(out, keys, order, block, {"held": o.run_sum("change")}).drop("_d", "_before")


SLOTS = 7
FULL = (1 << SLOTS) - 1


def _place(mask: int, removed: list[int], policy: str) -> int:
    """Slot for the next add, or -1 when every slot is taken."""
    free = [s_ for s_ in removed if not mask >> s_ & 1]
    if free and policy == "removed_first":
        return free[0]
    if free and policy == "removed_last":
        return free[-1]
    if free and policy == "removed_lowest":
        return min(free)
    for slot in range(SLOTS):
        if not mask >> slot & 1:
            return slot
    return -1


ACTIONS = ("hit", "empty", "add", "overflow")
#: Tracks of so many rows are replayed as one block.
LONG_TRACK = 1 << 16


@lru_cache(maxsize=1 << 16)
def _outcome(mask: int, removals: tuple[int | None, ...], adds: int, policy: str) -> tuple[int, tuple[int, ...]]:
    """One same-time group: removals empty their slot, then adds take slots by policy.

    Gives the mask after it and, for every removal and then every add, 4 x (slot + 1) + action. A removal
    without a slot of the seven finds nothing.
    """
    removed, codes = [], []
    for slot in removals:
        if slot is None or not 0 <= slot < SLOTS:
            codes.append(4 * (-1 if slot is None else slot) + 4 + 1)
            continue
        codes.append(4 * slot + 4 + (0 if mask >> slot & 1 else 1))
        mask &= ~(1 << slot)
        removed.append(slot)
    for _ in range(adds):
        slot = _place(mask, removed, policy)
        codes.append(4 * slot + 4 + (2 if slot >= 0 else 3))
        if slot >= 0:
            mask |= 1 << slot
            if slot in removed:
                removed.remove(slot)
    return mask, tuple(codes)


@lru_cache(maxsize=1 << 17)
def _outcomes(masks: tuple[int, ...], removals: tuple[int | None, ...], adds: int, policies: tuple[str, ...]) -> tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """The masks of all policies after a group, and for each of its rows the codes of all policies."""
    seen = [_outcome(m, removals, adds, p) for m, p in zip(masks, policies)]
    return tuple(after for after, _ in seen), tuple(zip(*[c for _, c in seen]))


@lru_cache(maxsize=4096)
def _group_table(removals: tuple[int | None, ...], adds: int, policies: tuple[str, ...]) -> np.ndarray:
    """The group as a function on states; state 128 p + mask is the mask under policy p."""
    return np.array([(FULL + 1) * k + _outcome(m, removals, adds, p)[0] for k, p in enumerate(policies) for m in range(FULL + 1)], np.int32)


def _same_time_groups(batches, spot: Sequence[str], t: str):
    """Batches of whole same-time groups of (spot, t) with the bounds of the groups; an open group waits for the next batch."""
    held = None
    for batch in chain(batches, [None]):
        if batch is None:
            rows, last = held, True
        else:
            rows, last = pa.Table.from_batches([batch]), False
            rows = rows if held is None else pa.concat_tables([held, rows])
        if rows is None or not rows.num_rows:
            continue
        heads = list(zip(*[rows.column(c).to_pylist() for c in (*spot, t)]))
        cuts = [0, *[k for k in range(1, len(heads)) if heads[k] != heads[k - 1]], len(heads)]
        if not last:
            held = rows.slice(cuts[-2])
            rows, cuts, heads = rows.slice(0, cuts[-2]), cuts[:-1], heads[:cuts[-2]]
        if len(cuts) > 1:
            yield rows, cuts, heads


def _start_states(tables: DataFrame, n_policies: int, fan_in: int) -> DataFrame:
    """(_key, _blk, _states): the state of every policy before each block, from the tables of the blocks.

    A tree scan: ``fan_in`` neighbouring tables are composed into one until a track has no more than that
    many; the states then go down the same tree. No row ever holds more than ``fan_in`` tables.
    """
    levels = [cut_lineage(tables)]

    def most(level: DataFrame) -> int:
        return level.groupBy("_key").count().agg(F.max("count")).first()[0] or 0

    def gathered(level: DataFrame, *keys) -> DataFrame:
        return level.groupBy("_key", *keys).agg(F.array_sort(F.collect_list(F.struct("_blk", "_table"))).alias("_t"))

    while most(levels[-1]) > fan_in:
        grouped = gathered(levels[-1], F.floor(F.col("_blk") / fan_in).alias("_up"))
        whole = F.aggregate(
            F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), F.element_at("_t", 1)["_table"], lambda acc, b: F.transform(acc, lambda m: F.element_at(b["_table"], m + 1))
        )
        levels.append(cut_lineage(grouped.select("_key", F.col("_up").alias("_blk"), whole.alias("_table"))))

    def walked(grouped: DataFrame, start) -> DataFrame:
        none = F.array().cast("array<struct<_blk:bigint,_states:array<int>>>")
        walk = F.aggregate(
            "_t", F.struct(start.alias("now"), none.alias("out")),
            lambda acc, b: F.struct(
                F.transform(acc["now"], lambda m: F.element_at(b["_table"], m + 1)).alias("now"), F.concat(acc["out"], F.array(F.struct(b["_blk"].alias("_blk"), acc["now"].alias("_states")))).alias("out")
            ),
            lambda acc: acc["out"],
        )
        return grouped.select("_key", F.explode(walk).alias("_o")).select("_key", "_o._blk", "_o._states")

    states = walked(gathered(levels[-1]), F.array(*[F.lit((FULL + 1) * k) for k in range(n_policies)]))
    for level in reversed(levels[:-1]):
        up = states.select("_key", F.col("_blk").alias("_up"), "_states")
        states = walked(gathered(level, F.floor(F.col("_blk") / fan_in).alias("_up")).join(up, ["_key", "_up"]), F.col("_states"))
    return states


def _slot_replay(df, keys, t: str, order, block: Column, is_add: Column, slot: str, policies: Sequence[str], fan_in: int, long: int, final: bool) -> DataFrame:
    """Rows with ``_codes``, their outcome under every policy; with ``final`` (keys, _blk, _masks), the masks after every block.

    Which slots are taken is a 7-bit mask. A track of at most ``long`` rows is one block that starts empty. A block of a
    longer one is a function on 128 masks for each policy: 1) every (track, block) tabulates that function, 2) a tree
    scan over the tables of a track gives each block its start masks, 3) every block replays with them, all policies
    at once. A long track thus spreads over its blocks; blocks never split a time.
    """
    keys, order, policies = list(keys), list(order), tuple(policies)
    base = df.withColumns({"_blk": block.cast("long"), "_add": is_add, "_slot": F.col(slot).cast("int")})
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    group = [*keys, "_blk"]
    # removals of a time run before its adds
    sort = [t, "_add", *[c for c in order if c != t]]
    out_cols = list(dict.fromkeys([*keys, *order]))
    rows = base.select(*dict.fromkeys([*group, *sort, *out_cols, "_slot"])).withColumn("_key", F.struct(*keys))
    many = cut_lineage(df.groupBy(F.struct(*keys).alias("_key")).count().filter(F.col("count") > long).select("_key", F.lit(True).alias("_many")))

    def placed(frame: DataFrame) -> DataFrame:
        return frame.repartition(*group).sortWithinPartitions(*group, *sort)

    def parts(rows: pa.Table, cuts: list[int]):
        adds, slots = rows.column("_add").to_pylist(), rows.column("_slot").to_pylist()
        for a, b in zip(cuts, cuts[1:]):
            n = sum(map(bool, adds[a:b]))
            yield a, b, tuple(slots[a:b - n]), n

    def tabulate(batches):
        head, now, identity = None, None, np.arange((FULL + 1) * len(policies), dtype=np.int32)

        def made(done, kinds_):
            arrays = [pa.array(c, k) for c, k in zip(zip(*[h for h, _ in done]), kinds_)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([n for _, n in done], pa.list_(pa.int32()))], names=[*group, "_table"])

        types = None
        for rows_, cuts, heads in _same_time_groups(batches, group, t):
            types, done = [rows_.schema.field(c).type for c in group], []
            for a, _, removals, adds in parts(rows_, cuts):
                if heads[a][:-1] != head:
                    if head is not None:
                        done.append((head, now))
                    head, now = heads[a][:-1], identity
                now = _group_table(removals, adds, policies)[now]
            if done:
                yield made(done, types)
        if head is not None:
            yield made([(head, now)], types)

    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in group)
    if many.limit(1).count():
        rows = rows.join(many, "_key", "left").withColumn("_blk", F.when(F.col("_many"), F.col("_blk")).otherwise(F.lit(0).cast("long")))
        tables = placed(rows.filter("_many").drop("_key", "_many")).mapInArrow(tabulate, f"{ddl}, _table array<int>")
        states = _start_states(tables.select(F.struct(*keys).alias("_key"), "_blk", "_table"), len(policies), fan_in)
        rows = rows.drop("_many").join(states, ["_key", "_blk"], "left")
    else:
        rows = rows.withColumns({"_blk": F.lit(0).cast("long"), "_states": F.lit(None).cast("array<int>")})

    def replay(batches):
        head, masks, types = None, (), None
        for rows_, cuts, heads in _same_time_groups(batches, group, t):
            starts, codes, ended = rows_.column("_states"), [], []
            types = [rows_.schema.field(c).type for c in group]
            for a, _, removals, adds in parts(rows_, cuts):
                if heads[a][:-1] != head:
                    if head is not None:
                        ended.append((*head, masks))
                    head, masks = heads[a][:-1], tuple(m & FULL for m in starts[a].as_py() or [0] * len(policies))
                masks, now = _outcomes(masks, removals, adds, policies)
                codes += now
            if not final:
                done = rows_.select(out_cols).append_column("_codes", pa.array(codes, pa.list_(pa.int32())))
                yield from done.combine_chunks().to_batches()
            elif ended:
                yield at_end(ended, types)
        if final and head is not None:
            yield at_end([(*head, masks)], types)

    def at_end(ended, types):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ended), [*types, pa.list_(pa.int32())])], names=[*group, "_masks"])

    staged = placed(rows.drop("_key"))
    return staged.mapInArrow(replay, f"{ddl}, _masks array<int>" if final else ", ".join([*[f"`{c}` {kinds[c]}" for c in out_cols], "_codes array<int>"]))


def slot_fold(df, keys, t: str, order, block: Column, is_add: Column, slot: str, policies: Sequence[str], fan_in: int = 64, long: int = LONG_TRACK) -> DataFrame:
    """Slot of every add and removal under each 7-slot placement policy, in parallel: keys, order, policy, action, at_slot.

    Null keys count as equal; a removal without a slot finds nothing.
    """
    out_cols = list(dict.fromkeys([*keys, *order]))
    replayed = _slot_replay(df, keys, t, order, block, is_add, slot, policies, fan_in, long, False)
    code = F.col("_c")
    return replayed.select(*out_cols, F.posexplode("_codes").alias("_p", "_c")).select(
        *out_cols, F.element_at(F.array(*[F.lit(p) for p in policies]), F.col("_p") + 1).alias("policy"),
        F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.pmod(code, F.lit(4)) + 1).alias("action"), (F.floor(code / 4) - 1).cast("int").alias("at_slot"),
    )


def final_slots(df, keys, t: str, order, block: Column, is_add: Column, slot: str, policies: Sequence[str], fan_in: int = 64, long: int = LONG_TRACK) -> DataFrame:
    """(keys, policy, slot, taken): which of the seven slots of a track are taken at its end, under each policy."""
    ends = _slot_replay(df, keys, t, order, block, is_add, slot, policies, fan_in, long, True)
    last = ends.groupBy(*keys).agg(F.max_by("_masks", "_blk").alias("_masks"))
    named = last.select(*keys, F.posexplode("_masks").alias("_p", "_m")).select(*keys, "_m", F.element_at(F.array(*[F.lit(p) for p in policies]), F.col("_p") + 1).alias("policy"))
    bit = F.expr("shiftright(_m, slot) & 1") == 1
    return named.select(*keys, "policy", "_m", F.explode(F.array(*[F.lit(k) for k in range(SLOTS)])).alias("slot")).select(*keys, "policy", F.col("slot").cast("long").alias("slot"), bit.alias("taken"))


def ledger(events: DataFrame, keys, interval: str, t: str, kind: str, cost: str, gain: str) -> DataFrame:
    """Spend adjustment per interval: same-time purchase cost minus component cost, minus undo gains.

    Incomplete when a purchase group lacks a price or an undo lacks its gain.
    """
    k = F.col(kind)
    at = events.groupBy(*keys, interval, t).agg(
        F.count_if(k == "purchase").alias("_p"),
        F.sum(F.when(k == "purchase", F.col(cost)).when(k == "component", -F.col(cost))).alias("_net"),
        F.count_if(k.isin("purchase", "component") & F.col(cost).isNull()).alias("_gap"),
        F.coalesce(F.sum(F.when(k == "undo", F.col(gain))), F.lit(0)).alias("_undo"),
        F.count_if((k == "undo") & F.col(gain).isNull()).alias("_ug"),
    )
    bought, whole = F.col("_p") > 0, F.col("_gap") == 0
    return at.groupBy(*keys, interval).agg(
        F.sum(F.when(bought & whole, F.col("_net")).otherwise(0) - F.col("_undo")).alias("adjustment"),
        F.bool_and((~bought | whole) & (F.col("_ug") == 0)).alias("complete"),
    )


def rearrangements(snapshots: DataFrame, keys, order: str, slots: str) -> DataFrame:
    """Moves between consecutive snapshots: an item left a slot and turned up in exactly one other."""
    out = o.scan(snapshots, keys, [order], None, {"_b": o.prev(slots)}).filter("_b IS NOT NULL")
    changed = F.filter(
        F.transform(F.arrays_zip(F.col("_b").alias("b"), F.col(slots).alias("a")), lambda z, i: F.struct(i.alias("slot"), z["b"].alias("b"), z["a"].alias("a"))),
        lambda z: z["b"] != z["a"],
    )
    out = out.withColumns({"_c": changed, "same_multiset": F.array_sort("_b") == F.array_sort(slots)})
    moves = F.flatten(
        F.transform(
            "_c",
            lambda c: F.when(
                (c["b"] != 0) & (F.size(F.filter("_c", lambda d: (d["slot"] != c["slot"]) & (d["a"] == c["b"]))) == 1),
                F.transform(
                    F.filter("_c", lambda d: (d["slot"] != c["slot"]) & (d["a"] == c["b"])),
                    lambda d: F.struct(c["b"].alias("item"), c["slot"].alias("from_slot"), d["slot"].alias("to_slot")),
                ),
            ).otherwise(F.array().cast("array<struct<item:bigint,from_slot:int,to_slot:int>>")),
        )
    )
    return out.select(*keys, order, "same_multiset", F.explode(moves).alias("_m")).select(*keys, order, "same_multiset", "_m.*")


def ordered_embeddings(df, keys, domains: str, positions: int, cap: int = 2) -> DataFrame:
    """How many strictly rising picks exist, one position per domain in order, capped; and the earliest."""
    zero = F.lit(0).cast("long")
    start = F.array(F.lit(1).cast("long"), *[zero] * positions)

    def step(acc, ps):
        def reach(p):
            below = F.aggregate(F.slice(acc, 1, p), zero, lambda a, v: a + v)
            return F.when((p >= 1) & F.array_contains(ps, p), F.least(F.lit(cap).cast("long"), below)).otherwise(zero)

        return F.transform(F.sequence(F.lit(0), F.lit(positions)), reach)

    total = F.aggregate(F.aggregate(domains, start, step), zero, lambda a, v: a + v)

    def pick(acc, ps):
        nxt = F.array_min(F.filter(ps, lambda p: p > acc["last"]))
        return F.struct(
            F.coalesce(nxt, F.lit(positions + 1)).alias("last"), F.concat(acc["got"], F.array(nxt)).alias("got")
        )

    greedy = F.aggregate(
        domains, F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("got")), pick, lambda a: a["got"]
    )
    found = F.size(F.filter(greedy, lambda v: v.isNull())) == 0
    return df.select(*keys, F.least(total, F.lit(cap).cast("long")).alias("embeddings"), F.when(found, F.array_join(F.transform(greedy, lambda v: v.cast("string")), ",")).alias("earliest"))


def undo_linkage(sales, undos, keys, t: str, ident: str, item: str, max_age: int, block_ms=None) -> DataFrame:
    """Undo → the one candidate item among fresh sales that occurs exactly once in the undo's records.

    ``undos`` has one row per (undo, record item) with that item's count ``n`` and the truth.
    """
    fresh = tj.within(
        undos.select(*keys, t, ident, item, "n", "truth"), sales.select(*keys, t, item), keys, t, max_age
    )
    ok = (F.col(f"r_{t}") <= F.col(t)) & (F.col(f"r_{item}") == F.col(item)) & (F.col("n") == 1)
    found = fresh.filter(ok).groupBy(*keys, ident).agg(F.count_distinct(item).alias("_d"), F.max(item).alias("_i"))
    base = undos.groupBy(*keys, ident).agg(F.max("truth").alias("truth"))
    out = base.join(found, [*keys, ident], "left")
    pick = F.when(F.col("_d") == 1, F.col("_i"))
    return out.select(
        *keys, ident, pick.alias("candidate"),
        F.when(pick.isNull(), "unavailable").when(pick == F.col("truth"), "exact").otherwise("wrong").alias("validation"),
    )


def grammar_check(df, keys, order, block, token: str, allowed: Sequence[tuple[str, str]], first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """Regular grammar by allowed neighbours, first and last tokens; no run is collected."""
    out = o.scan(df, keys, order, block, {"_p": o.prev(token), "_n": o.following(token)})
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    step = F.col("_p").isNull() | F.array_contains(pairs, F.concat_ws(">", "_p", token))
    head = F.col("_p").isNotNull() | F.col(token).isin(*first)
    tail = F.col("_n").isNotNull() | F.col(token).isin(*last)
    return out.groupBy(*keys).agg(
        F.count("*").alias("tokens"), F.count_if(~step).alias("bad_steps"),
        F.bool_and(step & head & tail).alias("exact"),
    )


def closure(edges: DataFrame, child: str, parent: str, max_rounds: int = 32) -> DataFrame:
    """All (node, ancestor) pairs, doubling the covered distance every round.

    Only the newest pairs are extended, by everything known so far, so a hierarchy of depth d
    needs about log2(d) rounds. Checkpoints cut the lineage: a lost executor replays one round.
    """
    from eventloom.session import cut_lineage

    newest = cut_lineage(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct())
    known = newest
    for _ in range(max_rounds):
        step = known.select(F.col("node").alias("mid"), "ancestor")
        reach = newest.withColumnRenamed("ancestor", "mid").join(step, "mid").select("node", "ancestor").distinct()
        newest = cut_lineage(reach.join(known, ["node", "ancestor"], "left_anti"))
        if newest.isEmpty():
            return known
        known = known.unionByName(newest)
    raise ValueError("hierarchy deeper than max_rounds")
