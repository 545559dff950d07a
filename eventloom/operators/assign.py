"""Slot-to-entity assignment, selection and layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import ordered as o
from eventloom.session import cut_lineage


def edges(matches: DataFrame, group, slot: str, entity: str, score: Column) -> DataFrame:
    """Best score per (group, slot, entity)."""
    return matches.groupBy(*group, slot, entity).agg(F.max(score).alias("score"))


def greedy_assignment(edge: DataFrame, group, slot: str, entity: str) -> DataFrame:
    """Greedy one-to-one assignment by falling score, as rounds of mutual best edges.

    An edge that is the best of both its slot and its entity is exactly what greedy would take
    next, so each round settles all such edges of all groups at once; no group is gathered.
    At most min(slots, entities) rounds are needed.
    """
    from eventloom.session import cut_lineage

    group = list(group)
    spot = F.struct(-F.col("score"), F.col(slot), F.col(entity))
    left, taken = cut_lineage(edge), None
    while True:
        bs = left.groupBy(*group, slot).agg(F.min(spot).alias("_b")).select(*group, slot, F.col(f"_b.{entity}").alias(entity))
        be = left.groupBy(*group, entity).agg(F.min(spot).alias("_b")).select(*group, F.col(f"_b.{slot}").alias(slot), entity)
        won = cut_lineage(left.join(bs, [*group, slot, entity], "left_semi").join(be, [*group, slot, entity], "left_semi"))
        if won.isEmpty():
            return taken if taken is not None else edge.limit(0)
        taken = won if taken is None else cut_lineage(taken.unionByName(won))
        left = left.join(won.select(*group, slot), [*group, slot], "left_anti")
        left = cut_lineage(left.join(won.select(*group, entity), [*group, entity], "left_anti"))


def optimal_assignment(edge: DataFrame, group, slot: str, entity: str) -> DataFrame:
    """Best total score one-to-one, by the Hungarian method at every size; slots may stay empty.

    A group holds at most slots × entities edges because ``edges`` reduced it beforehand.
    """
    group = list(group)
    kinds = {f.name: f.dataType.simpleString() for f in edge.schema.fields}
    cols = [*group, slot, entity, "score"]
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in cols)

    def solve(rows: list[tuple]) -> list[tuple]:
        slots = {v: i for i, v in enumerate(dict.fromkeys(r[-3] for r in rows))}
        names = {v: i for i, v in enumerate(sorted({r[-2] for r in rows}))}
        score = np.full((len(slots), len(names)), -np.inf)
        row_of = {}
        for i, (*_, sl, en, sc) in enumerate(rows):
            score[slots[sl], names[en]] = sc
            row_of[slots[sl], names[en]] = i
        return [rows[row_of[pair]] for pair in best_pairs(score)]

    def run(batches):
        head, held = None, []
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c].tolist() for c in cols]):
                if row[: len(group)] != head:
                    out.extend(solve(held) if held else [])
                    head, held = row[: len(group)], []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=cols)
        if held:
            yield pd.DataFrame(solve(held), columns=cols)

    placed = edge.select(*cols).repartition(*group).sortWithinPartitions(*group, slot, F.desc("score"), entity)
    return placed.mapInPandas(run, ddl)


def best_pairs(score: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one choice of cells with the largest total; -inf marks a missing cell, rows may stay empty.

    Shortest augmenting paths with potentials, O(rows^2 (rows + columns)). Every row has an empty
    column of its own at (almost) zero, so a cell of score zero is preferred to none.
    """
    n, m = score.shape
    edge = np.isfinite(score)
    high = float(np.abs(score[edge]).max(initial=0.0)) + 1.0
    cost = np.full((n, m + n), np.inf)
    cost[:, :m][edge] = -score[edge]
    cost[np.arange(n), m + np.arange(n)] = 1e-12 * high
    row_at = np.full(m + n + 1, -1)  # the last column is the start of every path
    u, v = np.zeros(n), np.zeros(m + n + 1)
    for i in range(n):
        row_at[-1] = i
        col, least, back, done = m + n, np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n + 1, bool)
        while True:
            done[col] = True
            r = row_at[col]
            open_ = ~done[:-1]
            reach = cost[r] - u[r] - v[:-1]
            better = open_ & (reach < least)
            least[better], back[better] = reach[better], col
            nxt = int(np.where(open_, least, np.inf).argmin())
            step = least[nxt]
            held = np.flatnonzero(done)
            u[row_at[held]] += step
            v[held] -= step
            least[open_] -= step
            col = nxt
            if row_at[col] < 0:
                break
        while col != m + n:
            row_at[col] = row_at[back[col]]
            col = back[col]
    return [(int(row_at[c]), c) for c in range(m) if row_at[c] >= 0]


def independent_best(edge: DataFrame, group, slot: str, entity: str) -> DataFrame:
    """Every slot takes its best entity; entities may repeat."""
    return o.best(edge, [*group, slot], [F.desc("score"), F.asc(entity)])


def confidence(assigned: DataFrame, edge: DataFrame, group, slot: str, entity: str, min_gap: float) -> DataFrame:
    """Margin to the best other entity of the slot and the best other slot of the entity, with rank."""
    group = list(group)
    a = assigned.select(*group, slot, entity, F.col("score").alias("assigned_score"))
    rival = edge.select(*group, slot, F.col(entity).alias("_other"), F.col("score").alias("_rs"))
    by_slot = a.join(rival, [*group, slot]).filter(F.col("_other") != F.col(entity)).groupBy(*group, slot, entity).agg(
        F.max("_rs").alias("best_other_entity"),
        (F.count_if(F.col("_rs") > F.col("assigned_score")) + 1).alias("owner_rank"),
    )
    rival = edge.select(*group, entity, F.col(slot).alias("_other"), F.col("score").alias("_rs"))
    by_entity = a.join(rival, [*group, entity]).filter(F.col("_other") != F.col(slot)).groupBy(*group, slot, entity).agg(
        F.max("_rs").alias("best_other_slot")
    )
    out = a.join(by_slot, [*group, slot, entity], "left").join(by_entity, [*group, slot, entity], "left")
    out = out.withColumns(
        {
            "owner_rank": F.coalesce("owner_rank", F.lit(1)), "entity_margin": F.col("assigned_score") - F.col("best_other_entity"),
            "slot_margin": F.col("assigned_score") - F.col("best_other_slot"),
        }
    )
    stable = (F.col("owner_rank") == 1) & (F.col("entity_margin").isNull() | (F.col("entity_margin") >= min_gap))
    return out.withColumn("stable", stable)


# fixed values: component weights of the two score profiles
PROFILES: Mapping[str, Mapping[str, float]] = {
    "default": {
        "team": 0.14, "role": 0.18, "scalar": 0.1, "center": 0.08, "trajectory": 0.12, "min_axis": 0.12, "range": 0.11,
        "support": 0.1, "validator": 0.05, "exact_prior": 0.1, "family_prior": 0.05,
    },
    "reduced-role-anchor": {
        "team": 0.18, "role": 0.08, "scalar": 0.1, "center": 0.08, "trajectory": 0.16, "min_axis": 0.14, "range": 0.12,
        "support": 0.1, "validator": 0.05, "exact_prior": 0.1, "family_prior": 0.05,
    },
}
MAP_SIZE, TEAM_SCALE, ROLE_SCALE, CENTER_SCALE = 15000.0, 4000.0, 3500.0, 8000.0


def distance(x: Column, y: Column, ax: Column, ay: Column) -> Column:
    return F.sqrt(F.pow(x - ax, F.lit(2.0)) + F.pow(y - ay, F.lit(2.0)))


def closeness(d: Column, scale: float) -> Column:
    return 1 / (1 + d / scale)


def mirrored(value: Column, mirror: Column) -> Column:
    """Anchor coordinate, mirrored across the map for the far team."""
    return F.when(mirror, MAP_SIZE - value).otherwise(value)


def position_components(start: tuple[Column, Column], early: tuple[Column, Column], home: tuple[float, float], role: tuple[Column, Column], far_team: Column) -> dict[str, Column]:
    """Team, role and centre closeness of a trajectory's first points."""
    hx, hy = (mirrored(F.lit(v), far_team) for v in home)
    ox, oy = (mirrored(F.lit(v), ~far_team) for v in home)
    rx, ry = (mirrored(v, far_team) for v in role)
    own, other = distance(*start, hx, hy), distance(*start, ox, oy)
    return {
        "team": s.clamp(closeness(own, TEAM_SCALE) - 0.8 * closeness(other, TEAM_SCALE)),
        "role": closeness(distance(*early, rx, ry), ROLE_SCALE),
        "center": closeness(distance(*early, F.lit(MAP_SIZE / 2), F.lit(MAP_SIZE / 2)), CENTER_SCALE),
    }


def slot_nearness(gap: Column) -> Column:
    """1, .65, .4 or .15 by distance to the nearest known slot."""
    return F.when(gap == 0, 1.0).when(gap == 1, 0.65).when(gap <= 2, 0.4).when(gap <= 4, 0.15).otherwise(0.0)


def entity_quality(axis, min_axis, path, validator, nrmse, range_ratio, bounds, movement) -> Column:
    return s.clamp(
        0.26 * s.clamp(validator) + 0.15 * s.clamp(axis) + 0.16 * s.clamp(min_axis) + 0.12 * s.clamp(path)
        + 0.15 * (1 - s.clamp(nrmse)) + 0.11 * s.clamp(range_ratio) + 0.1 * s.clamp(bounds) + 0.1 * movement
    )


def evidence_gate(quality: Column, min_axis: Column, range_score: Column, path: Column, movement: Column) -> Column:
    def soft(v: Column, limit: float) -> Column:
        return F.when(v < limit, s.clamp(v / limit)).otherwise(1.0)

    trail = F.when(path < 0, 0.2).when(path < 0.1, s.clamp(path / 0.1, 0.35, 1)).otherwise(1.0)
    return soft(quality, 0.55) * soft(min_axis, 0.25) * soft(range_score, 0.4) * trail * soft(movement, 0.2)


def weighted_score(df: DataFrame, components: Mapping[str, Column], quality: Column, gate: Column) -> DataFrame:
    """One row per score profile: weighted components, scaled by quality and gates.

    All components of a profile must be given; a missing one is an error, not a zero.
    """
    missing = {part for weights in PROFILES.values() for part in weights} - set(components)
    if missing:
        raise ValueError(f"no components {sorted(missing)}")
    def total(name: str) -> Column:
        out = F.lit(0.0)
        for part, weight in PROFILES[name].items():
            out = out + weight * components[part]
        return out * (0.45 + 0.55 * quality) * gate

    dim = F.array(*[F.struct(F.lit(p).alias("profile"), total(p).alias("score")) for p in PROFILES])
    return df.withColumn("_p", F.explode(dim)).select(*df.columns, "_p.*")


def transform_similarity(slope: Column, icpt: Column, of_slope: Column, of_icpt: Column) -> Column:
    """0..1 likeness of an affine transform to another, relative to the other; -1 if a number is missing."""
    ss, si = F.greatest(F.abs(of_slope) * 0.5, F.lit(1e-9)), F.greatest(F.abs(of_icpt) * 0.1, F.lit(400.0))
    like = F.sqrt((1 / (1 + F.abs(slope - of_slope) / ss)) * (1 / (1 + F.abs(icpt - of_icpt) / si)))
    return F.when(like.isNull() | F.isnan(like), F.lit(-1.0)).otherwise(like)


def _likeness(x: Column, leader: Column) -> Column:
    """Similarity of two structs (at, a, b); a row is always alike to itself."""
    return F.when(x["at"] == leader["at"], F.lit(1.0)).otherwise(transform_similarity(x["a"], x["b"], leader["a"], leader["b"]))


def _meet(rows: DataFrame, lists: DataFrame, band: Sequence[str], n_leaders: int, most: int = 200_000, salts: int = 32) -> DataFrame:
    """Rows with the lists of their band: broadcast up to ``most`` leaders in all, beyond that over salted parts of the band."""
    if n_leaders <= most:
        return rows.join(F.broadcast(lists), band)
    salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(salts)).cast("int")).join(salted, [*band, "_salt"]).drop("_salt")


def leader_clusters(entries: DataFrame, band, order: Sequence[str], slope: str, icpt: str, minimum: float, first: int = 2048, block: int = 1024) -> DataFrame:
    """Leader clustering: an entry joins the most similar earlier leader, or founds a cluster if none reaches ``minimum``.

    An entry leads if and only if no earlier leader is similar enough to it, so leaders are found in rounds: the
    ``first`` entries left of every band settle among themselves, in order, and all other entries that one of the
    new leaders covers drop out, wherever they lie. A round ends at least ``first`` entries of a band, and
    usually most of it, as a leader covers a whole range of transforms. At the end every entry meets the
    leaders before it in blocks of ``block``. No band is ever gathered; a task holds ``first`` entries of it.

    Entries are ordered by ``order``, then slope and intercept; entries alike in all of these share a cluster.
    A missing or NaN number is similar to nothing. Ties between leaders go to the earlier one. Clusters count
    from 0 in the order of their leaders. Bands with null keys are left out.
    """
    band = list(band)
    cols = list(dict.fromkeys([*band, *order, slope, icpt]))
    at = F.struct(*[F.col(c) for c in dict.fromkeys([*order, slope, icpt])])
    x = F.struct(at.alias("at"), F.col(slope).cast("double").alias("a"), F.col(icpt).cast("double").alias("b"))
    now = cut_lineage(entries.select(*cols).dropna(subset=band).withColumns({"_x": x, "_row": F.monotonically_increasing_id()}))
    left, rounds = now.select(*band, "_x").distinct(), []
    while True:
        heads = o.top_k(left, band, [F.asc("_x.at")], first).groupBy(*band).agg(F.array_sort(F.collect_list("_x")).alias("_h"))
        settled = F.aggregate(
            "_h", F.slice("_h", 1, 0), lambda kept, e: F.when(F.exists(kept, lambda l: _likeness(e, l) >= minimum), kept).otherwise(F.concat(kept, F.array(e)))
        )
        lists = cut_lineage(heads.select(*band, settled.alias("_l")))
        found = lists.agg(F.sum(F.size("_l"))).first()[0]
        if not found:
            break
        rounds.append(lists)
        left = cut_lineage(_meet(left, lists, band, found).filter(~F.exists("_l", lambda l: _likeness(F.col("_x"), l) >= minimum)).drop("_l"))
    if not rounds:
        return now.select(*cols).withColumn("cluster", F.lit(0))
    leaders = rounds[0]
    for lists in rounds[1:]:
        leaders = leaders.unionByName(lists)
    leaders = leaders.select(*band, F.explode("_l").alias("l"))
    leaders = cut_lineage(o.position(leaders.withColumn("_at", F.col("l.at")), band, ["_at"], None, "n").select(*band, "l", (F.col("n") - 1).cast("int").alias("cluster")))
    part = F.floor(F.col("cluster") / block)
    blocks = leaders.groupBy(*band, part.alias("_part")).agg(F.array_sort(F.collect_list(F.struct("cluster", "l"))).alias("_l"))
    n_leaders, last = leaders.agg(F.count("*"), F.max("cluster")).first()
    own = F.col("_x")
    best = F.array_max(F.transform(F.filter("_l", lambda c: c["l"]["at"] <= own["at"]), lambda c: F.struct(_likeness(own, c["l"]).alias("like"), (-c["cluster"]).alias("c"))))
    placed = _meet(now, blocks, band, n_leaders).withColumn("_best", best)
    if last >= block:
        placed = placed.groupBy(*cols, "_row").agg(F.max("_best").alias("_best"))
    return placed.select(*cols, (-F.col("_best.c")).alias("cluster"))


def sibling_bundles(candidates: DataFrame, group, metric: str, slot: str, score: str, radius: int, per_metric: int) -> DataFrame:
    """Best sibling of every other metric within ``radius`` slots of an anchor candidate.

    Candidates are cut to the best few per metric first, so anchors × siblings stay small.
    """
    group = list(group)
    top = o.top_k(candidates, [*group, metric], [F.desc(score), F.asc(slot)], per_metric)
    a = top.select(*group, F.col(metric).alias("anchor_metric"), F.col(slot).alias("anchor_slot"), F.col(score).alias("anchor_score"))
    b = top.select(*group, metric, slot, score)
    near = a.join(b, group).filter((F.col(metric) != F.col("anchor_metric")) & (F.abs(F.col(slot) - F.col("anchor_slot")) <= radius))
    pick = o.best(near, [*group, "anchor_metric", "anchor_slot", metric], [F.abs(F.col(slot) - F.col("anchor_slot")).asc(), F.desc(score), F.asc(slot)])
    out = pick.groupBy(*group, "anchor_metric", "anchor_slot").agg(
        (F.count("*") + 1).alias("metrics"), (F.sum(score) + F.max("anchor_score")).alias("_total"),
        F.least(F.min(slot), F.max("anchor_slot")).alias("band_start"), F.greatest(F.max(slot), F.max("anchor_slot")).alias("band_end"),
    )
    span = F.col("band_end") - F.col("band_start")
    return out.withColumns({"compactness": 1 / (1 + span / max(radius * 2, 1)), "average_score": F.col("_total") / F.col("metrics")}).drop("_total")


def diverse_selection(scored: DataFrame, family: str, score: str, tie: str, cap: int) -> DataFrame:
    """Best of each family first, then alternates, families by their best score; the first ``cap``."""
    ranked = o.top_k(scored, [family], [F.desc(score), F.asc(tie)], cap, "family_rank")
    best = ranked.filter("family_rank = 1").select(family, F.col(score).alias("_best"))
    out = ranked.join(best, family)
    return out.orderBy((F.col("family_rank") > 1).asc(), F.desc("_best"), F.asc(family), F.asc("family_rank")).limit(cap).drop("_best")


def priority_union(sources: Sequence[tuple[str, DataFrame]], key: str, score: str, group, cap: int) -> DataFrame:
    """Union by source priority, first source wins a key, ``cap`` keys per group."""
    out = None
    for rank, (name, df) in enumerate(sources):
        part = df.withColumns({"source": F.lit(name), "_priority": F.lit(rank)})
        out = part if out is None else out.unionByName(part)
    out = o.best(out, [*group, key], [F.asc("_priority"), F.desc(score)])
    return o.top_k(out, group, [F.asc("_priority"), F.desc(score), F.asc(key)], cap).drop("_priority")


def layout_deltas(assigned: DataFrame, group, metric: str, slot: str, priority: Sequence[str]) -> DataFrame:
    """Slot distance of every metric to the group's anchor metric, the first present by priority."""
    group = list(group)
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(metric))
    spot = F.when(rank > 0, F.struct(rank, F.col(slot)))
    anchor = assigned.groupBy(*group).agg(
        F.min_by(metric, spot).alias("anchor_metric"), F.min_by(slot, spot).alias("anchor_slot")
    ).filter("anchor_metric IS NOT NULL")
    return assigned.join(anchor, group).withColumn("delta", F.col(slot) - F.col("anchor_slot"))
