"""Agreement of several views of one position: a primary and a companion record, and the records at removal.

Raw coordinates are whole numbers; a position is the raw pair over a divisor. Every score has a control in
which a row is compared with another row of its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import matching as m


def _distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def divisor_scores(rows: DataFrame, keys, order, block: Column | None, raw: tuple[str, str], oracle: tuple[str, str], divisors: Sequence[int], bound: float, shift: int) -> DataFrame:
    """One row per divisor: share of positions inside 0..bound, raw pairs below 2^16, mean distance to the oracle and of the control.

    The control of a row is the position of the row ``shift`` places on in its key, round the end. Rows
    without an oracle count for the bounds only. ``rank`` puts the highest share first, then the least distance.
    """
    (rx, ry), (ox, oy) = raw, oracle
    paired = m.shuffled_control(rows, keys, order, shift, [rx, ry], block)
    dim = F.explode(F.array(*[F.lit(int(d)) for d in divisors])).alias("divisor")
    own = paired.select(rx, ry, f"control_{rx}", f"control_{ry}", ox, oy, dim)
    x, y, cx, cy = (F.col(c) / F.col("divisor") for c in (rx, ry, f"control_{rx}", f"control_{ry}"))
    inside = (x >= 0) & (x <= bound) & (y >= 0) & (y <= bound)
    seen = F.col(ox).isNotNull() & F.col(oy).isNotNull()
    out = own.groupBy("divisor").agg(
        F.count("*").alias("rows"), F.count_if(inside).alias("in_bounds"), F.count_if((F.col(rx) < 65536) & (F.col(ry) < 65536)).alias("zero_high"),
        F.avg(F.when(seen, _distance(x, y, F.col(ox), F.col(oy)))).alias("oracle_distance"), F.avg(F.when(seen, _distance(cx, cy, F.col(ox), F.col(oy)))).alias("control_distance"),
    ).withColumn("in_bounds_rate", F.col("in_bounds") / F.col("rows"))
    # one row per divisor of a fixed list
    best = F.array_sort(F.collect_list(F.struct((-F.col("in_bounds_rate")).alias("r"), F.coalesce("oracle_distance", F.lit(float("inf"))).alias("d"), "divisor")))
    ranked = out.agg(best.alias("b")).select(F.posexplode("b").alias("rank", "x")).select((F.col("rank") + 1).alias("rank"), F.col("x.divisor").alias("divisor"))
    return out.join(F.broadcast(ranked), "divisor")


def pair_agreement(rows: DataFrame, keys, primary: tuple[str, str], companion: tuple[str, str], divisor: int) -> DataFrame:
    """Per key: rows with both views, how many raw pairs are equal, and the distance between the positions."""
    (px, py), (cx, cy) = primary, companion
    both = rows.dropna(subset=[px, py, cx, cy])
    far = _distance(*[F.col(c) / divisor for c in (px, py, cx, cy)])
    same = (F.col(px) == F.col(cx)) & (F.col(py) == F.col(cy))
    return both.groupBy(*keys).agg(
        F.count("*").alias("decoded"), F.count_if(same).alias("exact"), F.avg(F.when(same, 1.0).otherwise(0.0)).alias("exact_rate"), F.avg(far).alias("distance"), F.max(far).alias("most_distance")
    )


def removal_agreement(candidates: DataFrame, keys, link: str, order: Sequence[str], block: Column | None, placed: dict[str, tuple[str, str]], removed: dict[str, tuple[str, str]], divisor: int) -> DataFrame:
    """Per key: do the records at removal repeat the position of the placement?

    ``candidates`` has one row for each (placement, removal candidate) with the raw pairs of both views of both
    (``primary`` and ``companion`` in ``placed`` and ``removed``); ``link`` numbers the placement. The control
    compares a candidate with the placement of the next link of its key, where there is one.
    """
    keys = list(keys)

    def same(a: tuple[str, str], b: tuple[str, str]) -> Column:
        return F.coalesce((F.col(a[0]) == F.col(b[0])) & (F.col(a[1]) == F.col(b[1])), F.lit(False))

    hit = same(placed["companion"], removed["companion"])
    far = _distance(*[F.col(c) / divisor for c in (*placed["companion"], *removed["companion"])])
    links = candidates.groupBy(*keys, link, *[c for c in order if c != link], *placed["companion"]).agg(F.count("*").alias("_found"), F.count_if(hit).alias("_hits"))
    follow = m.shuffled_control(links, keys, order, 1, list(placed["companion"]), block)
    sizes = links.groupBy(*keys).agg(F.count("*").alias("_links"))
    shuffled = tuple(f"control_{c}" for c in placed["companion"])
    other = follow.join(sizes, keys).filter("_links > 1").select(*keys, link, *shuffled)
    control = candidates.join(other, [*keys, link]).groupBy(*keys).agg(F.count("*").alias("control_candidates"), F.count_if(same(shuffled, removed["companion"])).alias("control_exact"))
    by_row = candidates.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if(hit).alias("companion_exact"), F.count_if(same(placed["primary"], removed["primary"])).alias("primary_exact"), F.avg(far).alias("distance")
    )
    two = F.col("_found") == 2
    by_link = links.groupBy(*keys).agg(
        F.count("*").alias("links"), F.count_if(F.col("_hits") > 0).alias("any_exact"), F.count_if(F.col("_hits") == F.col("_found")).alias("all_exact"),
        F.count_if(two).alias("two_candidates"), F.count_if(two & (F.col("_hits") == 2)).alias("two_both_exact"),
    )
    return by_link.join(by_row, keys).join(control, keys, "left").fillna(0, ["control_candidates", "control_exact"])
