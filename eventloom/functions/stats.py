"""Aggregate expressions with the corpus value conventions.

Every aggregate here is mergeable, so Spark combines map-side and a hot group
costs one partial row per task. ``covar_pop``/``var_pop`` keep centred moments,
which stays exact for large means where raw sums of squares do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANCE_FLOOR = 1e-9
DIRECTION_SLACK = 1e-6


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def both(x, y) -> tuple[Column, Column]:
    """Keep only pairs where both sides are present."""
    x, y = col(x).cast("double"), col(y).cast("double")
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def pearson_zero(x, y) -> Column:
    """Pearson; 0 below three pairs or when a side's sum of squares is at most 1e-9."""
    x, y = both(x, y)
    n = F.count(x)
    sxx, syy = F.var_pop(x) * n, F.var_pop(y) * n
    usable = (n >= 3) & (sxx > VARIANCE_FLOOR) & (syy > VARIANCE_FLOOR)
    return F.when(usable, F.covar_pop(x, y) * n / F.sqrt(sxx * syy)).otherwise(F.lit(0.0))


def pearson_null(x, y) -> Column:
    """Pearson; null below two pairs or when a side does not vary."""
    x, y = both(x, y)
    n = F.count(x)
    vx, vy = F.var_pop(x), F.var_pop(y)
    usable = (n >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (vx > 0) & (vy > 0)
    return F.when(usable, F.covar_pop(x, y) / F.sqrt(vx * vy))


def stddev_zero(x) -> Column:
    """Population deviation, 0 below two values."""
    x = col(x).cast("double")
    return F.when(F.count(x) >= 2, F.stddev_pop(x)).otherwise(F.lit(0.0))


def mean_zero(x) -> Column:
    return F.coalesce(F.avg(col(x).cast("double")), F.lit(0.0))


def median_zero(x) -> Column:
    """Median of a *small* group (summary rows). Use ``operators.quantiles`` on raw rows."""
    return F.coalesce(F.percentile(col(x).cast("double"), 0.5), F.lit(0.0))


def affine(x, y) -> Column:
    """Least squares y = slope*x + intercept as a struct, from one pass of moments.

    Fewer than three pairs: invalid, slope 0, rmse infinite. A constant x: invalid,
    slope 0, intercept = mean(y), rmse = deviation of y.
    """
    x, y = both(x, y)
    n = F.count(x)
    vx, vy, cxy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    flat = vx * n * n < VARIANCE_FLOOR
    slope = F.when(n < 3, F.lit(0.0)).when(flat, F.lit(0.0)).otherwise(cxy / vx)
    intercept = F.when(n < 3, F.lit(0.0)).when(flat, F.avg(y)).otherwise(F.avg(y) - cxy / vx * F.avg(x))
    mse = F.when(flat, vy).otherwise(F.greatest(vy - cxy * cxy / vx, F.lit(0.0)))
    rmse = F.when(n < 3, F.lit(float("inf"))).otherwise(F.sqrt(mse))
    sd = F.when(n >= 2, F.sqrt(vy)).otherwise(F.lit(0.0))
    return F.struct(
        n.alias("n"),
        ((n >= 3) & ~flat).alias("valid"),
        slope.alias("slope"),
        intercept.alias("intercept"),
        rmse.alias("rmse"),
        (rmse / F.greatest(sd, F.lit(1.0))).alias("nrmse"),
        sd.alias("target_sd"),
    )


def same_direction(dx, dy) -> Column:
    """Both differences non-falling or both non-rising, within 1e-6."""
    dx, dy = col(dx), col(dy)
    up = (dx >= -DIRECTION_SLACK) & (dy >= -DIRECTION_SLACK)
    down = (dx <= DIRECTION_SLACK) & (dy <= DIRECTION_SLACK)
    return up | down


def ratio(cond) -> Column:
    """Share of rows where ``cond`` holds; 0 on an empty group."""
    return F.coalesce(F.avg(F.when(cond, 1.0).otherwise(0.0)), F.lit(0.0))


def clamp(x, low=0.0, high=1.0) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(x)))


def js_round(x) -> Column:
    """Half-up toward +infinity, as a long."""
    return F.floor(col(x) + F.lit(0.5)).cast("long")


def count_true(cond) -> Column:
    return F.count(F.when(cond, 1))


def entropy_from_counts(count, total) -> Column:
    """One term of -sum(p log2 p); sum it over the values of a group."""
    p = col(count) / col(total)
    return -F.sum(p * F.log2(p))
