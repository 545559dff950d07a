"""Series statistics, comparison and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import ordered as o
from eventloom.operators import quantiles as q
from eventloom.session import cut_lineage

# fixed values: scoring weights, gates and scales
OVERLAP_FULL, UNIQUE_FULL = 16, 12
MAX_SPEED = 1200
MAP_BOUND = 15000.0
MAP_DIAGONAL = (MAP_BOUND**2 + MAP_BOUND**2) ** 0.5


def within_correlation(df: DataFrame, keys, entity, x: str, y: str) -> DataFrame:
    """Correlation after removing each entity's mean, from per-entity moments."""
    keys = list(keys)
    n = F.count("*")
    per = df.groupBy(*keys, *entity).agg(
        n.alias("n"),
        (F.covar_pop(x, y) * n).alias("sxy"),
        (F.var_pop(x) * n).alias("sxx"),
        (F.var_pop(y) * n).alias("syy"),
        s.pearson_zero(x, y).alias("r"),
    )
    big, four = F.col("n") >= 2, F.col("n") >= 4
    xx, yy = F.sum(F.when(big, F.col("sxx"))), F.sum(F.when(big, F.col("syy")))
    return per.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.when(big, F.col("sxy"))), F.sqrt(xx * yy)), F.lit(0.0)).alias("within"),
        F.coalesce(F.avg(F.when(four, F.abs("r"))), F.lit(0.0)).alias("mean_abs_entity"),
    )


def differences(df: DataFrame, keys, order, block, cols: Sequence[str], t: str | None = None) -> DataFrame:
    """Add ``d_<c>`` first differences along the order (null on the first row)."""
    want = [*cols, t] if t else list(cols)
    out = o.scan(df, keys, order, block, {f"_p_{c}": o.prev(c) for c in want})
    out = out.withColumns({f"d_{c}": F.col(c) - F.col(f"_p_{c}") for c in want})
    return out.drop(*[f"_p_{c}" for c in want])


def difference_correlation(df, keys, entity, order, block, x, y) -> DataFrame:
    d = differences(df, [*keys, *entity], order, block, [x, y])
    return d.groupBy(*keys).agg(s.pearson_zero(f"d_{x}", f"d_{y}").alias("difference_correlation"))


def monotonic_agreement(df, keys, order, block, x, y) -> DataFrame:
    """Share of steps where both series move the same way; 1 without steps."""
    d = differences(df, keys, order, block, [x, y])
    same = F.when(F.col(f"d_{x}").isNotNull(), F.when(s.same_direction(f"d_{x}", f"d_{y}"), 1.0).otherwise(0.0))
    return d.groupBy(*keys).agg(F.coalesce(F.avg(same), F.lit(1.0)).alias("agreement"))


def spearman(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    ranked = q.average_ranks(q.average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(s.pearson_null("_rx", "_ry").alias("spearman"))


def affine_fit(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Fit plus mean absolute error; the error needs the fit, so it is joined back."""
    fit = df.groupBy(*keys).agg(s.affine(x, y).alias("fit"))
    back = df.join(fit, list(keys))
    miss = F.abs(F.col("fit.slope") * F.col(x) + F.col("fit.intercept") - F.col(y))
    mae = back.groupBy(*keys).agg(F.avg(miss).alias("mae"))
    return fit.select(*keys, "fit.*").join(mae, list(keys))


def score_match(pairs: DataFrame, keys, order, block, raw: str, target: str, min_overlap: int, limits: dict) -> DataFrame:
    """Scalar match score and validator of a candidate series against a target series.

    ``pairs`` holds the raw value and the target interpolated at the same time. ``limits``:
    monotonic, min_correlation, max_nrmse.
    """
    keys = list(keys)
    pairs = pairs.select(*dict.fromkeys([*keys, *order, raw, target]))
    # fit and step statistics both read the aligned pairs: align once, keep them on shared storage
    steps = cut_lineage(differences(pairs, keys, order, block, [raw, target]))
    fit = steps.groupBy(*keys).agg(
        s.affine(raw, target).alias("fit"),
        s.pearson_zero(raw, target).alias("_r"),
        (F.var_pop(raw) * F.count(raw)).alias("_sxx"),
        F.count_distinct(raw).alias("unique_values"),
    )
    fit = fit.filter((F.col("fit.n") >= min_overlap) & (F.col("fit.rmse") < float("inf")))
    rows = steps.join(fit.select(*keys, F.col("fit.slope").alias("_slope")), keys)
    rows = rows.withColumn("d__p", F.col("_slope") * F.col(f"d_{raw}"))
    same = F.when(
        F.col("d__p").isNotNull(), F.when(s.same_direction("d__p", f"d_{target}"), 1.0).otherwise(0.0)
    )
    moves = rows.groupBy(*keys).agg(
        s.pearson_zero("d__p", f"d_{target}").alias("delta_correlation"),
        F.coalesce(F.avg(same), F.lit(1.0)).alias("agreement"),
    )
    out = fit.join(moves, keys)
    slope, nrmse = F.col("fit.slope"), F.col("fit.nrmse")
    # predictions are slope*raw, so their correlation is |r| unless the slope flattens them
    corr = F.when(slope * slope * F.col("_sxx") <= s.VARIANCE_FLOOR, 0.0).otherwise(F.abs("_r"))
    mono = limits["monotonic"]
    falling = (slope < 0) & F.lit(mono)
    shape = 0.5 * s.clamp(corr) + 0.2 * s.clamp("delta_correlation") + 0.3 * (F.col("agreement") if mono else F.lit(0.75))
    base = (
        F.least(F.lit(1.0), F.col("fit.n") / OVERLAP_FULL)
        * F.least(F.lit(1.0), F.col("unique_values") / UNIQUE_FULL)
        / (1 + nrmse)
        * shape
        * F.when(falling, 0.2).otherwise(1.0)
    )
    low_r, high_e = limits["min_correlation"], limits["max_nrmse"]
    validator = (
        F.when(corr < low_r, s.clamp(corr / max(low_r, 1e-6))).otherwise(1.0)
        * F.when(nrmse > high_e, s.clamp(F.lit(high_e) / F.greatest(nrmse, F.lit(1e-6)))).otherwise(1.0)
        * F.when(falling, 0.2).otherwise(1.0)
    )
    return out.select(
        *keys,
        F.col("fit.n").alias("overlap"),
        "unique_values",
        slope.alias("slope"),
        F.col("fit.intercept").alias("intercept"),
        nrmse.alias("nrmse"),
        corr.alias("correlation"),
        "delta_correlation",
        base.alias("score"),
        validator.alias("validator"),
        (base * validator).alias("effective"),
        ((corr >= low_r) & (nrmse <= high_e) & ~falling).alias("passes"),
    )


def step_length(x: str, y: str) -> Column:
    return F.sqrt(F.col(f"d_{x}") * F.col(f"d_{x}") + F.col(f"d_{y}") * F.col(f"d_{y}"))


def trajectory(df: DataFrame, keys, order, block, x: str, y: str) -> DataFrame:
    """Point count, uniqueness at rounded points, displacement, path, ranges and quality."""
    steps = differences(df, keys, order, block, [x, y]).withColumn("_step", step_length(x, y))
    at = F.struct(*[F.col(c) for c in order])
    first = {c: F.min_by(c, at) for c in (x, y)}
    last = {c: F.max_by(c, at) for c in (x, y)}
    out = steps.groupBy(*keys).agg(
        F.count("*").alias("points"),
        (F.count_distinct(s.js_round(x), s.js_round(y)) / F.count("*")).alias("unique_ratio"),
        F.sqrt(F.pow(last[x] - first[x], F.lit(2.0)) + F.pow(last[y] - first[y], F.lit(2.0))).alias("displacement"),
        F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path"),
        (F.max(x) - F.min(x)).alias("x_range"),
        (F.max(y) - F.min(y)).alias("y_range"),
    )
    reach = F.least(F.lit(1.0), (F.col("x_range") + F.col("y_range")) / 6000) * 0.45
    travel = F.least(F.lit(1.0), F.col("path") / 9000) * 0.35
    return out.withColumn("quality", s.clamp(reach + travel + F.col("unique_ratio") * 0.2))


def range_ratio(a: Column, b: Column) -> Column:
    """min(a/b, b/a); 1 when both are flat, 0 when one is."""
    tiny = 1e-6
    flat_a, flat_b = a <= tiny, b <= tiny
    return (
        F.when(flat_a & flat_b, 1.0).when(flat_a | flat_b, 0.0).otherwise(s.clamp(F.least(a / b, b / a)))
    )


def plausibility(df: DataFrame, keys, order, block, t: str, x: str, y: str) -> DataFrame:
    """In-bounds share, plausible-speed share (units per second) and axis ranges."""
    steps = differences(df, keys, order, block, [x, y], t).withColumn("_step", step_length(x, y))
    moved = F.col(f"d_{t}") > 0
    slow = F.when(moved, F.when(F.col("_step") / (F.col(f"d_{t}") / 1000.0) <= MAX_SPEED, 1.0).otherwise(0.0))
    inside = F.col(x).between(0, MAP_BOUND) & F.col(y).between(0, MAP_BOUND)
    return steps.groupBy(*keys).agg(
        s.ratio(inside).alias("bounds_ratio"),
        F.coalesce(F.avg(slow), F.lit(0.0)).alias("speed_ratio"),
        (F.max(x) - F.min(x)).alias("x_range"),
        (F.max(y) - F.min(y)).alias("y_range"),
    )


def evaluate_mapping(pairs: DataFrame, keys, order, block, t, raw, target, prior: str | None = None) -> DataFrame:
    """2-D mapping: per-axis fit, axis and path correlation, distance, plausibility and gates.

    ``raw``/``target`` are (x, y) column names; ``prior`` optionally names a 0..1 transform-prior
    score column constant per key.
    """
    keys = list(keys)
    (rx, ry), (tx, ty) = raw, target
    pairs = pairs.select(*dict.fromkeys([*keys, *order, t, rx, ry, tx, ty, *([prior] if prior else [])]))
    steps = cut_lineage(differences(pairs, keys, order, block, [rx, ry, tx, ty], t))
    fits = steps.groupBy(*keys).agg(
        s.affine(rx, tx).alias("fx"), s.affine(ry, ty).alias("fy"),
        *([F.max(prior).alias("_prior")] if prior else []),
    )
    fits = fits.filter(F.col("fx.n") >= 6)
    st = steps.join(fits, keys).withColumns(
        {
            "px": F.col("fx.slope") * F.col(rx) + F.col("fx.intercept"),
            "py": F.col("fy.slope") * F.col(ry) + F.col("fy.intercept"),
            "d_px": F.col("fx.slope") * F.col(f"d_{rx}"),
            "d_py": F.col("fy.slope") * F.col(f"d_{ry}"),
        }
    )
    st = st.withColumns({"_ps": step_length("px", "py"), "_ts": step_length(tx, ty)})
    gap = F.pow(F.col("px") - F.col(tx), F.lit(2.0)) + F.pow(F.col("py") - F.col(ty), F.lit(2.0))
    inside = F.col("px").between(0, MAP_BOUND) & F.col("py").between(0, MAP_BOUND)
    slow = F.when(
        F.col(f"d_{t}") > 0, F.when(F.col("_ps") / (F.col(f"d_{t}") / 1000.0) <= MAX_SPEED, 1.0).otherwise(0.0)
    )
    span = {c: F.max(c) - F.min(c) for c in ("px", "py", tx, ty)}
    out = st.groupBy(*keys).agg(
        F.count("*").alias("overlap"),
        s.pearson_zero("px", tx).alias("x_correlation"),
        s.pearson_zero("py", ty).alias("y_correlation"),
        s.pearson_zero("_ps", "_ts").alias("path_correlation"),
        F.sqrt(F.avg(gap)).alias("distance_rmse"),
        s.ratio(inside).alias("bounds_ratio"),
        F.coalesce(F.avg(slow), F.lit(0.0)).alias("speed_ratio"),
        F.sqrt(range_ratio(span["px"], span[tx]) * range_ratio(span["py"], span[ty])).alias("range_ratio"),
        s.stddev_zero("_ps").alias("_path_sd"),
    )
    if prior:
        out = out.join(fits.select(*keys, "_prior"), keys)
    low = F.least("x_correlation", "y_correlation")
    axis = s.clamp((F.col("x_correlation") + F.col("y_correlation")) / 2)
    ndist = F.col("distance_rmse") / MAP_BOUND

    def gate(value: Column, limit: float) -> Column:
        return F.when(value < limit, s.clamp(value / limit)).otherwise(1.0)

    validator = (
        gate(axis, 0.45)
        * F.when(ndist > 0.2, s.clamp(F.lit(0.2) / ndist)).otherwise(1.0)
        * gate(F.col("bounds_ratio"), 0.85)
        * gate(F.col("speed_ratio"), 0.75)
        * gate(low, 0.2)
        * gate(F.col("range_ratio"), 0.35)
    )
    blend = (
        0.32 * axis + 0.18 * s.clamp(low) + 0.16 * s.clamp("path_correlation") + 0.16 / (1 + ndist * 6)
        + 0.1 * F.col("bounds_ratio") + 0.08 * F.col("speed_ratio")
    )
    prior_score = F.coalesce(F.col("_prior"), F.lit(0.0)) if prior else F.lit(0.0)
    effective = (
        F.least(F.lit(1.0), F.col("overlap") / 12)
        * s.clamp(F.col("_path_sd") / 1500, 0.2, 1)
        * blend
        * validator
        * (0.7 + 0.15 * prior_score + 0.15 * F.col("range_ratio"))
    )
    passes = (
        (axis >= 0.45) & (low >= 0.2) & (ndist <= 0.2) & (F.col("bounds_ratio") >= 0.85)
        & (F.col("speed_ratio") >= 0.75) & (F.col("range_ratio") >= 0.35)
    )
    return out.withColumns(
        {"normalized_distance": ndist, "validator": validator, "effective": effective, "passes": passes}
    ).drop("_path_sd", "_prior")


def validate_positions(pairs: DataFrame, keys, order, block, ours, target) -> DataFrame:
    """Extracted against oracle positions: correlations, diagonal-normalised distance, pass flag."""
    (ox, oy), (tx, ty) = ours, target
    st = differences(pairs, keys, order, block, [ox, oy, tx, ty])
    st = st.withColumns({"_os": step_length(ox, oy), "_ts": step_length(tx, ty)})
    gap = F.pow(F.col(ox) - F.col(tx), F.lit(2.0)) + F.pow(F.col(oy) - F.col(ty), F.lit(2.0))
    out = st.groupBy(*keys).agg(
        F.count("*").alias("overlap"),
        ((s.pearson_zero(ox, tx) + s.pearson_zero(oy, ty)) / 2).alias("axis_correlation"),
        s.pearson_zero("_os", "_ts").alias("path_correlation"),
        (F.sqrt(F.avg(gap)) / MAP_DIAGONAL).alias("normalized_distance"),
    )
    enough = F.col("overlap") >= 4
    out = out.withColumns(
        {
            "axis_correlation": F.when(enough, F.col("axis_correlation")).otherwise(0.0),
            "path_correlation": F.when(enough, F.col("path_correlation")).otherwise(0.0),
            "normalized_distance": F.when(enough, F.col("normalized_distance")).otherwise(float("inf")),
        }
    )
    passes = (
        enough & (F.col("axis_correlation") >= 0.55) & (F.col("normalized_distance") <= 0.18)
        & (F.col("path_correlation") >= 0.15)
    )
    return out.withColumn("passes", passes)


def event_position_score(fit_rmse: Column, overlap: Column, event_rmse: Column) -> Column:
    """Overlap share times .75 affine closeness + .25 event closeness."""
    affine_part = 1 / (1 + fit_rmse / 500)
    event_part = F.coalesce(1 / (1 + event_rmse / 1000), F.lit(0.15))
    return F.least(F.lit(1.0), overlap / 30) * (0.75 * affine_part + 0.25 * event_part)


def mask_agreement(df: DataFrame, keys, x: str, y: str, threshold: float, upper: bool = False) -> DataFrame:
    """.4 Jaccard + .3 precision + .3 recall of the two series' range-relative tails."""
    keys = list(keys)
    edges = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = df.join(edges, keys)

    def flag(c: str) -> Column:
        span = F.greatest(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(1e-6))
        cut = F.col(f"_lo{c}") + span * threshold
        return (F.col(c) >= cut) if upper else (F.col(c) <= cut)

    a, b = flag(x), flag(y)
    out = rows.groupBy(*keys).agg(
        F.count_if(a & b).alias("_both"), F.count_if(a | b).alias("_any"),
        F.count_if(a).alias("_a"), F.count_if(b).alias("_b"),
    )
    mix = (
        0.4 * F.try_divide(F.col("_both"), F.col("_any"))
        + 0.3 * F.col("_both") / F.greatest("_a", F.lit(1))
        + 0.3 * F.col("_both") / F.greatest("_b", F.lit(1))
    )
    return out.select(*keys, F.when(F.col("_any") == 0, 1.0).otherwise(mix).alias("agreement"))


def confusion(df: DataFrame, keys, predicted: Column, actual: Column) -> DataFrame:
    """tp/fp/fn/tn with precision, recall and F1 (0 when undefined)."""
    out = df.groupBy(*keys).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"),
    )
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    return out.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero)})


def feature_purity(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Weighted majority-label purity of a feature, and how many values are ambiguous."""
    per = df.groupBy(feature, label).agg(F.count("*").alias("n")).groupBy(feature).agg(
        F.sum("n").alias("total"), F.max("n").alias("top"), F.count("*").alias("labels")
    )
    return per.agg(
        F.sum("total").alias("row_count"), F.count("*").alias("distinct_values"),
        F.count_if(F.col("labels") > 1).alias("ambiguous_values"),
        F.try_divide(F.sum("top"), F.sum("total")).alias("weighted_purity"),
    )


def bidirectional_support(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """min(forward, reverse) majority mapping hits between two columns, and the rate."""
    keys = list(keys)
    n = df.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    fwd = n.groupBy(*keys, a).agg(F.max("n").alias("m"), F.sum("n").alias("all")).groupBy(*keys).agg(
        F.sum("m").alias("_f"), F.sum("all").alias("rows"), F.count("*").alias("left_values")
    )
    rev = n.groupBy(*keys, b).agg(F.max("n").alias("m")).groupBy(*keys).agg(
        F.sum("m").alias("_r"), F.count("*").alias("right_values")
    )
    out = fwd.join(rev, keys) if keys else fwd.crossJoin(F.broadcast(rev))
    out = out.withColumn("support", F.least("_f", "_r"))
    return out.withColumn("rate", F.col("support") / F.col("rows")).drop("_f", "_r")


def order_agreement(df: DataFrame, keys, slot: str, expected: str, block: int = 4096) -> DataFrame:
    """Share of slot pairs whose expected order rises too (ties in ``expected`` left out); both are whole numbers.

    Rising pairs are counted bit by bit: two expected values part at one bit, where the smaller has 0 and the
    larger 1 behind the same higher bits. So for every bit, a running sum over the slots of the rows with 0
    is read at the rows with 1. That makes one row per (slot, value, bit) and no pairs; all comparable pairs
    follow from sums of squares. Rows with a null slot or value do not count.
    """
    keys = list(keys)
    whole = (F.col("n") * F.col("n")).cast("decimal(38,0)")
    cells = df.dropna(subset=[slot, expected]).groupBy(*keys, slot, F.col(expected).cast("long").alias("_v")).agg(F.count("*").alias("n"))
    low, high = cells.agg(F.min("_v"), F.max("_v")).first()
    bits = max(1, (high - low).bit_length()) if low is not None else 1
    at = F.explode(F.array(*[F.lit(b) for b in range(bits)])).alias("_bit")
    above = F.expr("shiftright(_d, _bit + 1)")
    digits = cells.select(*keys, slot, (F.col("_v") - F.lit(low or 0)).alias("_d"), "n", at).withColumns({"_up": above, "_one": F.expr("shiftright(_d, _bit) & 1") == 1})
    sides = digits.groupBy(*keys, "_bit", "_up", slot).agg(
        F.coalesce(F.sum(F.when(~F.col("_one"), F.col("n"))), F.lit(0).cast("long")).alias("zeros"), F.coalesce(F.sum(F.when(F.col("_one"), F.col("n"))), F.lit(0).cast("long")).alias("ones")
    )
    run = o.scan(sides, [*keys, "_bit", "_up"], [slot], o.time_block(slot, block), {"_z": o.run_sum("zeros")})
    ordered = run.groupBy(*keys).agg(F.sum(F.col("ones") * (F.col("_z") - F.col("zeros"))).alias("ordered"))

    def squares(*more: str) -> DataFrame:
        return cells.groupBy(*keys, *more).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(whole).alias("s"))

    # pairs of different slots and values: all, less same slot, less same value, plus both the same
    parts = [(squares(), 1), (squares(slot), -1), (squares("_v"), -1), (cells.groupBy(*keys).agg(F.sum(whole).alias("s")), 1)]
    signed = parts[0][0]
    for part, sign in parts[1:]:
        signed = signed.unionByName(part.withColumn("s", F.col("s") * sign))
    comparable = signed.groupBy(*keys).agg((F.sum("s") / 2).cast("long").alias("comparable"))
    out = comparable.join(ordered, keys) if keys else comparable.crossJoin(F.broadcast(ordered))  # one-row sides
    return out.withColumn("rate", F.coalesce(F.try_divide("ordered", "comparable"), F.lit(0.0))).select(*keys, "comparable", "ordered", "rate")
