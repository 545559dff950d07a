"""Series statistics, cohorts and corpus totals over the stand-in views."""

from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import ordered as o
from eventloom.operators import quantiles as q
from eventloom.operators import series as sr
from eventloom.operators import timejoin as tj
from eventloom.plans.registry import query
from eventloom.plans.standins import DAY_MS

ORDER = ["t", "event_id"]
ME = ["match_id", "entity"]


def block():
    return o.time_block("t", DAY_MS)


def pz(x, y):
    """SQL for Pearson with the zero convention."""
    n = f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END)"
    sx, sy = f"regr_sxx({y}, {x})", f"regr_syy({y}, {x})"
    return f"(CASE WHEN {n} < 3 OR {sx} <= 1e-9 OR {sy} <= 1e-9 THEN 0.0 ELSE regr_sxy({y}, {x}) / sqrt({sx} * {sy}) END)"


def fit(x, y, what):
    """SQL for one part of the affine fit."""
    n, sxx = f"count({x})", f"regr_sxx({y}, {x})"
    flat = f"{sxx} * {n} < 1e-9"
    if what == "slope":
        return f"(CASE WHEN {n} < 3 OR {flat} THEN 0.0 ELSE regr_slope({y}, {x}) END)"
    if what == "intercept":
        return f"(CASE WHEN {n} < 3 THEN 0.0 WHEN {flat} THEN avg({y}) ELSE regr_intercept({y}, {x}) END)"
    mse = f"(CASE WHEN {flat} THEN var_pop({y}) ELSE greatest(var_pop({y}) - power(covar_pop({y}, {x}), 2) / var_pop({x}), 0.0) END)"
    if what == "rmse":
        return f"(CASE WHEN {n} < 3 THEN 'infinity'::DOUBLE ELSE sqrt({mse}) END)"
    return f"(CASE WHEN {n} < 3 THEN 'infinity'::DOUBLE ELSE sqrt({mse}) / greatest(coalesce(stddev_pop({y}), 0), 1) END)"


DIFF = """WITH d AS (SELECT *, rx - lag(rx) OVER w AS dx, tx - lag(tx) OVER w AS dt FROM {pair}
 WINDOW w AS (PARTITION BY match_id, entity ORDER BY t, event_id))"""


@query("D1_packet_type_catalog", """SELECT packet_type, count(*) AS packets, count(*) FILTER (block_index <> 0) AS nonzero,
 count(DISTINCT len) AS lengths, min(len) AS min_len, max(len) AS max_len FROM {pk} GROUP BY 1""")
def packet_type_catalog(x):
    return x.pk.groupBy("packet_type").agg(
        F.count("*").alias("packets"), F.count_if(F.col("block_index") != 0).alias("nonzero"),
        F.count_distinct("len").alias("lengths"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
    )


@query("D2_family_scan", """WITH f AS (SELECT lang || '-' || source AS family, count(*) AS records, count(DISTINCT doc_id // 50) AS chunks,
 max(doc_id // 50) - min(doc_id // 50) AS span, min(n_chars) AS min_len FROM documents GROUP BY 1 HAVING count(*) >= 5)
SELECT * FROM f ORDER BY records DESC, family LIMIT 20""")
def family_scan(x):
    """Top families by records; minimum records 5. The ranking is the operator's own output."""
    chunk = F.floor(F.col("doc_id") / 50)
    fam = x.documents.groupBy(F.concat_ws("-", "lang", "source").alias("family")).agg(
        F.count("*").alias("records"), F.count_distinct(chunk).alias("chunks"),
        (F.max(chunk) - F.min(chunk)).alias("span"), F.min("n_chars").alias("min_len"),
    )
    return fam.filter("records >= 5").orderBy(F.desc("records"), "family").limit(20)


@query("D3_interval_event_counts", """WITH c AS (SELECT match_id, t // 86400000 AS chunk, entity, count(*) AS n FROM {ev} GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, chunk ORDER BY n DESC, entity) AS rk FROM c)
SELECT match_id, chunk, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (entity = 'purchase'), 0) AS BIGINT) AS purchases,
 CAST(coalesce(sum(n) FILTER (entity = 'error'), 0) AS BIGINT) AS errors,
 string_agg(entity, ',' ORDER BY rk) FILTER (rk <= 4) AS top_types FROM r GROUP BY 1, 2""")
def interval_event_counts(x):
    chunk = tj.bucket("t", DAY_MS).alias("chunk")
    c = x.ev.groupBy("match_id", chunk, "entity").agg(F.count("*").alias("n"))
    totals = c.groupBy("match_id", "chunk").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("entity") == "purchase", F.col("n"))), F.lit(0)).alias("purchases"),
        F.coalesce(F.sum(F.when(F.col("entity") == "error", F.col("n"))), F.lit(0)).alias("errors"),
    )
    top = o.top_k(c, ["match_id", "chunk"], [F.desc("n"), F.asc("entity")], 4, "rk").groupBy("match_id", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "entity"))), lambda v: v["entity"]), ",").alias("top_types")
    )
    return totals.join(top, ["match_id", "chunk"])


@query("D4_top_values", """SELECT entity, k, n, rk AS rank FROM (SELECT entity, k, count(*) AS n, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, k) AS rk
 FROM {ev} GROUP BY 1, 2) WHERE rk <= 5""")
def top_values(x):
    c = x.ev.groupBy("entity", "k").agg(F.count("*").alias("n"))
    return o.top_k(c, ["entity"], [F.desc("n"), F.asc("k")], 5, "rank")


@query("D5_center_and_spread", """WITH m AS (SELECT entity, median(value) AS med, avg(value) AS mean, stddev_pop(value) AS sd FROM {ev} GROUP BY 1),
a AS (SELECT entity, median(abs(value - med)) AS mad FROM {ev} JOIN m USING (entity) GROUP BY 1),
c AS (SELECT entity, k, count(*) AS n FROM {ev} GROUP BY 1, 2),
o AS (SELECT entity, k AS mode, row_number() OVER (PARTITION BY entity ORDER BY n DESC, CAST(k AS VARCHAR)) AS r FROM c)
SELECT entity, R6(med) AS median, R6(mad) AS mad, R6(mean) AS mean, R6(sd) AS stddev, mode FROM m JOIN a USING (entity) JOIN o USING (entity) WHERE r = 1""")
def center_and_spread(x):
    base = x.ev.groupBy("entity").agg(s.mean_zero("value").alias("mean"), s.stddev_zero("value").alias("stddev"))
    mode = q.mode(x.ev, ["entity"], "k").select("entity", "mode")
    return q.median_mad(x.ev, ["entity"], "value").join(base, "entity").join(mode, "entity")


@query("D6_quantiles", """WITH l AS (SELECT entity, list_sort(list(value)) AS v, count(*) AS n FROM {ev} GROUP BY 1)
SELECT e.entity, R6(quantile_cont(value, 0.9)) AS p90, R6(quantile_cont(value, 0.25)) AS p25,
 R6(any_value(v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1])) AS floor50, R6(any_value(v[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1])) AS floor95
 FROM {ev} e JOIN l USING (entity) GROUP BY 1""")
def quantile_summaries(x):
    lin = q.quantiles(x.ev, ["entity"], "value", {"p90": 0.9, "p25": 0.25})
    flo = q.quantiles(x.ev, ["entity"], "value", {"floor50": 0.5, "floor95": 0.95}, floor_index=True)
    return lin.join(flo, "entity")


@query("D7_numeric_summary", """SELECT entity, count(*) AS n, R6(avg(v)) AS mean, R6(min(v)) AS low, R6(max(v)) AS high, count(*) FILTER (v > 1e-6) AS positive,
 count(*) FILTER (v < -1e-6) AS negative, count(*) FILTER (abs(v) <= 1e-6) AS zero FROM (SELECT entity, value - k AS v FROM {ev}) GROUP BY 1""")
def numeric_summary(x):
    v = F.col("value") - F.col("k")
    return x.ev.groupBy("entity").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.count_if(v > 1e-6).alias("positive"), F.count_if(v < -1e-6).alias("negative"), F.count_if(F.abs(v) <= 1e-6).alias("zero"),
    )


@query("D8_pearson", f"""SELECT match_id, entity, R6({pz('value', 'k')}) AS zero_form,
 R6(CASE WHEN count(*) < 2 OR min(value) = max(value) OR min(k) = max(k) THEN NULL ELSE regr_sxy(k, value) / sqrt(regr_sxx(k, value) * regr_syy(k, value)) END) AS null_form
 FROM {{ev}} GROUP BY 1, 2""")
def pearson(x):
    return x.ev.groupBy(*ME).agg(
        s.pearson_zero("value", "k").alias("zero_form"), s.pearson_null("value", "k").alias("null_form")
    )


@query("D9_spearman", """WITH r AS (SELECT entity, rank() OVER (PARTITION BY entity ORDER BY value) + (count(*) OVER (PARTITION BY entity, value) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY entity ORDER BY k) + (count(*) OVER (PARTITION BY entity, k) - 1) / 2.0 AS b FROM {ev})
SELECT entity, R6(corr(a::DOUBLE, b::DOUBLE)) AS spearman FROM r GROUP BY 1""")
def spearman(x):
    return sr.spearman(x.ev, ["entity"], "value", "k")


@query("D10_affine_fit", f"""WITH f AS (SELECT entity, count(*) AS n, {fit('rx', 'tx', 'slope')} AS slope, {fit('rx', 'tx', 'intercept')} AS intercept,
 {fit('rx', 'tx', 'rmse')} AS rmse, {fit('rx', 'tx', 'nrmse')} AS nrmse FROM {{pair}} GROUP BY 1)
SELECT f.entity, n, R6(slope) AS slope, R6(intercept) AS intercept, R6(rmse) AS rmse, R6(nrmse) AS nrmse, R6(avg(abs(slope * rx + intercept - tx))) AS mae
 FROM f JOIN {{pair}} p ON p.entity = f.entity GROUP BY ALL""")
def affine_fit(x):
    return sr.affine_fit(x.pair, ["entity"], "rx", "tx").select("entity", "n", "slope", "intercept", "rmse", "nrmse", "mae")


@query("D11_within_entity_correlation", f"""WITH m AS (SELECT match_id, entity, count(*) AS n, avg(rx) AS mx, avg(tx) AS mt, {pz('rx', 'tx')} AS r FROM {{pair}} GROUP BY 1, 2),
w AS (SELECT p.entity, regr_sxy(tx - mt, rx - mx) / sqrt(regr_sxx(tx - mt, rx - mx) * regr_syy(tx - mt, rx - mx)) AS within
 FROM {{pair}} p JOIN m USING (match_id, entity) WHERE n >= 2 GROUP BY 1)
SELECT entity, R6(any_value(within)) AS within, R6(coalesce(avg(abs(r)) FILTER (n >= 4), 0)) AS mean_abs_entity FROM m JOIN w USING (entity) GROUP BY 1""")
def within_entity_correlation(x):
    return sr.within_correlation(x.pair, ["entity"], ["match_id"], "rx", "tx")


@query("D12_first_difference_correlation", DIFF + f" SELECT entity, R6({pz('dx', 'dt')}) AS difference_correlation FROM d WHERE dx IS NOT NULL GROUP BY 1")
def first_difference_correlation(x):
    return sr.difference_correlation(x.pair, ["entity"], ["match_id"], ORDER, block(), "rx", "tx")


@query("D13_monotonic_agreement", DIFF + """ SELECT match_id, entity, R6(coalesce(avg(CASE WHEN dx IS NULL THEN NULL WHEN (dx >= -1e-6 AND dt >= -1e-6) OR (dx <= 1e-6 AND dt <= 1e-6)
 THEN 1.0 ELSE 0.0 END), 1)) AS agreement FROM d GROUP BY 1, 2""")
def monotonic_agreement(x):
    return sr.monotonic_agreement(x.pair, ME, ORDER, block(), "rx", "tx")


SCORE_CTE = f"""WITH f AS (SELECT match_id, entity, count(*) AS n, {fit('rx', 'tx', 'slope')} AS slope, {fit('rx', 'tx', 'intercept')} AS intercept,
 {fit('rx', 'tx', 'nrmse')} AS nrmse, abs({pz('rx', 'tx')}) AS r, count(DISTINCT rx) AS u, regr_sxx(tx, rx) AS sxx
 FROM {{pair}} GROUP BY 1, 2 HAVING count(*) >= 6),
d AS (SELECT p.match_id, p.entity, slope * (rx - lag(rx) OVER w) AS dx, tx - lag(tx) OVER w AS dt FROM {{pair}} p JOIN f USING (match_id, entity)
 WINDOW w AS (PARTITION BY p.match_id, p.entity ORDER BY t, event_id)),
v AS (SELECT match_id, entity, {pz('dx', 'dt')} AS dc, coalesce(avg(CASE WHEN dx IS NULL THEN NULL
 WHEN (dx >= -1e-6 AND dt >= -1e-6) OR (dx <= 1e-6 AND dt <= 1e-6) THEN 1.0 ELSE 0.0 END), 1) AS mono FROM d GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN slope * slope * sxx <= 1e-9 THEN 0 ELSE r END AS c FROM f JOIN v USING (match_id, entity)),
h AS (SELECT *, least(1, n / 16) * least(1, u / 12) / (1 + nrmse) * (0.5 * least(1, greatest(0, c)) + 0.2 * least(1, greatest(0, dc)) + 0.3 * mono)
  * CASE WHEN slope < 0 THEN 0.2 ELSE 1 END AS base,
 CASE WHEN c < 0.5 THEN least(1, greatest(0, c / 0.5)) ELSE 1 END * CASE WHEN nrmse > 0.9 THEN least(1, greatest(0, 0.9 / greatest(nrmse, 1e-6))) ELSE 1 END
  * CASE WHEN slope < 0 THEN 0.2 ELSE 1 END AS val FROM g)
"""


@query("D14_scalar_match_score", SCORE_CTE + """SELECT match_id, entity, n AS overlap, u AS unique_values, R6(slope) AS slope, R6(intercept) AS intercept, R6(nrmse) AS nrmse,
 R6(c) AS correlation, R6(dc) AS delta_correlation, R6(base) AS score, R6(val) AS validator, R6(base * val) AS effective,
 c >= 0.5 AND nrmse <= 0.9 AND NOT slope < 0 AS passes FROM h""")
def scalar_match_score(x):
    limits = {"monotonic": True, "min_correlation": 0.5, "max_nrmse": 0.9}
    return sr.score_match(x.pair, ME, ORDER, block(), "rx", "tx", 6, limits)




@query("D15_series_compare", f"""SELECT match_id, R6({pz('rx', 'tx')}) AS correlation, R6(sqrt(avg(power(rx - tx, 2)))) AS rmse,
 R6(sqrt(avg(power(rx - tx, 2))) / greatest(coalesce(stddev_pop(tx), 0), 1)) AS nrmse, count(*) AS points FROM {{pair}} GROUP BY 1""")
def series_compare(x):
    rmse = F.sqrt(F.avg(F.pow(F.col("rx") - F.col("tx"), F.lit(2.0))))
    return x.pair.groupBy("match_id").agg(
        s.pearson_zero("rx", "tx").alias("correlation"), rmse.alias("rmse"),
        (rmse / F.greatest(s.stddev_zero("tx"), F.lit(1.0))).alias("nrmse"), F.count("*").alias("points"),
    )


@query("D16_trajectory_stats", """WITH p AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY match_id) AS n, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step
 FROM {tgt} WINDOW w AS (PARTITION BY match_id ORDER BY t, event_id)),
g AS (SELECT match_id, count(*) AS points, count(DISTINCT (floor(x + 0.5), floor(y + 0.5))) / count(*) AS unique_ratio,
 sqrt(power(max(x) FILTER (i = n) - max(x) FILTER (i = 1), 2) + power(max(y) FILTER (i = n) - max(y) FILTER (i = 1), 2)) AS displacement,
 coalesce(sum(step), 0) AS path, max(x) - min(x) AS x_range, max(y) - min(y) AS y_range FROM p GROUP BY 1)
SELECT match_id, points, R6(unique_ratio) AS unique_ratio, R6(displacement) AS displacement, R6(path) AS path, R6(x_range) AS x_range, R6(y_range) AS y_range,
 R6(least(1, greatest(0, least(1, (x_range + y_range) / 6000) * 0.45 + least(1, path / 9000) * 0.35 + unique_ratio * 0.2))) AS quality FROM g""")
def trajectory_stats(x):
    return sr.trajectory(x.tgt, ["match_id"], ORDER, block(), "x", "y")


PLAUS = """WITH p AS (SELECT *, t - lag(t) OVER w AS dt, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step
 FROM {tgt} WINDOW w AS (PARTITION BY match_id ORDER BY t, event_id))"""


@query("D17_plausibility_ratios", PLAUS + """ SELECT match_id, R6(avg(CASE WHEN x BETWEEN 0 AND 15000 AND y BETWEEN 0 AND 15000 THEN 1.0 ELSE 0 END)) AS bounds_ratio,
 R6(coalesce(avg(CASE WHEN dt > 0 THEN CASE WHEN step / (dt / 1000.0) <= 1200 THEN 1.0 ELSE 0 END END), 0)) AS speed_ratio,
 R6(CASE WHEN max(x) - min(x) <= 1e-6 AND max(y) - min(y) <= 1e-6 THEN 1 WHEN max(x) - min(x) <= 1e-6 OR max(y) - min(y) <= 1e-6 THEN 0
  ELSE least((max(x) - min(x)) / (max(y) - min(y)), (max(y) - min(y)) / (max(x) - min(x))) END) AS range_ratio FROM p GROUP BY 1""")
def plausibility_ratios(x):
    out = sr.plausibility(x.tgt, ["match_id"], ORDER, block(), "t", "x", "y")
    return out.select("match_id", "bounds_ratio", "speed_ratio", sr.range_ratio(F.col("x_range"), F.col("y_range")).alias("range_ratio"))


D18_SQL = f"""WITH f AS (SELECT match_id, entity, count(*) AS n, {fit('rx', 'tx', 'slope')} AS sx, {fit('rx', 'tx', 'intercept')} AS ix,
 {fit('ry', 'ty', 'slope')} AS sy, {fit('ry', 'ty', 'intercept')} AS iy FROM {{pair}} GROUP BY 1, 2 HAVING count(*) >= 6),
p AS (SELECT match_id, entity, t, event_id, sx * rx + ix AS px, sy * ry + iy AS py, tx, ty FROM {{pair}} JOIN f USING (match_id, entity)),
d AS (SELECT *, t - lag(t) OVER w AS dt, sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)) AS ps,
 sqrt(power(tx - lag(tx) OVER w, 2) + power(ty - lag(ty) OVER w, 2)) AS ts FROM p WINDOW w AS (PARTITION BY match_id, entity ORDER BY t, event_id)),
r AS (SELECT match_id, entity, max(px) - min(px) AS pxr, max(py) - min(py) AS pyr, max(tx) - min(tx) AS txr, max(ty) - min(ty) AS tyr,
 {pz('px', 'tx')} AS xc, {pz('py', 'ty')} AS yc, {pz('ps', 'ts')} AS pc, count(*) AS n, sqrt(avg(power(px - tx, 2) + power(py - ty, 2))) AS dist,
 avg(CASE WHEN px BETWEEN 0 AND 15000 AND py BETWEEN 0 AND 15000 THEN 1.0 ELSE 0 END) AS bounds,
 coalesce(avg(CASE WHEN dt > 0 THEN CASE WHEN ps / (dt / 1000.0) <= 1200 THEN 1.0 ELSE 0 END END), 0) AS speed,
 CASE WHEN count(ps) >= 2 THEN stddev_pop(ps) ELSE 0 END AS psd FROM d GROUP BY 1, 2),
z AS (SELECT *, (CASE WHEN pxr <= 1e-6 AND txr <= 1e-6 THEN 1 WHEN pxr <= 1e-6 OR txr <= 1e-6 THEN 0 ELSE least(pxr / txr, txr / pxr) END) AS rx2,
 (CASE WHEN pyr <= 1e-6 AND tyr <= 1e-6 THEN 1 WHEN pyr <= 1e-6 OR tyr <= 1e-6 THEN 0 ELSE least(pyr / tyr, tyr / pyr) END) AS ry2, least(xc, yc) AS lo,
 least(1, greatest(0, (xc + yc) / 2)) AS ax, dist / 15000 AS nd FROM r),
y AS (SELECT *, sqrt(rx2 * ry2) AS rr FROM z),
w AS (SELECT *, CASE WHEN ax < 0.45 THEN ax / 0.45 ELSE 1 END * CASE WHEN nd > 0.2 THEN 0.2 / nd ELSE 1 END * CASE WHEN bounds < 0.85 THEN bounds / 0.85 ELSE 1 END
 * CASE WHEN speed < 0.75 THEN speed / 0.75 ELSE 1 END * CASE WHEN lo < 0.2 THEN greatest(0, lo / 0.2) ELSE 1 END * CASE WHEN rr < 0.35 THEN rr / 0.35 ELSE 1 END AS val FROM y)
SELECT match_id, entity, n AS overlap, R6(xc) AS x_correlation, R6(yc) AS y_correlation, R6(pc) AS path_correlation, R6(dist) AS distance_rmse, R6(nd) AS normalized_distance,
 R6(bounds) AS bounds_ratio, R6(speed) AS speed_ratio, R6(rr) AS range_ratio, R6(val) AS validator,
 R6(least(1, n / 12) * least(1, greatest(0.2, psd / 1500)) * (0.32 * ax + 0.18 * least(1, greatest(0, lo)) + 0.16 * least(1, greatest(0, pc)) + 0.16 / (1 + nd * 6)
  + 0.1 * bounds + 0.08 * speed) * val * (0.7 + 0.15 * rr)) AS effective,
 ax >= 0.45 AND lo >= 0.2 AND nd <= 0.2 AND bounds >= 0.85 AND speed >= 0.75 AND rr >= 0.35 AS passes FROM w"""


@query("D18_mapping_evaluation", D18_SQL)
def mapping_evaluation(x):
    return sr.evaluate_mapping(x.pair, ME, ORDER, block(), "t", ("rx", "ry"), ("tx", "ty"))


@query("D19_position_validation", f"""WITH p AS (SELECT match_id, entity, t, event_id, 100 * rx AS ox, 150 * ry AS oy, tx, ty FROM {{pair}}),
d AS (SELECT *, sqrt(power(ox - lag(ox) OVER w, 2) + power(oy - lag(oy) OVER w, 2)) AS os, sqrt(power(tx - lag(tx) OVER w, 2) + power(ty - lag(ty) OVER w, 2)) AS ts
 FROM p WINDOW w AS (PARTITION BY match_id, entity ORDER BY t, event_id)),
r AS (SELECT match_id, entity, count(*) AS n, ({pz('ox', 'tx')} + {pz('oy', 'ty')}) / 2 AS ax, {pz('os', 'ts')} AS pc,
 sqrt(avg(power(ox - tx, 2) + power(oy - ty, 2))) / sqrt(2 * power(15000, 2)) AS nd FROM d GROUP BY 1, 2)
SELECT match_id, entity, n AS overlap, R6(CASE WHEN n < 4 THEN 0 ELSE ax END) AS axis_correlation, R6(CASE WHEN n < 4 THEN 0 ELSE pc END) AS path_correlation,
 R6(CASE WHEN n < 4 THEN 'infinity'::DOUBLE ELSE nd END) AS normalized_distance, n >= 4 AND ax >= 0.55 AND nd <= 0.18 AND pc >= 0.15 AS passes FROM r""")
def position_validation(x):
    p = x.pair.withColumns({"ox": 100 * F.col("rx"), "oy": 150 * F.col("ry")})
    return sr.validate_positions(p, ME, ORDER, block(), ("ox", "oy"), ("tx", "ty"))


@query("D20_event_position_score", f"""WITH a AS (SELECT match_id, entity, count(*) AS n, sqrt(power({fit('rx', 'tx', 'rmse')}, 2) + power({fit('ry', 'ty', 'rmse')}, 2)) AS r FROM {{pair}} GROUP BY 1, 2 HAVING count(*) >= 8),
c AS (SELECT match_id, entity, event_id, t, rx, ry FROM {{pair}}), e AS (SELECT match_id, event_id, t, tx, ty FROM {{pair}} WHERE entity = 'error'),
j AS (SELECT e.match_id, c.entity, e.event_id, abs(c.t - e.t) AS d, c.t, c.event_id AS cid, power(rx - tx, 2) + power(ry - ty, 2) AS q
 FROM e JOIN c ON e.match_id = c.match_id AND abs(c.t - e.t) <= 3600000),
b AS (SELECT match_id, entity, sqrt(avg(q)) AS er, count(*) AS event_matches FROM (SELECT *, row_number() OVER (PARTITION BY match_id, entity, event_id ORDER BY d, t DESC, cid DESC) AS rn FROM j) WHERE rn = 1 GROUP BY 1, 2),
s AS (SELECT a.match_id, a.entity, n AS overlap, coalesce(event_matches, 0) AS event_matches, least(1, n / 30) * (0.75 / (1 + r / 500) + 0.25 * coalesce(1 / (1 + er / 1000), 0.15)) AS score
 FROM a LEFT JOIN b USING (match_id, entity))
SELECT match_id, entity, overlap, event_matches, R6(score) AS score, row_number() OVER (PARTITION BY match_id ORDER BY score DESC, entity) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY score DESC, entity) <= 12""")
def event_position_score(x):
    """Candidate series against match positions, with the closest sample around each anchor event."""
    p = x.pair
    base = p.groupBy(*ME).agg(F.count("*").alias("overlap"), s.affine("rx", "tx")["rmse"].alias("a"), s.affine("ry", "ty")["rmse"].alias("b"))
    base = base.filter("overlap >= 8").withColumn("r", F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")))
    anchors = p.filter("entity = 'error'").select("match_id", "event_id", "t", "tx", "ty")
    pairs = tj.within(anchors, p.select("match_id", "event_id", "t", "entity", "rx", "ry"), ["match_id"], "t", 3_600_000)
    gap = F.pow(F.col("r_rx") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("r_ry") - F.col("ty"), F.lit(2.0))
    near = pairs.groupBy("match_id", F.col("r_entity").alias("entity"), "event_id").agg(
        F.min_by(gap, F.struct(F.abs(F.col("r_t") - F.col("t")), -F.col("r_t"), -F.col("r_event_id"))).alias("q")
    )
    ev = near.groupBy(*ME).agg(F.sqrt(F.avg("q")).alias("er"), F.count("*").alias("event_matches"))
    out = base.join(ev, ME, "left").withColumn("event_matches", F.coalesce("event_matches", F.lit(0)))
    out = out.withColumn("score", sr.event_position_score(F.col("r"), F.col("overlap"), F.col("er")))
    out = o.top_k(out, ["match_id"], [F.desc("score"), F.asc("entity")], 12, "rank")
    return out.select("match_id", "entity", "overlap", "event_matches", "score", "rank")


@query("D29_enrichment", """WITH c AS (SELECT source, count(*) FILTER (lang = 'en') AS t, count(*) FILTER (lang <> 'en') AS b, count(*) FILTER (lang = 'en' AND n_chars > 3000) AS s FROM documents GROUP BY 1)
SELECT source, R6((t + 1) / (b + 1)) AS enrichment, t > 0 AND b = 0 AS target_only, R6(CASE WHEN t = 0 THEN NULL ELSE (s / (SELECT sum(s) FROM c)) / (t / (SELECT sum(t) FROM c)) END) AS specific FROM c""")
def enrichment(x):
    en = F.col("lang") == "en"
    c = x.documents.groupBy("source").agg(
        F.count_if(en).alias("t"), F.count_if(~en).alias("b"), F.count_if(en & (F.col("n_chars") > 3000)).alias("s")
    )
    total = c.agg(F.sum("s").alias("st"), F.sum("t").alias("tt"))
    c = c.crossJoin(F.broadcast(total))  # one-row side
    return c.select(
        "source", ((F.col("t") + 1) / (F.col("b") + 1)).alias("enrichment"), ((F.col("t") > 0) & (F.col("b") == 0)).alias("target_only"),
        F.try_divide(F.col("s") / F.col("st"), F.col("t") / F.col("tt")).alias("specific"),
    )


@query("D30_event_biased_types", """WITH e AS (SELECT *, t // 86400000 AS day FROM {ev}), p AS (SELECT day, match_id FROM e GROUP BY 1, 2),
big AS (SELECT DISTINCT day FROM e GROUP BY day HAVING sum(value) >= 15000),
f AS (SELECT entity, k // 10 AS band, count(DISTINCT day) FILTER (day IN (SELECT day FROM big)) AS hit, count(*) FILTER (day NOT IN (SELECT day FROM big)) AS quiet FROM e GROUP BY 1, 2)
SELECT entity, band, hit AS chunks, quiet, CASE WHEN quiet = 0 THEN 'event_biased' ELSE 'ubiquitous' END AS class FROM f WHERE hit = (SELECT count(*) FROM big)""")
def event_biased_types(x):
    """Families present in every eventful chunk, split by presence in quiet chunks."""
    e = x.ev.withColumns({"day": tj.bucket("t", DAY_MS), "band": F.floor(F.col("k") / 10)})
    big = e.groupBy("day").agg(F.sum("value").alias("v")).filter("v >= 15000").select("day", F.lit(True).alias("hot"))
    total = big.agg(F.count("*").alias("chunks_needed"))
    f = e.join(big, "day", "left").groupBy("entity", "band").agg(
        F.count_distinct(F.when(F.col("hot"), F.col("day"))).alias("chunks"), F.count_if(F.col("hot").isNull()).alias("quiet")
    )
    f = f.crossJoin(F.broadcast(total)).filter("chunks = chunks_needed")  # one-row side
    return f.select("entity", "band", "chunks", "quiet", F.when(F.col("quiet") == 0, "event_biased").otherwise("ubiquitous").alias("class"))


@query("D31_eventful_quiet_cohorts", """WITH i AS (SELECT match_id, t // 86400000 AS idx, count(*) AS total, 100 * count(*) FILTER (entity = 'purchase') + 80 * count(*) FILTER (entity = 'error')
 + 70 * count(*) FILTER (entity = 'signup') + 10 * count(*) FILTER (entity = 'click') + 5 * count(*) FILTER (entity = 'view') + count(*) AS priority FROM {ev} GROUP BY 1, 2),
a AS (SELECT * FROM i ORDER BY priority DESC, total DESC, match_id, idx LIMIT 40),
b AS (SELECT * FROM i ANTI JOIN a USING (match_id, idx) WHERE idx >= 2 ORDER BY total, priority, match_id, idx LIMIT 40)
SELECT match_id, idx, total, priority, 'eventful' AS cohort FROM a UNION ALL SELECT match_id, idx, total, priority, 'quiet' FROM b""")
def eventful_quiet_cohorts(x):
    weights = {"purchase": 100, "error": 80, "signup": 70, "click": 10, "view": 5}
    score = F.count("*")
    for kind, w in weights.items():
        score = score + w * F.count_if(F.col("entity") == kind)
    i = x.ev.groupBy("match_id", tj.bucket("t", DAY_MS).alias("idx")).agg(F.count("*").alias("total"), score.alias("priority"))
    a = i.orderBy(F.desc("priority"), F.desc("total"), "match_id", "idx").limit(40)
    b = i.join(a.select("match_id", "idx"), ["match_id", "idx"], "left_anti").filter("idx >= 2")
    b = b.orderBy("total", "priority", "match_id", "idx").limit(40)
    return a.withColumn("cohort", F.lit("eventful")).unionByName(b.withColumn("cohort", F.lit("quiet")))


@query("D32_confusion", """WITH c AS (SELECT l.doc_id, n_chars > 2500 AS p, quality = 1 AS a, lang FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM c GROUP BY 1),
h AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rc FROM g)
SELECT lang, tp, fp, fn, tn, R6(pr) AS precision, R6(rc) AS recall, R6(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END) AS f1 FROM h""")
def confusion(x):
    c = x.labels.join(x.documents.select("doc_id", "n_chars", "lang"), "doc_id")
    return sr.confusion(c, ["lang"], F.col("n_chars") > 2500, F.col("quality") == 1)


MASK = """WITH m AS (SELECT *, min(rx) OVER w AS a0, max(rx) OVER w AS a1, min(tx) OVER w AS b0, max(tx) OVER w AS b1 FROM {{pair}} WINDOW w AS (PARTITION BY match_id)),
f AS (SELECT match_id, rx {op} a0 + greatest(a1 - a0, 1e-6) * 0.35 AS a, tx {op} b0 + greatest(b1 - b0, 1e-6) * 0.35 AS b FROM m),
g AS (SELECT match_id, count(*) FILTER (a AND b) AS i, count(*) FILTER (a OR b) AS u, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb FROM f GROUP BY 1)
SELECT match_id, R6(CASE WHEN u = 0 THEN 1 ELSE 0.4 * i / u + 0.3 * i / greatest(na, 1) + 0.3 * i / greatest(nb, 1) END) AS agreement FROM g"""


@query("D33_threshold_mask_agreement", MASK.format(op="<="))
def threshold_mask_agreement(x):
    return sr.mask_agreement(x.pair, ["match_id"], "rx", "tx", 0.35)


@query("D33_upper_tail_agreement", MASK.format(op=">="))
def upper_tail_agreement(x):
    return sr.mask_agreement(x.pair, ["match_id"], "rx", "tx", 0.35, upper=True)


@query("D34_feature_purity", """WITH n AS (SELECT slot_index, participant_id, count(*) AS n FROM {cm} GROUP BY 1, 2),
v AS (SELECT slot_index, sum(n) AS total, max(n) AS top, count(*) AS labels FROM n GROUP BY 1)
SELECT CAST(sum(total) AS BIGINT) AS row_count, count(*) AS distinct_values, count(*) FILTER (labels > 1) AS ambiguous_values, R6(sum(top) / sum(total)) AS weighted_purity FROM v""")
def feature_purity(x):
    return sr.feature_purity(x.cm, "slot_index", "participant_id")


@query("D35_bidirectional_mapping", """WITH n AS (SELECT family_key, slot_index, participant_id, count(*) AS n FROM {cm} GROUP BY 1, 2, 3),
f AS (SELECT family_key, sum(m) AS f, sum(a) AS rows, count(*) AS left_values FROM (SELECT family_key, slot_index, max(n) AS m, sum(n) AS a FROM n GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT family_key, sum(m) AS r, count(*) AS right_values FROM (SELECT family_key, participant_id, max(n) AS m FROM n GROUP BY 1, 2) GROUP BY 1)
SELECT family_key, CAST(rows AS BIGINT) AS rows, left_values, right_values, CAST(least(f, r) AS BIGINT) AS support, R6(least(f, r) / rows) AS rate FROM f JOIN r USING (family_key)""")
def bidirectional_mapping(x):
    return sr.bidirectional_support(x.cm, ["family_key"], "slot_index", "participant_id")


@query("D36_replay_overlap", """WITH s AS (SELECT DISTINCT family_key, metric, match_id FROM {cm} WHERE score >= 0.96),
z AS (SELECT family_key, metric, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT a.family_key, a.metric AS m1, b.metric AS m2, count(*) AS i FROM s a JOIN s b ON a.family_key = b.family_key AND a.match_id = b.match_id AND a.metric < b.metric GROUP BY 1, 2, 3),
q AS (SELECT a.family_key, a.metric AS m1, b.metric AS m2, a.n AS na, b.n AS nb FROM z a JOIN z b ON a.family_key = b.family_key AND a.metric < b.metric)
SELECT family_key, R6(avg(coalesce(i, 0) / (na + nb - coalesce(i, 0)))) AS overlap FROM q LEFT JOIN p USING (family_key, m1, m2) GROUP BY 1""")
def replay_overlap(x):
    """Mean pairwise Jaccard of the match sets per family.

    Only the metric dimension is paired (a handful of names); a match contributes one row
    per metric and the pair counts come from partial aggregation.
    """
    s_ = x.cm.filter("score >= 0.96").select("family_key", "metric", "match_id").distinct()
    n = s_.groupBy("family_key", "metric").agg(F.count("*").alias("n"))
    other = s_.select("family_key", "match_id", F.col("metric").alias("m2"))
    i = s_.join(other, ["family_key", "match_id"]).filter("metric < m2").groupBy("family_key", "metric", "m2").agg(F.count("*").alias("i"))
    q_ = n.join(n.select("family_key", F.col("metric").alias("m2"), F.col("n").alias("n2")), "family_key").filter("metric < m2")
    q_ = q_.join(i, ["family_key", "metric", "m2"], "left").fillna({"i": 0})
    return q_.groupBy("family_key").agg(F.avg(F.col("i") / (F.col("n") + F.col("n2") - F.col("i"))).alias("overlap"))


@query("D37_pairwise_order_score", """WITH r AS (SELECT family_key, slot_index, participant_id, count(*) AS n FROM {cm} GROUP BY 1, 2, 3)
SELECT a.family_key, CAST(sum(a.n * b.n) FILTER (a.participant_id <> b.participant_id) AS BIGINT) AS comparable, CAST(sum(a.n * b.n) FILTER (a.participant_id < b.participant_id) AS BIGINT) AS ordered,
 R6(sum(a.n * b.n) FILTER (a.participant_id < b.participant_id) / sum(a.n * b.n) FILTER (a.participant_id <> b.participant_id)) AS rate
FROM r a JOIN r b ON a.family_key = b.family_key AND a.slot_index < b.slot_index GROUP BY 1""")
def pairwise_order_score(x):
    return sr.order_agreement(x.cm, ["family_key"], "slot_index", "participant_id")


@query("D38_kda_from_events", """WITH r AS (SELECT l_suppkey AS p, 'kill' AS role FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT CAST(round(l_discount * 100) AS BIGINT), 'death' FROM lineitem WHERE l_returnflag = 'A'
 UNION ALL SELECT CAST(unnest([l_linenumber, l_linenumber + 10]) AS BIGINT), 'assist' FROM lineitem WHERE l_returnflag = 'A')
SELECT p AS participant_id, count(*) FILTER (role = 'kill') AS kills, count(*) FILTER (role = 'death') AS deaths, count(*) FILTER (role = 'assist') AS assists FROM r GROUP BY 1""")
def kda_from_events(x):
    from eventloom.operators.folds import combat_totals

    kills = x.lineitem.filter("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("killer"), F.round(F.col("l_discount") * 100).cast("long").alias("victim"),
        F.array(F.col("l_linenumber").cast("long"), F.col("l_linenumber").cast("long") + 10).alias("assists"),
    )
    return combat_totals(kills, [], "killer", "victim", "assists")


@query("D39_team_rollup", """SELECT team, team_position, R6(sum(gold)) AS gold, R6(max(gold)) AS best, count(*) AS players, count(*) FILTER (gold > 5000) > count(*) / 2 AS win FROM {roster} GROUP BY 1, 2""")
def team_rollup(x):
    from eventloom.operators.rollups import team_rollup as rollup

    return rollup(x.roster.withColumn("win", F.col("gold") > 5000), ["team", "team_position"], {"gold": "gold"}, {"best": "gold"}, "win").withColumnRenamed("members", "players")


@query("D40_rollup_totals", """SELECT version_group, match_id, CAST(grouping(version_group) * 2 + grouping(match_id) AS BIGINT) AS level, count(*) AS rows, CAST(sum(overlap) AS BIGINT) AS overlap FROM {cm} GROUP BY ROLLUP (version_group, match_id)""")
def rollup_totals(x):
    return x.cm.rollup("version_group", "match_id").agg(
        F.grouping_id().alias("level"), F.count("*").alias("rows"), F.sum("overlap").alias("overlap")
    )


@query("D41_exact_field_counts", """SELECT entity, k - CAST(floor(value) AS BIGINT) AS delta, count(*) AS n, count(*) FILTER (k = floor(value)) AS exact FROM {ev} GROUP BY 1, 2""")
def exact_field_counts(x):
    f = F.floor("value").cast("long")
    return x.ev.groupBy("entity", (F.col("k") - f).alias("delta")).agg(F.count("*").alias("n"), F.count_if(F.col("k") == f).alias("exact"))


@query("D42_structural_checks", """SELECT match_id, bool_and(block_index = n - 1) AS contiguous, bool_and((block_index = 0) = (n = 1)) AS starts_at_zero, count(*) AS blocks
 FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY block_index) AS n FROM {pk}) GROUP BY 1""")
def structural_checks(x):
    p = o.position(x.pk.select("match_id", "block_index"), ["match_id"], ["block_index"], o.time_block("block_index", 4096), "n")
    return p.groupBy("match_id").agg(
        F.bool_and(F.col("block_index") == F.col("n") - 1).alias("contiguous"),
        F.bool_and((F.col("block_index") == 0) == (F.col("n") == 1)).alias("starts_at_zero"), F.count("*").alias("blocks"),
    )


@query("D62_duplicate_targets", """SELECT entity, value, count(*) AS n FROM {ev} GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_targets(x):
    return x.ev.groupBy("entity", "value").agg(F.count("*").alias("n")).filter("n > 1")


@query("D67_segment_statistics", """SELECT match_id, count(*) AS segments, count(*) FILTER (seg_type = 'chunk') AS chunks, count(*) FILTER (seg_type = 'keyframe') AS keyframes, CAST(sum(len) AS BIGINT) AS bytes,
 R6(avg(len / 1024.0)) AS mean_ratio FROM {seg} GROUP BY 1""")
def segment_statistics(x):
    return x.seg.groupBy("match_id").agg(
        F.count("*").alias("segments"), F.count_if(F.col("seg_type") == "chunk").alias("chunks"), F.count_if(F.col("seg_type") == "keyframe").alias("keyframes"),
        F.sum("len").alias("bytes"), F.avg(F.col("len") / 1024.0).alias("mean_ratio"),
    )


@query("D68_bounded_examples", """SELECT entity, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS examples FROM (SELECT entity, event_id, row_number() OVER (PARTITION BY entity ORDER BY value DESC, event_id) AS r FROM {ev}) WHERE r <= 6 GROUP BY 1""")
def bounded_examples(x):
    top = o.top_k(x.ev, ["entity"], [F.desc("value"), F.asc("event_id")], 6, "r")
    return top.groupBy("entity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda v: v["event_id"].cast("string")), ",").alias("examples")
    )
