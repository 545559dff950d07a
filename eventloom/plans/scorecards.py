"""Pattern rollups, promotion, quality reports and scorecards."""

from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import ordered as o
from eventloom.operators import quantiles as q
from eventloom.operators import rollups as r
from eventloom.plans.registry import query
from eventloom.session import cut_lineage

WIN = "ORDER BY score DESC, correlation DESC, nrmse, participant_id, o1, o3, o4"


def win():
    return [F.desc("score"), F.desc("correlation"), F.asc("nrmse"), F.asc("participant_id"), F.asc("o1"), F.asc("o3"), F.asc("o4")]


SLOT = ["match_id", "family_key", "slot_index"]
D43 = f"""WITH b AS (SELECT * FROM (SELECT *, correlation >= 0.5 AND nrmse <= 0.6 AS passes, row_number() OVER (PARTITION BY match_id, family_key, slot_index, metric, participant_id {WIN}) AS n FROM {{cm}}) WHERE n = 1),
a AS (SELECT match_id, family_key, slot_index, metric, count(*) AS participants, count(*) FILTER (passes) AS pass_count, avg(score) AS average_score,
 avg(score) * (0.5 + least(1, count(*) / 4)) * (0.5 + count(*) FILTER (passes) / count(*)) AS aggregate FROM b GROUP BY 1, 2, 3, 4)"""


@query("D43_window_aggregate", D43 + """ SELECT match_id, family_key, slot_index, metric, participants, pass_count, R6(average_score) AS average_score, R6(aggregate) AS aggregate
 FROM (SELECT *, row_number() OVER (PARTITION BY match_id, family_key, slot_index ORDER BY round(aggregate, 9) DESC, metric) AS n FROM a) WHERE n = 1""")
def window_aggregate(x):
    m = x.cm.withColumn("passes", (F.col("correlation") >= 0.5) & (F.col("nrmse") <= 0.6))
    return r.window_aggregate(m, SLOT, ["metric"], "participant_id", win(), "score", "passes")


@query("D44_pattern_summary", f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, family_key, metric, participant_id {WIN}) AS n FROM {{cm}}) WHERE n = 1),
c AS (SELECT match_id, family_key, metric, count(DISTINCT slot_index) AS rows, min(slot_index) AS band_start, max(slot_index) AS band_end FROM {{cm}} GROUP BY 1, 2, 3),
a AS (SELECT match_id, family_key, metric, count(*) AS p, avg(correlation) AS ac, avg(nrmse) AS an, avg(score) AS av, avg(score * correlation) AS ae, median(slope) AS ms FROM b GROUP BY 1, 2, 3)
SELECT match_id, family_key, metric, p AS participants, rows, band_start, band_end, R6(ac) AS average_correlation, R6(an) AS average_nrmse, R6(ms) AS slope_median,
 R6(ae * (0.5 + least(1, rows / 3)) * (0.5 + least(1, p / 4)) * (0.5 + av)) AS confidence FROM a JOIN c USING (match_id, family_key, metric)""")
def pattern_summary(x):
    keys = ["match_id", "family_key", "metric"]
    best = o.best(x.cm, [*keys, "participant_id"], win())
    # at most one row per participant is left, so the median is over a small group
    a = best.groupBy(*keys).agg(
        F.count("*").alias("participants"), F.avg("correlation").alias("average_correlation"), F.avg("nrmse").alias("average_nrmse"),
        F.avg("score").alias("v"), F.avg(F.col("score") * F.col("correlation")).alias("e"), s.median_zero("slope").alias("slope_median"),
    )
    c = x.cm.groupBy(*keys).agg(
        F.count_distinct("slot_index").alias("rows"), F.min("slot_index").alias("band_start"), F.max("slot_index").alias("band_end")
    )
    out = a.join(c, keys)
    conf = r.pattern_confidence(F.col("e"), F.col("rows"), F.col("participants"), F.col("v"))
    return out.withColumn("confidence", conf).drop("v", "e")


HELD = """WITH e AS (SELECT *, participants >= 6 AND correlation >= 0.5 AND nrmse <= 1.0 AND validator >= 0.6 AS q FROM {pe}),
vc AS (SELECT version_group, count(DISTINCT match_id) AS mc FROM e GROUP BY 1),
h AS (SELECT a.pattern_key, a.version_group, a.match_id, a.q, mc >= 2 AND (SELECT count(DISTINCT b.match_id) FROM e b WHERE b.pattern_key = a.pattern_key AND b.version_group = a.version_group AND b.q AND b.match_id <> a.match_id) > 0 AS el
 FROM e a JOIN vc USING (version_group)),
hg AS (SELECT pattern_key, version_group, count(*) FILTER (el) AS held_out_eligible, count(*) FILTER (el AND q) AS held_out_hits FROM h GROUP BY 1, 2)"""


def _held(x, group):
    e = x.pe.withColumn("q", r.qualifies("participants", "correlation", "nrmse", "validator"))
    counts = e.groupBy("version_group").agg(F.count_distinct("match_id").alias("match_count"))
    return e, r.leave_one_out(e, group, "match_id", "q", counts, "version_group")


D45 = HELD + """, hp AS (SELECT pattern_key, sum(held_out_eligible) AS he, sum(held_out_hits) AS hh FROM hg GROUP BY 1),
g AS (SELECT pattern_key, any_value(metric) AS metric, count(*) AS n, count(*) FILTER (promoted) AS np, avg(confidence) AS ac, median(participants) AS mp, median(correlation) AS mc, median(nrmse) AS mn, median(validator) AS mv,
 median(slope) AS ms, median(row_start) AS rs, median(row_end) AS re, sum(samples) AS samples FROM e GROUP BY 1),
gr AS (SELECT *, CASE WHEN he > 0 THEN hh / he END AS hr, ac * (0.5 + least(1, n / 3)) * (0.5 + least(1, np / 2)) * CASE WHEN he > 0 THEN 0.5 + hh / he ELSE 0.9 END AS conf FROM g JOIN hp USING (pattern_key))"""


@query("D45_pattern_rollup", D45 + """ SELECT pattern_key, n AS entries, np AS promoted_entries, R6(mp) AS participants_median, R6(mc) AS correlation_median, R6(mn) AS nrmse_median, R6(mv) AS validator_median,
 R6(ms) AS slope_median, CAST(floor(rs + 0.5) AS BIGINT) AS band_start, CAST(floor(re + 0.5) AS BIGINT) AS band_end, CAST(he AS BIGINT) AS held_out_eligible, R6(hr) AS held_out_rate, R6(conf) AS confidence FROM gr""")
def pattern_rollup(x):
    return _pattern_rollup(x).drop("samples")


def _pattern_rollup(x):
    e, held = _held(x, ["pattern_key", "version_group"])
    held = held.groupBy("pattern_key").agg(F.sum("held_out_eligible").alias("held_out_eligible"), F.sum("held_out_hits").alias("hh"))
    held = held.withColumn("held_out_rate", F.try_divide("hh", "held_out_eligible")).drop("hh")
    g = e.groupBy("pattern_key").agg(
        F.count("*").alias("entries"), F.count_if("promoted").alias("promoted_entries"), F.avg("confidence").alias("ac"), F.sum("samples").alias("samples")
    )
    med = q.medians(e, ["pattern_key"], ["participants", "correlation", "nrmse", "validator", "slope", "row_start", "row_end"])
    out = g.join(med, "pattern_key").join(held, "pattern_key")
    one = F.lit(1.0)
    conf = (
        F.col("ac") * (0.5 + F.least(one, F.col("entries") / 3)) * (0.5 + F.least(one, F.col("promoted_entries") / 2))
        * F.coalesce(0.5 + F.col("held_out_rate"), F.lit(0.9))
    )
    return out.select(
        "pattern_key", "entries", "promoted_entries", "participants_median", "correlation_median", "nrmse_median", "validator_median", "slope_median",
        s.js_round("row_start_median").alias("band_start"), s.js_round("row_end_median").alias("band_end"),
        "held_out_eligible", "held_out_rate", conf.alias("confidence"), "samples",
    )


@query("D45_slot_recommendations", """WITH c AS (SELECT family_key, metric, slot_index, count(DISTINCT match_id) AS matches FROM {cm} GROUP BY 1, 2, 3)
SELECT family_key, metric, slot_index, matches, row_number() OVER (PARTITION BY family_key, metric ORDER BY matches DESC, slot_index) AS rank FROM c QUALIFY rank <= 8""")
def slot_recommendations(x):
    c = x.cm.groupBy("family_key", "metric", "slot_index").agg(F.count_distinct("match_id").alias("matches"))
    return o.top_k(c, ["family_key", "metric"], [F.desc("matches"), F.asc("slot_index")], 8, "rank")


@query("D46_leave_one_match_out", HELD + " SELECT pattern_key, version_group, held_out_eligible, held_out_hits, R6(CASE WHEN held_out_eligible > 0 THEN held_out_hits / held_out_eligible END) AS held_out_rate FROM hg")
def leave_one_match_out(x):
    return _held(x, ["pattern_key", "version_group"])[1]


ALIAS = """WITH e AS (SELECT *, version_group || '|' || metric || '|' || archetype || '|c' || CAST(floor((row_start + row_end) / 8 + 0.5) AS BIGINT) AS ck,
 participants >= 6 AND correlation >= 0.5 AND nrmse <= 1.0 AND validator >= 0.6 AS q FROM {pe}),
vc AS (SELECT version_group, count(DISTINCT match_id) AS mc FROM e GROUP BY 1),
qm AS (SELECT ck, count(DISTINCT match_id) AS qn FROM e WHERE q GROUP BY 1), qo AS (SELECT ck, match_id, bool_or(q) AS own FROM e GROUP BY 1, 2),
h AS (SELECT e.ck, e.q, mc >= 2 AND coalesce(qn, 0) - CAST(own AS INT) > 0 AS el FROM e JOIN vc USING (version_group) LEFT JOIN qm USING (ck) JOIN qo USING (ck, match_id)),
hg AS (SELECT ck, count(*) FILTER (el) AS he, count(*) FILTER (el AND q) AS hh FROM h GROUP BY 1),
g AS (SELECT ck, any_value(metric) AS metric, avg(confidence) AS ac, count(DISTINCT match_id) AS mn, count(DISTINCT family_key) AS fn, median(participants) AS mp, median(correlation) AS mc, median(nrmse) AS me, median(validator) AS mv FROM e GROUP BY 1),
al AS (SELECT *, ac * (0.6 + least(1, mn / 2)) * (0.6 + least(1, fn / 2)) * CASE WHEN he > 0 THEN 0.5 + hh / he ELSE 0.95 END AS conf FROM g JOIN hg USING (ck))"""


@query("D47_alias_clusters", ALIAS + """ SELECT ck AS cluster_key, mn AS matches, fn AS families, R6(mp) AS participants_median, R6(mc) AS correlation_median, R6(me) AS nrmse_median, R6(mv) AS validator_median,
 he AS held_out_eligible, R6(CASE WHEN he > 0 THEN hh / he END) AS held_out_rate, R6(conf) AS confidence FROM al""")
def alias_clusters(x):
    return _alias(x)


def _cluster_key():
    center = s.js_round((F.col("row_start") + F.col("row_end")) / 8)
    return F.concat_ws("|", "version_group", "metric", "archetype", F.concat(F.lit("c"), center.cast("string")))


def _alias(x):
    e = x.pe.withColumn("q", r.qualifies("participants", "correlation", "nrmse", "validator")).withColumn("cluster_key", _cluster_key())
    counts = e.groupBy("version_group").agg(F.count_distinct("match_id").alias("match_count"))
    held = r.leave_one_out(e, ["cluster_key"], "match_id", "q", counts, "version_group").drop("held_out_hits")
    g = e.groupBy("cluster_key").agg(
        F.avg("confidence").alias("ac"), F.count_distinct("match_id").alias("matches"), F.count_distinct("family_key").alias("families")
    )
    med = q.medians(e, ["cluster_key"], ["participants", "correlation", "nrmse", "validator"])
    out = g.join(med, "cluster_key").join(held, "cluster_key")
    one = F.lit(1.0)
    conf = (
        F.col("ac") * (0.6 + F.least(one, F.col("matches") / 2)) * (0.6 + F.least(one, F.col("families") / 2))
        * F.coalesce(0.5 + F.col("held_out_rate"), F.lit(0.95))
    )
    return out.withColumn("confidence", conf).drop("ac")


PROMOTE = D45 + """, am AS (SELECT metric, max(mn) AS amn, max(mp) AS amp, max(mc) AS amc, min(me) AS ame, max(mv) AS amv FROM (
 SELECT metric, version_group || '|' || metric || '|' || archetype || '|c' || CAST(floor((row_start + row_end) / 8 + 0.5) AS BIGINT) AS ck, count(DISTINCT match_id) AS mn, median(participants) AS mp, median(correlation) AS mc, median(nrmse) AS me, median(validator) AS mv FROM {pe} GROUP BY 1, 2) GROUP BY 1)
SELECT pattern_key, greatest(n, coalesce(amn, 0)) >= 3 AND greatest(mp, coalesce(amp, 0)) >= 6 AND mc >= 0.5 AND mn <= 1 AND mv >= 0.6 AND greatest(mc, coalesce(amc, 0)) >= 0.55
 AND least(mn, coalesce(ame, 'infinity'::DOUBLE)) <= 0.9 AND greatest(mv, coalesce(amv, 0)) >= 0.7 AND (he = 0 OR hr >= 0.5) AND samples >= 2 AS promoted FROM gr LEFT JOIN am USING (metric)"""


@query("D48_promotion_decision", PROMOTE)
def promotion_decision(x):
    """Own evidence joined with the metric's alias evidence against the promotion gates."""
    own = _pattern_rollup(x).withColumn("metric", F.element_at(F.split("pattern_key", ":"), 2))
    alias = _alias(x).withColumn("metric", F.element_at(F.split("cluster_key", "\\|"), 2)).groupBy("metric").agg(
        F.max("matches").alias("amn"), F.max("participants_median").alias("amp"), F.max("correlation_median").alias("amc"),
        F.min("nrmse_median").alias("ame"), F.max("validator_median").alias("amv"),
    )
    out = own.join(alias, "metric", "left")
    c, zero = F.col, F.lit(0.0)
    ok = (
        (F.greatest("entries", F.coalesce("amn", F.lit(0))) >= 3)
        & (F.greatest("participants_median", F.coalesce("amp", zero)) >= 6)
        & (c("correlation_median") >= 0.5) & (c("nrmse_median") <= 1.0) & (c("validator_median") >= 0.6)
        & (F.greatest("correlation_median", F.coalesce("amc", zero)) >= 0.55)
        & (F.least("nrmse_median", F.coalesce("ame", F.lit(float("inf")))) <= 0.9)
        & (F.greatest("validator_median", F.coalesce("amv", zero)) >= 0.7)
        & ((c("held_out_eligible") == 0) | (c("held_out_rate") >= 0.5)) & (c("samples") >= 2)
    )
    return out.select("pattern_key", ok.alias("promoted"))


GAP = f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, version_group, family_key, slot_index, metric, participant_id {WIN}) AS n FROM {{cm}}) WHERE n = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, version_group, family_key, slot_index, metric {WIN}) AS rk, lead(score) OVER (PARTITION BY match_id, version_group, family_key, slot_index, metric {WIN}) AS runner_up,
 count(*) OVER (PARTITION BY match_id, version_group, family_key, slot_index, metric) AS participants FROM p),
w AS (SELECT *, score - runner_up AS gap, runner_up IS NULL OR score - runner_up >= 0.08 AS unambiguous FROM k WHERE rk = 1)"""
GROUP = ["match_id", "version_group", "family_key", "slot_index", "metric"]


@query("E8_winner_runner_up", GAP + """ SELECT match_id, version_group, family_key, slot_index, metric, participant_id, R6(score) AS score, R6(runner_up) AS runner_up, R6(gap) AS gap, unambiguous, participants FROM w""")
def winner_runner_up(x):
    out = r.winner_gap(x.cm, GROUP, "participant_id", win(), "score", 0.08)
    return out.select(*GROUP, "participant_id", "score", "runner_up", "gap", "unambiguous", "participants")


@query("D49_metric_slot_rollup", GAP + """ SELECT version_group, family_key, slot_index, metric, count(DISTINCT match_id) AS support, count(DISTINCT match_id) FILTER (unambiguous) AS unambiguous_support,
 R6(coalesce(avg(correlation) FILTER (unambiguous), 0)) AS average_correlation, R6(coalesce(avg(nrmse) FILTER (unambiguous), 0)) AS average_nrmse, R6(coalesce(avg(score) FILTER (unambiguous), 0)) AS average_score,
 count(DISTINCT match_id) FILTER (unambiguous) >= 2 AND coalesce(avg(correlation) FILTER (unambiguous), 0) >= 0.5 AND coalesce(avg(nrmse) FILTER (unambiguous), 0) <= 0.6 AND coalesce(avg(score) FILTER (unambiguous), 0) >= 0.5 AS promoted
 FROM w GROUP BY 1, 2, 3, 4""")
def metric_slot_rollup(x):
    w = r.winner_gap(x.cm, GROUP, "participant_id", win(), "score", 0.08)
    ok = F.col("unambiguous")
    avg = {c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)) for c in ("correlation", "nrmse", "score")}
    un = F.count_distinct(F.when(ok, F.col("match_id")))
    return w.groupBy("version_group", "family_key", "slot_index", "metric").agg(
        F.count_distinct("match_id").alias("support"), un.alias("unambiguous_support"),
        avg["correlation"].alias("average_correlation"), avg["nrmse"].alias("average_nrmse"), avg["score"].alias("average_score"),
        ((un >= 2) & (avg["correlation"] >= 0.5) & (avg["nrmse"] <= 0.6) & (avg["score"] >= 0.5)).alias("promoted"),
    )


@query("D50_cross_match_group", """WITH g AS (SELECT metric, family_key, count(DISTINCT match_id) AS mn, count(DISTINCT version_group) AS fn, min(slot_index) AS s0, max(slot_index) AS s1, avg(score) AS ac, median(slot_index) AS ms, median(nrmse) AS md FROM {cm} GROUP BY 1, 2)
SELECT metric, family_key, mn AS match_support, fn AS version_support, s1 - s0 AS slot_span, R6(1 / (1 + (s1 - s0) / 8)) AS compactness, R6(ms) AS slot_index_median, R6(md) AS nrmse_median,
 R6(ac * (0.55 + least(1, mn / 3)) * (0.6 + md) * (0.55 + 0.45 / (1 + (s1 - s0) / 8))) AS confidence FROM g""")
def cross_match_group(x):
    keys = ["metric", "family_key"]
    g = x.cm.groupBy(*keys).agg(
        F.count_distinct("match_id").alias("match_support"), F.count_distinct("version_group").alias("version_support"),
        (F.max("slot_index") - F.min("slot_index")).alias("slot_span"), F.avg("score").alias("ac"),
    ).join(q.medians(x.cm, keys, ["slot_index", "nrmse"]), keys)
    compact = 1 / (1 + F.col("slot_span") / 8)
    conf = F.col("ac") * (0.55 + F.least(F.lit(1.0), F.col("match_support") / 3)) * (0.6 + F.col("nrmse_median")) * (0.55 + 0.45 * compact)
    return g.withColumns({"compactness": compact, "confidence": conf}).drop("ac")


# fixed values: identity weight per metric, others 0.5
WEIGHTS = {"m0": 1.4, "m1": 1.4, "m2": 1.35, "m3": 1.25, "m4": 1.0, "m5": 1.0, "m6": 0.75, "m7": 0.6}
WSQL = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 0.5 END"
EVID = f"""WITH b AS (SELECT *, {WSQL} AS w FROM (SELECT *, row_number() OVER (PARTITION BY match_id, family_key, slot_index, participant_id, metric {WIN}) AS n FROM {{cm}}) WHERE n = 1),
ev2 AS (SELECT match_id, family_key, slot_index, participant_id, count(*) AS metrics, sum(w)::DOUBLE AS iw, count(*) FILTER (w >= 1) AS im, sum(w * score) AS ws, avg(correlation) AS ac, avg(nrmse) AS an, max(score) AS bs FROM b GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)"""


@query("D51_identity_evidence", EVID + """ SELECT match_id, family_key, slot_index, participant_id, metrics, R6(iw) AS identity_weight, im AS identity_metrics, R6(ws) AS weighted_support, R6(ac) AS average_correlation, R6(an) AS average_nrmse,
 R6(bs) AS best_score, R6(ws + least(0.75, (metrics - 1) * 0.18)) AS evidence FROM ev2""")
def identity_evidence(x):
    return r.identity_evidence(x.cm, SLOT, "participant_id", "metric", win(), WEIGHTS)


@query("D52_likely_field_patterns", """SELECT family_key, metric, count(DISTINCT slot_index) AS distinct_rows, count(DISTINCT participant_id) AS distinct_participants, count(*) AS support, R6(avg(correlation)) AS average_correlation,
 R6(avg(nrmse)) AS average_nrmse, R6(avg(score)) AS average_score, R6(max(score)) AS best_score FROM {cm} GROUP BY 1, 2""")
def likely_field_patterns(x):
    return x.cm.groupBy("family_key", "metric").agg(
        F.count_distinct("slot_index").alias("distinct_rows"), F.count_distinct("participant_id").alias("distinct_participants"),
        F.count("*").alias("support"), F.avg("correlation").alias("average_correlation"), F.avg("nrmse").alias("average_nrmse"),
        F.avg("score").alias("average_score"), F.max("score").alias("best_score"),
    )


@query("D53_family_summary", EVID + f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, family_key {WIN}) AS n FROM {{cm}}) WHERE n = 1),
e AS (SELECT match_id, family_key, max(ws + least(0.75, (metrics - 1) * 0.18)) AS te FROM ev2 GROUP BY 1, 2), c AS (SELECT match_id, family_key, count(DISTINCT slot_index) AS rows, count(*) AS fields FROM {{cm}} GROUP BY 1, 2)
SELECT match_id, family_key, rows, fields, R6(t.score) AS top_score, R6(t.score + coalesce(te, 0)) AS family_score FROM c JOIN t USING (match_id, family_key) LEFT JOIN e USING (match_id, family_key)""")
def family_summary(x):
    keys = ["match_id", "family_key"]
    top = o.best(x.cm, keys, win()).select(*keys, F.col("score").alias("top_score"))
    e = r.identity_evidence(x.cm, SLOT, "participant_id", "metric", win(), WEIGHTS).groupBy(*keys).agg(F.max("evidence").alias("te"))
    c = x.cm.groupBy(*keys).agg(F.count_distinct("slot_index").alias("rows"), F.count("*").alias("fields"))
    out = c.join(top, keys).join(e, keys, "left")
    return out.withColumn("family_score", F.col("top_score") + F.coalesce("te", F.lit(0.0))).drop("te")


@query("D54_identity_priors", f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, family_key, slot_index, participant_id {WIN}) AS n FROM {{cm}}) WHERE n = 1),
p AS (SELECT version_group, family_key, slot_index, participant_id, count(*) AS support, count(DISTINCT match_id) AS matches, avg(score) AS sc FROM b GROUP BY 1, 2, 3, 4),
m AS (SELECT version_group, family_key, slot_index, max(support) AS ms, greatest(max(sc), 1e-9) AS mx FROM p GROUP BY 1, 2, 3)
SELECT version_group, family_key, slot_index, participant_id, support, matches, R6(sc) AS average_score, R6(0.55 * support / ms + 0.45 * sc / mx) AS prior FROM p JOIN m USING (version_group, family_key, slot_index)""")
def identity_priors(x):
    best = o.best(x.cm, [*SLOT, "participant_id"], win())
    return r.normalized_priors(best, ["version_group", "family_key", "slot_index"], ["participant_id"], "score", "match_id")


@query("D55_coordinate_priors", """WITH m AS (SELECT version_group, family_key, median(slope) AS sm, median(intercept) AS im, count(*) AS support, count(DISTINCT match_id) AS matches FROM {cm} GROUP BY 1, 2)
SELECT c.version_group, c.family_key, any_value(support) AS support, any_value(matches) AS matches, R6(any_value(sm)) AS slope_median, R6(any_value(im)) AS intercept_median, R6(median(abs(slope - sm))) AS slope_mad, R6(median(abs(intercept - im))) AS intercept_mad
 FROM {cm} c JOIN m USING (version_group, family_key) GROUP BY 1, 2""")
def coordinate_priors(x):
    keys = ["version_group", "family_key"]
    med = cut_lineage(q.medians(x.cm, keys, ["slope", "intercept"]))
    away = x.cm.join(med, keys).select(
        *keys, F.abs(F.col("slope") - F.col("slope_median")).alias("slope"), F.abs(F.col("intercept") - F.col("intercept_median")).alias("intercept")
    )
    counts = x.cm.groupBy(*keys).agg(F.count("*").alias("support"), F.count_distinct("match_id").alias("matches"))
    return counts.join(med, keys).join(q.medians(away, keys, ["slope", "intercept"], "_mad"), keys)




@query("D56_family_policy_tiers", """WITH f AS (SELECT match_id AS family, count(*) AS entities, avg(CASE WHEN c = 'strong' THEN 1.0 ELSE 0 END) AS strong_rate, avg(CASE WHEN c = 'weak' THEN 1.0 ELSE 0 END) AS weak_rate, avg(axis) AS axis, avg(correlation) AS path, avg(nrmse) AS nrmse
 FROM (SELECT *, CASE WHEN overlap >= 6 AND axis >= 0.8 AND correlation >= 0.35 AND nrmse <= 0.08 THEN 'strong' WHEN overlap >= 6 AND axis >= 0.65 AND correlation >= 0.2 AND nrmse <= 0.14 THEN 'moderate' ELSE 'weak' END AS c
  FROM (SELECT match_id, overlap, 0.5 + score / 2 AS axis, correlation, nrmse / 8 AS nrmse FROM {cm})) GROUP BY 1)
SELECT family, entities, R6(strong_rate) AS strong_rate, R6(weak_rate) AS weak_rate, R6(axis) AS axis, R6(path) AS path, R6(nrmse) AS nrmse, CASE WHEN entities < 590 THEN 'insufficient' WHEN weak_rate > 0.45 OR axis < 0.62 THEN 'rejected'
 WHEN strong_rate >= 0.35 OR (weak_rate <= 0.15 AND axis >= 0.74 AND path >= 0.7 AND nrmse <= 0.11) THEN 'trusted' ELSE 'strict' END AS tier FROM f""")
def family_policy_tiers(x):
    return r.policy_tier(_classed(x).groupBy(F.col("match_id").alias("family")).agg(
        F.count("*").alias("entities"), s.ratio(F.col("c") == "strong").alias("strong_rate"), s.ratio(F.col("c") == "weak").alias("weak_rate"),
        F.avg("axis").alias("axis"), F.avg("correlation").alias("path"), F.avg("nrmse").alias("nrmse"),
    ), 590)


def _classed(x):
    m = x.cm.select("match_id", "family_key", "slot_index", "overlap", (0.5 + F.col("score") / 2).alias("axis"), "correlation", (F.col("nrmse") / 8).alias("nrmse"))
    return m.withColumn("c", r.alignment_class("overlap", "axis", "correlation", "nrmse"))


@query("D57_alignment_classes", """SELECT family_key, CASE WHEN overlap >= 6 AND axis >= 0.8 AND correlation >= 0.35 AND nrmse <= 0.08 THEN 'strong' WHEN overlap >= 6 AND axis >= 0.65 AND correlation >= 0.2 AND nrmse <= 0.14 THEN 'moderate' ELSE 'weak' END AS class, count(*) AS entities, R6(avg(axis)) AS average_axis
 FROM (SELECT family_key, overlap, 0.5 + score / 2 AS axis, correlation, nrmse / 8 AS nrmse FROM {cm}) GROUP BY 1, 2""")
def alignment_classes(x):
    return _classed(x).groupBy("family_key", F.col("c").alias("class")).agg(F.count("*").alias("entities"), F.avg("axis").alias("average_axis"))


@query("D58_quality_report", """WITH v AS (SELECT *, CAST(overlap < 6 AS INT) + CAST(nrmse > 0.9 AS INT) AS viol FROM {cm})
SELECT metric, count(*) AS series, R6(avg(nrmse)) AS average_nrmse, R6(median(nrmse)) AS median_nrmse, R6(quantile_cont(nrmse, 0.9)) AS p90_nrmse, R6(max(nrmse)) AS max_nrmse, CAST(sum(viol) AS BIGINT) AS violations,
 count(*) FILTER (overlap < 6) AS insufficient_points, count(*) FILTER (nrmse > 0.9) AS nrmse_above_limit FROM v GROUP BY 1""")
def quality_report(x):
    short, high = F.col("overlap") < 6, F.col("nrmse") > 0.9
    base = x.cm.groupBy("metric").agg(
        F.count("*").alias("series"), F.avg("nrmse").alias("average_nrmse"), F.max("nrmse").alias("max_nrmse"),
        F.sum(F.size(r.reasons(insufficient_compared_points=short, normalized_rmse_above_limit=high))).alias("violations"),
        F.count_if(short).alias("insufficient_points"), F.count_if(high).alias("nrmse_above_limit"),
    )
    return base.join(q.quantiles(x.cm, ["metric"], "nrmse", {"median_nrmse": 0.5, "p90_nrmse": 0.9}), "metric")


@query("D59_coverage_status", """WITH c AS (SELECT match_id, metric, CASE WHEN bool_or(correlation >= 0.97) THEN 'decoded' WHEN bool_or(correlation >= 0.9) THEN 'partial' ELSE 'unavailable' END AS status,
 bool_or(nrmse > 0.99) AS r1, bool_or(overlap < 3) AS r2 FROM {cm} GROUP BY 1, 2)
SELECT metric, status, count(*) AS matches, concat_ws(',', CASE WHEN bool_or(r1) THEN 'high-error' END, CASE WHEN bool_or(r2) THEN 'short-series' END) AS reasons FROM c GROUP BY 1, 2""")
def coverage_status(x):
    """Status precedence is a max over ranked states, so it merges map-side."""
    rank = F.max(F.when(F.col("correlation") >= 0.97, 3).when(F.col("correlation") >= 0.9, 2).otherwise(1))
    c = x.cm.groupBy("match_id", "metric").agg(
        F.element_at(F.array(F.lit("unavailable"), F.lit("partial"), F.lit("decoded")), rank).alias("status"),
        F.bool_or(F.col("nrmse") > 0.99).alias("r1"), F.bool_or(F.col("overlap") < 3).alias("r2"),
    )
    return c.groupBy("metric", "status").agg(
        F.count("*").alias("matches"),
        F.concat_ws(",", F.when(F.bool_or("r1"), "high-error"), F.when(F.bool_or("r2"), "short-series")).alias("reasons"),
    )


@query("D60_pass_rate_by_risk", """WITH n AS (SELECT match_id, slot_index, participant_id, count(*) AS c, avg(score) AS sc FROM {cm} GROUP BY 1, 2, 3)
SELECT CASE WHEN c - 1 >= 7 THEN '7_plus' WHEN c - 1 >= 4 THEN '4_to_6' WHEN c - 1 >= 1 THEN '1_to_3' ELSE 'none' END AS bucket, count(*) AS assignments, count(*) FILTER (sc >= 0.505) AS passing, R6(avg(CASE WHEN sc >= 0.505 THEN 1.0 ELSE 0 END)) AS pass_rate FROM n GROUP BY 1""")
def pass_rate_by_risk(x):
    n = x.cm.groupBy("match_id", "slot_index", "participant_id").agg((F.count("*") - 1).alias("collisions"), F.avg("score").alias("sc"))
    ok = F.col("sc") >= 0.505
    return n.groupBy(r.collision_bucket("collisions").alias("bucket")).agg(
        F.count("*").alias("assignments"), F.count_if(ok).alias("passing"), s.ratio(ok).alias("pass_rate")
    )


@query("D61_assignment_ambiguity", GAP + """ SELECT version_group, count(*) AS rows, count(*) FILTER (unambiguous) AS stable, count(*) FILTER (gap <= 0) AS nonpositive, R6(min(gap)) AS min_gap, R6(median(gap)) AS median_gap, R6(max(gap)) AS max_gap FROM w GROUP BY 1""")
def assignment_ambiguity(x):
    # read once for the counts and several times for the median
    w = cut_lineage(r.winner_gap(x.cm, GROUP, "participant_id", win(), "score", 0.08).select("version_group", "gap", "unambiguous"))
    base = w.groupBy("version_group").agg(
        F.count("*").alias("rows"), F.count_if("unambiguous").alias("stable"), F.count_if(F.col("gap") <= 0).alias("nonpositive"),
        F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
    )
    return base.join(q.quantiles(w, ["version_group"], "gap", {"median_gap": 0.5}), "version_group")


@query("D63_metric_support", """SELECT metric, count(*) AS compared, count(*) FILTER (score > 0.5) AS positive, count(*) FILTER (score <= 0.5) AS below_score, count(*) FILTER (score > 0.5 AND overlap < 30) AS below_support,
 R6(count(*) FILTER (score > 0.5 AND overlap >= 30) / count(*)) AS support_rate FROM {cm} GROUP BY 1""")
def metric_support(x):
    pos, short = F.col("score") > 0.5, F.col("overlap") < 30
    return x.cm.groupBy("metric").agg(
        F.count("*").alias("compared"), F.count_if(pos).alias("positive"), F.count_if(~pos).alias("below_score"),
        F.count_if(pos & short).alias("below_support"), s.ratio(pos & ~short).alias("support_rate"),
    )


@query("D64_stat_key_support", """WITH t AS (SELECT l_orderkey AS p, CAST(max(l_linenumber) AS BIGINT) AS target FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS p, CAST(sum(l_linenumber) AS BIGINT) AS line_sum, count(*) AS line_count, CAST(sum(round(l_tax * 0)) AS BIGINT) AS zero FROM lineitem GROUP BY 1),
u AS (SELECT p, unnest(['line_sum', 'line_count', 'zero']) AS stat_key, unnest([line_sum, line_count, zero]) AS v FROM c)
SELECT stat_key, count(*) AS comparisons, count(*) FILTER (v = target) AS passes, count(*) FILTER (v <> 0 OR target <> 0) AS nonzero_pairs,
 CASE WHEN bool_and(v = target) AND count(*) FILTER (v <> 0 OR target <> 0) > 0 THEN 'validated_nonzero' WHEN bool_and(v = target) THEN 'all_zero_only' ELSE 'mismatch' END AS evidence FROM u JOIN t USING (p) GROUP BY 1""")
def stat_key_support(x):
    """Which raw statistic equals a target (the highest line number) for every participant, with nonzero evidence."""
    li = x.lineitem
    c = li.groupBy(F.col("l_orderkey").alias("p")).agg(
        F.max("l_linenumber").cast("long").alias("target"), F.sum("l_linenumber").alias("line_sum"), F.count("*").alias("line_count"),
        F.sum(F.round(F.col("l_tax") * 0)).cast("long").alias("zero"),
    )
    u = c.unpivot(["p", "target"], ["line_sum", "line_count", "zero"], "stat_key", "v")
    same, live = F.col("v") == F.col("target"), (F.col("v") != 0) | (F.col("target") != 0)
    return u.groupBy("stat_key").agg(
        F.count("*").alias("comparisons"), F.count_if(same).alias("passes"), F.count_if(live).alias("nonzero_pairs"),
        F.when(F.bool_and(same) & (F.count_if(live) > 0), "validated_nonzero").when(F.bool_and(same), "all_zero_only").otherwise("mismatch").alias("evidence"),
    )


@query("D65_sweep_hotspots", """WITH m AS (SELECT version_group, family_key, metric, max(score * correlation) AS near_miss, count(DISTINCT match_id) AS support FROM {cm} WHERE score < 0.95 GROUP BY 1, 2, 3)
SELECT version_group, family_key, count(*) AS metrics, R6(avg(near_miss)) AS average_near_miss, R6(max(near_miss)) AS best_near_miss, max(support) AS max_support FROM m GROUP BY 1, 2""")
def sweep_hotspots(x):
    m = x.cm.filter("score < 0.95").groupBy("version_group", "family_key", "metric").agg(
        F.max(F.col("score") * F.col("correlation")).alias("near_miss"), F.count_distinct("match_id").alias("support")
    )
    return m.groupBy("version_group", "family_key").agg(
        F.count("*").alias("metrics"), F.avg("near_miss").alias("average_near_miss"), F.max("near_miss").alias("best_near_miss"), F.max("support").alias("max_support")
    )


@query("D66_corpus_scorecard", """SELECT 'scalar' AS section, count(*) FILTER (correlation >= 0.5 AND nrmse <= 0.6) AS passes, count(*) AS checks FROM {cm} UNION ALL
SELECT 'movement', count(*) FILTER (a >= 0.5), count(*) FROM (SELECT match_id, avg(score) AS a FROM {cm} GROUP BY 1) UNION ALL SELECT 'promoted', count(*) FILTER (promoted), count(*) FROM {pe}""")
def corpus_scorecard(x):
    ok = (F.col("correlation") >= 0.5) & (F.col("nrmse") <= 0.6)
    scalar = x.cm.agg(F.lit("scalar").alias("section"), F.count_if(ok).alias("passes"), F.count("*").alias("checks"))
    move = x.cm.groupBy("match_id").agg(F.avg("score").alias("a")).agg(F.lit("movement").alias("section"), F.count_if(F.col("a") >= 0.5).alias("passes"), F.count("*").alias("checks"))
    prom = x.cm.groupBy("match_id", "version_group", "family_key", "metric").agg((F.max("score") > 0.95).alias("p"))
    prom = prom.agg(F.lit("promoted").alias("section"), F.count_if("p").alias("passes"), F.count("*").alias("checks"))
    return scalar.unionByName(move).unionByName(prom)


D71 = f"""WITH b AS (SELECT match_id, family_key, slot_index, metric, max(score) AS score, max(correlation) AS correlation FROM {{cm}} GROUP BY 1, 2, 3, 4),
z AS (SELECT *, row_number() OVER (PARTITION BY match_id, family_key, slot_index ORDER BY score DESC, metric) AS n FROM b),
t AS (SELECT match_id, family_key, slot_index, max(metric) FILTER (n = 1) AS m1, max(score) FILTER (n = 1) AS s1, max(metric) FILTER (n = 2) AS m2, max(score) FILTER (n = 2) AS s2 FROM z GROUP BY 1, 2, 3)"""


@query("D71_confusion_penalty", D71 + """ SELECT match_id, family_key, slot_index, metric, CASE WHEN metric = m1 THEN m2 ELSE m1 END AS rival, R6(score - CASE WHEN metric = m1 THEN coalesce(s2, 0) ELSE s1 END) AS margin,
 R6(CASE WHEN score - CASE WHEN metric = m1 THEN coalesce(s2, 0) ELSE s1 END < 0.05 THEN 0.72 ELSE 1 END * CASE WHEN correlation < 0.56 THEN 0.75 ELSE 1 END) AS penalty FROM b JOIN t USING (match_id, family_key, slot_index)""")
def confusion_penalty(x):
    """Strongest rival metric of each candidate and the ambiguity penalty (fixed factors)."""
    b = x.cm.groupBy(*SLOT, "metric").agg(F.max("score").alias("score"), F.max("correlation").alias("correlation"))
    two = o.top_k(b, SLOT, [F.desc("score"), F.asc("metric")], 2, "n")
    pick = {f"{c[0]}{i}": F.max(F.when(F.col("n") == i, F.col(c))) for c in ("metric", "score") for i in (1, 2)}
    t = two.groupBy(*SLOT).agg(*[v.alias(k) for k, v in pick.items()])
    out = b.join(t, SLOT)
    own = F.col("metric") == F.col("m1")
    margin = F.col("score") - F.when(own, F.coalesce("s2", F.lit(0.0))).otherwise(F.col("s1"))
    penalty = F.when(margin < 0.05, 0.72).otherwise(1.0) * F.when(F.col("correlation") < 0.56, 0.75).otherwise(1.0)
    return out.select(*SLOT, "metric", F.when(own, F.col("m2")).otherwise(F.col("m1")).alias("rival"), margin.alias("margin"), penalty.alias("penalty"))


@query("D76_minimum_match_correlation", """WITH c AS (SELECT family_key, metric, match_id, abs(corr(score, correlation)) AS r FROM {cm} GROUP BY 1, 2, 3 HAVING count(*) >= 3)
SELECT family_key, metric, R6(min(r)) AS minimum_correlation, count(*) AS matches FROM c GROUP BY 1, 2""")
def minimum_match_correlation(x):
    c = x.cm.groupBy("family_key", "metric", "match_id").agg(F.abs(s.pearson_zero("score", "correlation")).alias("r"), F.count("*").alias("n")).filter("n >= 3")
    return c.groupBy("family_key", "metric").agg(F.min("r").alias("minimum_correlation"), F.count("*").alias("matches"))


@query("D75_candidate_ladder", """WITH p AS (SELECT entity AS metric, match_id, CASE WHEN count(*) < 3 OR regr_sxx(ty, ry) <= 1e-9 OR regr_syy(ty, ry) <= 1e-9 THEN 0 ELSE abs(regr_sxy(ty, ry) / sqrt(regr_sxx(ty, ry) * regr_syy(ty, ry))) END AS r, count(*) AS n,
 covar_pop(ry, ty) * count(*) AS sxy, var_pop(ry) * count(*) AS sxx, var_pop(ty) * count(*) AS syy FROM {pair} GROUP BY 1, 2),
f AS (SELECT metric, sum(sxy) / sqrt(sum(sxx) * sum(syy)) AS w, min(r) AS mr, count(*) AS matches FROM p WHERE n >= 2 GROUP BY 1)
SELECT metric, CASE WHEN abs(w) >= 0.8 AND mr >= 0.7 THEN 'stable-strong-correlation' WHEN abs(w) >= 0.6 AND mr >= 0.45 THEN 'stable-moderate-correlation' WHEN mr >= 0.75 AND abs(w) < 0.35 THEN 'participant-static-correlation-only' ELSE 'not-promotable' END AS class, R6(w) AS within FROM f""")
def candidate_ladder(x):
    """Ladder over the per-entity correlation of candidate and oracle series."""
    n = F.count("*")
    p = x.pair.groupBy(F.col("entity").alias("metric"), "match_id").agg(
        F.abs(s.pearson_zero("ry", "ty")).alias("r"), n.alias("n"), (F.covar_pop("ry", "ty") * n).alias("sxy"),
        (F.var_pop("ry") * n).alias("sxx"), (F.var_pop("ty") * n).alias("syy"),
    ).filter("n >= 2")
    f = p.groupBy("metric").agg(
        F.try_divide(F.sum("sxy"), F.sqrt(F.sum("sxx") * F.sum("syy"))).alias("within"), F.min("r").alias("mr"), F.count("*").alias("matches")
    )
    w = F.col("within")
    no = F.lit(False)
    cls = r.state_class(no, F.col("matches"), F.col("matches"), w, w, F.col("mr"), F.col("mr"), no)
    return f.select("metric", cls.alias("class"), "within")


@query("D77_best_match_per_entity", f"""WITH b AS (SELECT *, correlation >= 0.5 AND nrmse <= 0.6 AS passes, row_number() OVER (PARTITION BY match_id, participant_id {WIN}) AS n FROM {{cm}})
SELECT match_id, participant_id, max(family_key) FILTER (n = 1) AS family_key, max(slot_index) FILTER (n = 1) AS slot_index, count(*) FILTER (passes) AS passing, R6(max(score) FILTER (n = 1)) AS score FROM b GROUP BY 1, 2""")
def best_match_per_entity(x):
    keys = ["match_id", "participant_id"]
    top = o.best(x.cm, keys, win()).select(*keys, "family_key", "slot_index", "score")
    n = x.cm.groupBy(*keys).agg(F.count_if((F.col("correlation") >= 0.5) & (F.col("nrmse") <= 0.6)).alias("passing"))
    return top.join(n, keys)


@query("D78_strength_classes", """SELECT metric, CASE WHEN score >= 0.28 AND correlation >= 0.55 AND nrmse <= 1.1 THEN 'strong' WHEN score >= 0.18 AND correlation >= 0.4 AND nrmse <= 1.5 THEN 'moderate' ELSE 'weak' END AS strength, count(*) AS matches, R6(avg(score)) AS average_score FROM {cm} GROUP BY 1, 2""")
def strength_classes(x):
    return x.cm.groupBy("metric", r.strength("score", "correlation", "nrmse").alias("strength")).agg(F.count("*").alias("matches"), F.avg("score").alias("average_score"))


@query("D79_slot_conflicts", GAP + """ SELECT version_group, family_key, slot_index, count(*) FILTER (NOT unambiguous) AS ambiguous, count(*) AS support, count(DISTINCT participant_id) AS entities, CAST(max(match_id) FILTER (NOT unambiguous) AS BIGINT) AS last_ambiguous_match FROM w GROUP BY 1, 2, 3""")
def slot_conflicts(x):
    w = r.winner_gap(x.cm, GROUP, "participant_id", win(), "score", 0.08)
    amb = ~F.col("unambiguous")
    return w.groupBy("version_group", "family_key", "slot_index").agg(
        F.count_if(amb).alias("ambiguous"), F.count("*").alias("support"), F.count_distinct("participant_id").alias("entities"),
        F.max(F.when(amb, F.col("match_id"))).alias("last_ambiguous_match"),
    )


@query("D80_eventful_family_rollup", """WITH e AS (SELECT *, t // 86400000 AS day FROM {ev}), h AS (SELECT day FROM e GROUP BY 1 HAVING sum(value) >= 15000)
SELECT entity, count(DISTINCT day) AS chunks, count(DISTINCT (match_id, day)) AS intervals, count(*) AS records FROM e SEMI JOIN h USING (day) GROUP BY 1""")
def eventful_family_rollup(x):
    e = x.ev.withColumn("day", F.floor(F.col("t") / 86_400_000))
    hot = e.groupBy("day").agg(F.sum("value").alias("v")).filter("v >= 15000").select("day")
    return e.join(hot, "day", "left_semi").groupBy("entity").agg(
        F.count_distinct("day").alias("chunks"), F.count_distinct("match_id", "day").alias("intervals"), F.count("*").alias("records")
    )


@query("D81_stratified_sample", """WITH f AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)
SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents SEMI JOIN f USING (source) QUALIFY rank <= 3""")
def stratified_sample(x):
    """Sampling operator: the largest three records per family and match of the top families."""
    fam = x.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(8)
    d = x.documents.select("source", "lang", "doc_id", "n_chars").join(F.broadcast(fam.select("source")), "source", "left_semi")
    return o.top_k(d, ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")], 3, "rank").drop("n_chars")


@query("D82_state_band_counts", """WITH s AS (SELECT match_id, slot_index, count(*) FILTER (score > 0.9) AS active, count(DISTINCT metric) FILTER (score > 0.9) AS fields FROM {cm} GROUP BY 1, 2)
SELECT match_id, count(*) AS slots, CAST(sum(CASE WHEN active >= 8 THEN fields ELSE 0 END) AS BIGINT) AS fields, count(*) FILTER (active BETWEEN 1 AND 7) AS suppressed FROM s GROUP BY 1""")
def state_band_counts(x):
    live = F.col("score") > 0.9
    sl = x.cm.groupBy("match_id", "slot_index").agg(F.count_if(live).alias("active"), F.count_distinct(F.when(live, F.col("metric"))).alias("fields"))
    return sl.groupBy("match_id").agg(
        F.count("*").alias("slots"), F.sum(F.when(F.col("active") >= 8, F.col("fields")).otherwise(0)).alias("fields"), F.count_if(F.col("active").between(1, 7)).alias("suppressed")
    )


@query("D83_state_coverage", """SELECT version_group, count(DISTINCT (match_id, participant_id)) AS rows, count(DISTINCT (match_id, participant_id, metric)) AS metric_series, count(DISTINCT (match_id, participant_id)) FILTER (family_key = 'R') AS local_rows FROM {cm} GROUP BY 1""")
def state_coverage(x):
    c = x.cm.groupBy("version_group", "match_id", "participant_id").agg(
        F.count_distinct("metric").alias("m"), F.bool_or(F.col("family_key") == "R").alias("local")
    )
    return c.groupBy("version_group").agg(F.count("*").alias("rows"), F.sum("m").alias("metric_series"), F.count_if("local").alias("local_rows"))


@query("D84_merged_count_maps", "SELECT version_group, metric AS name, count(*) AS n FROM {cm} GROUP BY 1, 2")
def merged_count_maps(x):
    per = x.cm.groupBy("version_group", "match_id", "metric").agg(F.count("*").alias("n"))
    maps = per.groupBy("version_group", "match_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "n"))).alias("counts"))
    return r.merge_count_maps(maps, ["version_group"], "counts")


@query("D85_inspect_metric", f"""SELECT match_id, family_key, slot_index, participant_id, R6(score) AS score, R6(correlation) AS correlation, CASE WHEN score >= 0.95 AND correlation >= 0.5 THEN 'hit' ELSE 'near_miss' END AS verdict FROM {{cm}} WHERE metric = 'm3' {WIN} LIMIT 40""")
def inspect_metric(x):
    """Top-40 report of one metric."""
    hit = (F.col("score") >= 0.95) & (F.col("correlation") >= 0.5)
    top = x.cm.filter("metric = 'm3'").orderBy(*win()).limit(40)
    return top.select("match_id", "family_key", "slot_index", "participant_id", "score", "correlation", F.when(hit, "hit").otherwise("near_miss").alias("verdict"))
