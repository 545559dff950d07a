"""Assignment, selection and layout over the candidate-match view."""

from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import assign as a
from eventloom.operators import matching as m
from eventloom.operators import multiview as mv
from eventloom.operators import ordered as o
from eventloom.operators import quantiles as q
from eventloom.operators import sequences as sq
from eventloom.operators import series as sr
from eventloom.operators import timejoin as tj
from eventloom.plans.registry import query
from eventloom.plans.scorecards import WIN, win
from eventloom.plans.standins import DAY_MS
from eventloom.session import cut_lineage

GROUP = ["match_id", "family_key"]
EDGE = """WITH e AS (SELECT match_id, family_key, slot_index, participant_id, max(score + correlation / 10) AS score FROM {cm} GROUP BY 1, 2, 3, 4)"""


def _edges(x):
    return a.edges(x.cm, GROUP, "slot_index", "participant_id", F.col("score") + F.col("correlation") / 10)


@query("J28_greedy_assignment", EDGE.replace("WITH e", "WITH RECURSIVE e") + """, r AS (SELECT *, row_number() OVER (PARTITION BY match_id, family_key ORDER BY score DESC, slot_index, participant_id) AS n FROM e), z AS (SELECT match_id, family_key, max(n) AS mx FROM r GROUP BY 1, 2),
w AS (SELECT match_id, family_key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS us, CAST(0 AS BIGINT) AS ue, false AS took FROM z UNION ALL
 SELECT w.match_id, w.family_key, r.n, CASE WHEN t THEN us | (1 << slot_index) ELSE us END, CASE WHEN t THEN ue | (1 << participant_id) ELSE ue END, t FROM (SELECT w.*, r.n AS rn FROM w JOIN r ON r.match_id = w.match_id AND r.family_key = w.family_key AND r.n = w.n + 1) w
 JOIN (SELECT * FROM r) r ON r.match_id = w.match_id AND r.family_key = w.family_key AND r.n = w.rn, LATERAL (SELECT (us >> slot_index) & 1 = 0 AND (ue >> participant_id) & 1 = 0 AS t))
SELECT r.match_id, r.family_key, slot_index, participant_id, R6(score) AS score FROM w JOIN r ON r.match_id = w.match_id AND r.family_key = w.family_key AND r.n = w.n WHERE took""")
def greedy_assignment(x):
    return a.greedy_assignment(_edges(x), GROUP, "slot_index", "participant_id")


@query("J29_optimal_assignment", EDGE.replace("WITH e", "WITH RECURSIVE e") + """, g AS (SELECT DISTINCT match_id, family_key FROM e), lim AS (SELECT max(participant_id) AS hi FROM e),
d AS (SELECT match_id, family_key, CAST(-1 AS BIGINT) AS p, CAST(0 AS BIGINT) AS used, CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n FROM g UNION ALL
 SELECT match_id, family_key, p, used, max(total), max(n) FROM (
  SELECT d.match_id, d.family_key, d.p + 1 AS p, d.used, d.total, d.n FROM d WHERE d.p < (SELECT hi FROM lim) UNION ALL
  SELECT d.match_id, d.family_key, d.p + 1, d.used | (1 << e.slot_index), d.total + e.score, d.n + 1 FROM d JOIN e ON e.match_id = d.match_id AND e.family_key = d.family_key AND e.participant_id = d.p + 1
  WHERE (d.used >> e.slot_index) & 1 = 0) GROUP BY 1, 2, 3, 4)
SELECT match_id, family_key, max(n) AS assigned, R6(max(total)) AS total FROM (SELECT *, max(total) OVER (PARTITION BY match_id, family_key) AS best FROM d WHERE p = (SELECT hi FROM lim)) WHERE total > best - 1e-9 GROUP BY 1, 2""")
def optimal_assignment(x):
    out = a.optimal_assignment(_edges(x), GROUP, "slot_index", "participant_id")
    return out.groupBy(*GROUP).agg(F.count("*").alias("assigned"), F.sum("score").alias("total"))


@query("J30_independent_assignment", EDGE + " SELECT match_id, family_key, slot_index, participant_id, R6(score) AS score FROM e QUALIFY row_number() OVER (PARTITION BY match_id, family_key, slot_index ORDER BY score DESC, participant_id) = 1")
def independent_assignment(x):
    return a.independent_best(_edges(x), GROUP, "slot_index", "participant_id")


TRAJ = """WITH p AS (SELECT match_id, entity, 100 * value AS x, CAST(150 * k AS DOUBLE) AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY match_id, entity) AS n, sqrt(power(100 * value - lag(100 * value) OVER w, 2) + power(150 * k - lag(150 * k) OVER w, 2)) AS st FROM {ev} WINDOW w AS (PARTITION BY match_id, entity ORDER BY t, event_id)),
g AS (SELECT match_id, entity, max(x) FILTER (i = 1) AS sx, max(y) FILTER (i = 1) AS sy, coalesce(max(x) FILTER (i = 2), max(x) FILTER (i = 1)) AS ex, coalesce(max(y) FILTER (i = 2), max(y) FILTER (i = 1)) AS ey, count(DISTINCT (floor(x + 0.5), floor(y + 0.5))) / count(*) AS ur,
 least(1, greatest(0, least(1, (max(x) - min(x) + max(y) - min(y)) / 6000) * 0.45 + least(1, coalesce(sum(st), 0) / 9000) * 0.35 + count(DISTINCT (floor(x + 0.5), floor(y + 0.5))) / count(*) * 0.2)) AS mq, count(*) AS n FROM p GROUP BY 1, 2),
f AS (SELECT g.*, far, CASE WHEN far THEN 14500 ELSE 500 END AS hx, CASE WHEN far THEN 500 ELSE 14500 END AS qx, CASE WHEN far THEN 12500 ELSE 2500 END AS rx, CASE WHEN far THEN 2500 ELSE 12500 END AS ry, least(1, n / 20) AS ax, least(1, n / 25) AS mn, least(1, n / 30) AS rg FROM g, (SELECT unnest([true, false]) AS far)),
c AS (SELECT *, least(1, greatest(0, 1 / (1 + sqrt(power(sx - hx, 2) + power(sy - hx, 2)) / 4000) - 0.8 / (1 + sqrt(power(sx - qx, 2) + power(sy - qx, 2)) / 4000))) AS team, 1 / (1 + sqrt(power(ex - rx, 2) + power(ey - ry, 2)) / 3500) AS role, 1 / (1 + sqrt(power(ex - 7500, 2) + power(ey - 7500, 2)) / 8000) AS center,
 least(1, greatest(0, mq * 0.75 + least(1, ur) * 0.25)) AS traj, least(1, greatest(0, 0.26 * ax + 0.15 * ax + 0.16 * mn + 0.12 * ax + 0.15 * (1 - 0.2) + 0.11 * rg + 0.1 * 1 + 0.1 * mq)) AS ql FROM f),
z AS (SELECT *, CASE n % 6 WHEN 0 THEN 1 WHEN 1 THEN 0.65 WHEN 2 THEN 0.4 WHEN 5 THEN 0 ELSE 0.15 END * 0.1 + least(1, n / 40) * 0.1 + least(1, greatest(0, mq)) * 0.05 + CASE WHEN n >= 30 THEN 0.1 ELSE 0 END + least(1, ur) * 0.05 AS known, CASE WHEN ql < 0.55 THEN ql / 0.55 ELSE 1 END * CASE WHEN mn < 0.25 THEN mn / 0.25 ELSE 1 END * CASE WHEN rg < 0.4 THEN rg / 0.4 ELSE 1 END * CASE WHEN ax < 0.1 THEN greatest(0.35, ax / 0.1) ELSE 1 END * CASE WHEN mq < 0.2 THEN mq / 0.2 ELSE 1 END AS gate FROM c)
SELECT match_id, entity, far AS far_team, 'default' AS profile, R6((0.14 * team + 0.18 * role + 0.08 * center + 0.12 * traj + 0.12 * mn + 0.11 * rg + known) * (0.45 + 0.55 * ql) * gate) AS score FROM z UNION ALL
SELECT match_id, entity, far, 'reduced-role-anchor', R6((0.18 * team + 0.08 * role + 0.08 * center + 0.16 * traj + 0.14 * mn + 0.12 * rg + known) * (0.45 + 0.55 * ql) * gate) FROM z"""


@query("J31_entity_participant_score", TRAJ)
def entity_participant_score(x):
    """Trajectory of every entity scored against both teams under both weight profiles."""
    keys = ["match_id", "entity"]
    p = x.ev.select("match_id", "entity", "t", "event_id", (100 * F.col("value")).alias("x"), (150 * F.col("k")).cast("double").alias("y"))
    order = ["t", "event_id"]
    tr = sr.trajectory(p, keys, order, o.time_block("t", DAY_MS), "x", "y")
    spot = F.struct(*order)
    two = o.top_k(p, keys, [F.asc("t"), F.asc("event_id")], 2, "i")
    ends = two.groupBy(*keys).agg(
        F.min_by("x", spot).alias("sx"), F.min_by("y", spot).alias("sy"), F.max_by("x", spot).alias("ex"), F.max_by("y", spot).alias("ey")
    )
    d = tr.join(ends, keys).withColumn("far_team", F.explode(F.array(F.lit(True), F.lit(False))))
    c, n = F.col, F.col("points")
    axis, low, rng = F.least(F.lit(1.0), n / 20), F.least(F.lit(1.0), n / 25), F.least(F.lit(1.0), n / 30)
    parts = a.position_components((c("sx"), c("sy")), (c("ex"), c("ey")), (500.0, 500.0), (F.lit(2500.0), F.lit(12500.0)), c("far_team"))
    parts["trajectory"] = s.clamp(c("quality") * 0.75 + F.least(F.lit(1.0), c("unique_ratio")) * 0.25)
    parts["min_axis"], parts["range"] = low, rng
    # stand-ins for what other tables say of an entity: slot gap, support, validator and priors
    parts["scalar"], parts["support"], parts["validator"] = a.slot_nearness(n % 6), F.least(F.lit(1.0), n / 40), s.clamp(c("quality"))
    parts["exact_prior"], parts["family_prior"] = F.when(n >= 30, 1.0).otherwise(0.0), F.least(F.lit(1.0), c("unique_ratio"))
    ql = a.entity_quality(axis, low, axis, axis, F.lit(0.2), rng, F.lit(1.0), c("quality"))
    gate = a.evidence_gate(ql, low, rng, axis, c("quality"))
    return a.weighted_score(d, parts, ql, gate).select("match_id", "entity", "far_team", "profile", "score")


CONF = EDGE + """, t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY match_id, family_key, slot_index ORDER BY score DESC, participant_id) = 1)
SELECT t.match_id, t.family_key, t.slot_index, t.participant_id, R6(t.score) AS assigned_score, R6((SELECT max(e.score) FROM e WHERE e.match_id = t.match_id AND e.family_key = t.family_key AND e.slot_index = t.slot_index AND e.participant_id <> t.participant_id)) AS best_other_entity,
 (SELECT count(*) FROM e WHERE e.match_id = t.match_id AND e.family_key = t.family_key AND e.slot_index = t.slot_index AND e.participant_id <> t.participant_id AND e.score > t.score) + 1 AS owner_rank,
 R6((SELECT max(e.score) FROM e WHERE e.match_id = t.match_id AND e.family_key = t.family_key AND e.participant_id = t.participant_id AND e.slot_index <> t.slot_index)) AS best_other_slot FROM t"""


@query("J32_assignment_confidence", CONF)
def assignment_confidence(x):
    e = _edges(x)
    out = a.confidence(a.independent_best(e, GROUP, "slot_index", "participant_id"), e, GROUP, "slot_index", "participant_id", 0.05)
    return out.select(*GROUP, "slot_index", "participant_id", "assigned_score", "best_other_entity", "owner_rank", "best_other_slot")


@query("J33_final_stat_edges", """WITH v AS (SELECT match_id, slot_index, metric, max_by(overlap, (o1, o3, o4)) AS val, count(*) AS n FROM {cm} GROUP BY 1, 2, 3), f AS (SELECT match_id, participant_id, metric, max(overlap) AS target FROM {cm} GROUP BY 1, 2, 3),
dup AS (SELECT match_id, metric, target, count(*) AS c FROM f GROUP BY 1, 2, 3), s AS (SELECT v.match_id, slot_index, participant_id, v.metric, greatest(0, 1 - abs(val - f.target) / greatest(f.target * 0.35, 5)) AS fit FROM v JOIN f ON v.match_id = f.match_id AND v.metric = f.metric JOIN dup d ON d.match_id = f.match_id AND d.metric = f.metric AND d.target = f.target WHERE c <= 3 AND n >= 3)
SELECT match_id, slot_index, participant_id, count(*) AS metrics, R6(sum(fit)) AS total, CASE WHEN count(*) >= 4 AND sum(fit) >= 3.5 THEN 'canonical' ELSE 'diagnostic' END AS class FROM s WHERE fit >= 0.5 GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def final_stat_edges(x):
    """Relative-error fit of a slot's last value to each final stat; ambiguous targets drop out."""
    v = x.cm.groupBy("match_id", "slot_index", "metric").agg(F.max_by("overlap", F.struct("o1", "o3", "o4")).alias("val"), F.count("*").alias("n")).filter("n >= 3")
    f = x.cm.groupBy("match_id", "participant_id", "metric").agg(F.max("overlap").alias("target"))
    dup = f.groupBy("match_id", "metric", "target").agg(F.count("*").alias("c")).filter("c <= 3")
    e = v.join(f.join(dup, ["match_id", "metric", "target"]), ["match_id", "metric"])
    fit = F.greatest(F.lit(0.0), 1 - F.abs(F.col("val") - F.col("target")) / F.greatest(F.col("target") * 0.35, F.lit(5.0)))
    e = e.withColumn("fit", fit).filter("fit >= 0.5")
    out = e.groupBy("match_id", "slot_index", "participant_id").agg(F.count("*").alias("metrics"), F.sum("fit").alias("total")).filter("metrics >= 2")
    return out.withColumn("class", F.when((F.col("metrics") >= 4) & (F.col("total") >= 3.5), "canonical").otherwise("diagnostic"))


@query("J34_leader_clusters", """WITH RECURSIVE e AS (SELECT version_group, family_key, slope, max(score) AS sc, avg(intercept) AS icpt FROM {cm} GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY version_group, family_key ORDER BY -sc, slope) AS n FROM e),
w AS (SELECT DISTINCT version_group, family_key, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(s DOUBLE, i DOUBLE)[]) AS ls, CAST(0 AS BIGINT) AS cluster, CAST(0 AS DOUBLE) AS slope FROM e
 UNION ALL SELECT version_group, family_key, n, CASE WHEN top >= 0.58 THEN ls ELSE list_append(ls, {{'s': CAST(slope AS DOUBLE), 'i': CAST(icpt AS DOUBLE)}}) END, CASE WHEN top >= 0.58 THEN list_position(likes, top) - 1 ELSE len(ls) END, slope
 FROM (SELECT *, coalesce(list_max(likes), -1) AS top FROM (SELECT r.*, w.ls, [sqrt((1 / (1 + abs(r.slope - l.s) / greatest(abs(l.s) * 0.5, 1e-9))) * (1 / (1 + abs(r.icpt - l.i) / greatest(abs(l.i) * 0.1, 400.0)))) FOR l IN w.ls] AS likes
  FROM w JOIN r ON r.version_group = w.version_group AND r.family_key = w.family_key AND r.n = w.n + 1)))
SELECT version_group, family_key, cluster, count(*) AS members, min(slope) AS low, max(slope) AS high FROM w WHERE n > 0 GROUP BY 1, 2, 3""".replace("{{", "{").replace("}}", "}"))
def leader_clusters(x):
    """Clusters of similar transforms per band, in falling score order."""
    e = x.cm.groupBy("version_group", "family_key", "slope").agg(F.max("score").alias("sc"), F.avg("intercept").alias("icpt"), F.count("*").alias("n"))
    e = e.withColumn("rank_key", -F.col("sc"))
    out = a.leader_clusters(e, ["version_group", "family_key"], ["rank_key", "slope"], "slope", "icpt", 0.58)
    return out.groupBy("version_group", "family_key", "cluster").agg(F.count("*").alias("members"), F.min("slope").alias("low"), F.max("slope").alias("high"))


@query("J35_sibling_bundles", """WITH c AS (SELECT version_group, family_key, metric, slot_index, avg(score) AS score FROM {cm} GROUP BY 1, 2, 3, 4), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY version_group, family_key, metric ORDER BY round(score, 9) DESC, slot_index) <= 3),
n AS (SELECT a.version_group, a.family_key, a.metric AS am, a.slot_index AS asl, a.score AS asc1, b.metric, b.slot_index, b.score FROM t a JOIN t b ON a.version_group = b.version_group AND a.family_key = b.family_key AND a.metric <> b.metric AND abs(a.slot_index - b.slot_index) <= 2),
p AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY version_group, family_key, am, asl, metric ORDER BY abs(slot_index - asl), round(score, 9) DESC, slot_index) = 1)
SELECT version_group, family_key, am AS anchor_metric, asl AS anchor_slot, count(*) + 1 AS metrics, least(min(slot_index), asl) AS band_start, greatest(max(slot_index), asl) AS band_end, R6(1 / (1 + (greatest(max(slot_index), asl) - least(min(slot_index), asl)) / 4)) AS compactness, R6((sum(score) + max(asc1)) / (count(*) + 1)) AS average_score FROM p GROUP BY 1, 2, 3, 4""")
def sibling_bundles(x):
    c = x.cm.groupBy("version_group", "family_key", "metric", "slot_index").agg(F.round(F.avg("score"), 9).alias("score"))
    return a.sibling_bundles(c, ["version_group", "family_key"], "metric", "slot_index", "score", 2, 3)


@query("J36_viable_bundles", """WITH b AS (SELECT version_group, family_key, slot_index, count(DISTINCT metric) AS metrics, avg(score) AS score, count(DISTINCT match_id) AS support FROM {cm} WHERE correlation >= 0.5 GROUP BY 1, 2, 3), v AS (SELECT * FROM b WHERE metrics >= 3 AND score >= 0.49 AND support >= 10)
SELECT version_group, family_key, slot_index, metrics, support, R6(score) AS score, row_number() OVER (PARTITION BY version_group, family_key ORDER BY round(score, 9) DESC, slot_index) = 1 AS is_primary FROM v""")
def viable_bundles(x):
    b = x.cm.filter("correlation >= 0.5").groupBy("version_group", "family_key", "slot_index").agg(
        F.count_distinct("metric").alias("metrics"), F.round(F.avg("score"), 9).alias("score"), F.count_distinct("match_id").alias("support")
    ).filter("metrics >= 3 AND score >= 0.49 AND support >= 10")
    first = o.best(b, ["version_group", "family_key"], [F.desc("score"), F.asc("slot_index")]).select("version_group", "family_key", F.col("slot_index").alias("p"))
    return b.join(first, ["version_group", "family_key"]).withColumn("is_primary", F.col("slot_index") == F.col("p")).drop("p")


@query("J38_diverse_selection", """WITH c AS (SELECT CAST(match_id AS VARCHAR) AS fam, family_key || ':' || CAST(slot_index AS VARCHAR) || ':' || metric AS pk2, max(score * correlation) AS sc FROM {cm} GROUP BY 1, 2), g AS (SELECT * FROM c WHERE sc >= 0.6), r AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY sc DESC, pk2) AS fr, max(sc) OVER (PARTITION BY fam) AS best FROM g)
SELECT fam, pk2, R6(sc) AS sc, fr AS family_rank FROM r WHERE fr <= 150 ORDER BY fr > 1, best DESC, fam, fr LIMIT 150""")
def diverse_selection(x):
    c = x.cm.groupBy(F.col("match_id").cast("string").alias("fam"), F.concat_ws(":", "family_key", "slot_index", "metric").alias("pk2")).agg(
        F.max(F.col("score") * F.col("correlation")).alias("sc")
    ).filter("sc >= 0.6")
    return a.diverse_selection(c, "fam", "sc", "pk2", 150)


@query("J50_source_priority_union", """WITH p AS (SELECT metric, family_key || ':' || CAST(slot_index AS VARCHAR) AS k2, max(score) FILTER (version_group = 'O') AS a, max(correlation) FILTER (version_group = 'F') AS b FROM {cm} GROUP BY 1, 2),
u AS (SELECT metric, k2, a AS score, 'promoted' AS source, 0 AS pr FROM p WHERE a >= 1 UNION ALL SELECT metric, k2, b, 'fallback', 1 FROM p WHERE b >= 0.9), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY metric, k2 ORDER BY pr, score DESC) = 1)
SELECT metric, k2, R6(score) AS score, source FROM d QUALIFY row_number() OVER (PARTITION BY metric ORDER BY pr, score DESC, k2) <= 12""")
def source_priority_union(x):
    p = x.cm.groupBy("metric", F.concat_ws(":", "family_key", "slot_index").alias("k2")).agg(
        F.max(F.when(F.col("version_group") == "O", F.col("score"))).alias("a"), F.max(F.when(F.col("version_group") == "F", F.col("correlation"))).alias("b")
    )
    promoted = p.filter("a >= 1").select("metric", "k2", F.col("a").alias("score"))
    fallback = p.filter("b >= 0.9").select("metric", "k2", F.col("b").alias("score"))
    return a.priority_union([("promoted", promoted), ("fallback", fallback)], "k2", "score", ["metric"], 12)


@query("J51_supplement_patterns", """WITH p AS (SELECT family_key, slot_index, metric, count(*) AS n, count(DISTINCT participant_id) AS parts, avg(score) AS sc, avg(correlation) AS c FROM {cm} WHERE correlation >= 0.6 AND nrmse <= 0.5 GROUP BY 1, 2, 3)
SELECT family_key, slot_index, metric, n, parts AS participants, R6(sc * (0.5 + least(1, parts / 4)) * (0.5 + c)) AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY metric ORDER BY round(sc * (0.5 + least(1, parts / 4)) * (0.5 + c), 9) DESC, family_key, slot_index) <= 6""")
def supplement_patterns(x):
    p = x.cm.filter("correlation >= 0.6 AND nrmse <= 0.5").groupBy("family_key", "slot_index", "metric").agg(
        F.count("*").alias("n"), F.count_distinct("participant_id").alias("participants"), F.avg("score").alias("sc"), F.avg("correlation").alias("c")
    )
    conf = F.col("sc") * (0.5 + F.least(F.lit(1.0), F.col("participants") / 4)) * (0.5 + F.col("c"))
    p = p.withColumn("confidence", conf).drop("sc", "c")
    return o.top_k(p, ["metric"], [F.desc(F.round("confidence", 9)), F.asc("family_key"), F.asc("slot_index")], 6)


@query("J52_best_transform", """WITH l AS (SELECT entity, median(tx / greatest(rx, 1)) AS sl FROM {pair} GROUP BY 1), v AS (SELECT match_id, p.entity, tr, t, event_id, CASE tr WHEN 'learned' THEN sl ELSE 1 END * rx AS v, tx FROM {pair} p JOIN l USING (entity), (SELECT unnest(['learned', 'identity']) AS tr)),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY match_id, entity, tr ORDER BY t, event_id) AS d FROM v), g AS (SELECT match_id, entity, tr, max_by(v, (t, event_id)) AS lv, max_by(tx, (t, event_id)) AS lt, avg(CASE WHEN v BETWEEN 0 AND 15000 THEN 1.0 ELSE 0 END) AS rg, count(d) AS n, count(*) FILTER (d >= -1e-6) AS up, count(*) FILTER (abs(d) > 6500) AS j FROM d GROUP BY 1, 2, 3),
s AS (SELECT *, 0.7 * greatest(0, 1 - abs(lv - lt) / greatest(lt * 0.35, 100)) + 0.3 * (0.7 * rg + 0.3 * CASE WHEN n > 0 THEN up / n ELSE 1 END) * CASE WHEN n > 0 AND j > 0 THEN greatest(0.22, 1 - 1.35 * j / n) ELSE 1 END AS score FROM g)
SELECT match_id, entity, tr AS transform, R6(score) AS score FROM s QUALIFY row_number() OVER (PARTITION BY match_id, entity ORDER BY round(score, 9) DESC, tr) = 1""")
def best_transform(x):
    """Learned median slope or identity, by .7 final-value fit + .3 plausibility."""
    # the slope reads the pairs several times
    p = cut_lineage(x.pair.withColumn("ratio", F.col("tx") / F.greatest("rx", F.lit(1.0))))
    learned = q.quantiles(p, ["entity"], "ratio", {"sl": 0.5})
    v = p.join(learned, "entity").withColumn("transform", F.explode(F.array(F.lit("learned"), F.lit("identity"))))
    v = v.withColumn("v", F.when(F.col("transform") == "learned", F.col("sl")).otherwise(1.0) * F.col("rx"))
    keys, order = ["match_id", "entity", "transform"], ["t", "event_id"]
    pl = sq.plausible_series(v, keys, order, o.time_block("t", DAY_MS), "v", 0, 15000, 6500)
    spot = F.struct(*order)
    last = v.groupBy(*keys).agg(F.max_by("v", spot).alias("lv"), F.max_by("tx", spot).alias("lt"))
    fit = F.greatest(F.lit(0.0), 1 - F.abs(F.col("lv") - F.col("lt")) / F.greatest(F.col("lt") * 0.35, F.lit(100.0)))
    out = last.join(pl, keys).withColumn("score", 0.7 * fit + 0.3 * F.col("plausibility"))
    # only the choice is made on nine digits; rounding the score twice would move its sixth digit
    return o.best(out, ["match_id", "entity"], [F.desc(F.round("score", 9)), F.asc("transform")]).select("match_id", "entity", "transform", "score")


@query("J53_candidate_rows", """WITH b AS (SELECT family_key, metric, min(slot_index) AS s0, least(min(slot_index) + 2, max(slot_index)) AS s1 FROM {cm} GROUP BY 1, 2), r AS (SELECT family_key, metric, slot_index FROM {cm} GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY family_key, metric ORDER BY count(*) DESC, slot_index) <= 2),
u AS (SELECT family_key, metric, unnest(range(s0, s1 + 1)) AS slot_index FROM b UNION SELECT * FROM r) SELECT family_key, metric, slot_index, count(*) AS samples, R6(avg(CASE WHEN overlap BETWEEN 5 AND 45 THEN 1.0 ELSE 0 END)) AS in_bounds FROM u JOIN {cm} USING (family_key, metric, slot_index) GROUP BY 1, 2, 3 HAVING avg(CASE WHEN overlap BETWEEN 5 AND 45 THEN 1.0 ELSE 0 END) >= 0.8""")
def candidate_rows(x):
    keys = ["family_key", "metric"]
    b = x.cm.groupBy(*keys).agg(F.min("slot_index").alias("s0"), F.max("slot_index").alias("mx"))
    band = b.select(*keys, F.explode(F.sequence("s0", F.least(F.col("s0") + 2, F.col("mx")))).alias("slot_index"))
    c = x.cm.groupBy(*keys, "slot_index").agg(F.count("*").alias("n"))
    rec = o.top_k(c, keys, [F.desc("n"), F.asc("slot_index")], 2).select(*keys, "slot_index")
    rows = x.cm.join(band.union(rec).distinct(), [*keys, "slot_index"], "left_semi")
    ok = s.ratio(F.col("overlap").between(5, 45))
    return rows.groupBy(*keys, "slot_index").agg(F.count("*").alias("samples"), ok.alias("in_bounds")).filter("in_bounds >= 0.8")


ANCH = f"""WITH b AS (SELECT match_id, family_key, metric, participant_id, slot_index, score FROM {{cm}} QUALIFY row_number() OVER (PARTITION BY match_id, family_key, metric, participant_id {WIN}) = 1),
m0 AS (SELECT match_id, family_key, participant_id, slot_index AS anchor FROM b WHERE metric = 'm0'), d AS (SELECT b.family_key, b.slot_index - anchor AS delta, count(*) AS n FROM b JOIN m0 USING (match_id, family_key, participant_id) WHERE metric = 'm1' GROUP BY 1, 2),
dd AS (SELECT family_key, delta FROM d QUALIFY row_number() OVER (PARTITION BY family_key ORDER BY n DESC, delta) = 1), t AS (SELECT match_id, family_key, slot_index, max(score) AS score FROM {{cm}} WHERE metric = 'm1' GROUP BY 1, 2, 3)
SELECT t.match_id, t.family_key, t.slot_index, m0.participant_id, abs(t.slot_index - (anchor + delta)) AS distance FROM t JOIN dd USING (family_key) JOIN m0 ON m0.match_id = t.match_id AND m0.family_key = t.family_key AND abs(t.slot_index - (anchor + delta)) <= 1
QUALIFY row_number() OVER (PARTITION BY t.match_id, t.family_key, t.slot_index ORDER BY abs(t.slot_index - (anchor + delta)), m0.participant_id) = 1"""


def _best_slots(x):
    keys = [*GROUP, "metric", "participant_id"]
    return o.best(x.cm, keys, win()).select(*keys, "slot_index", "score")


@query("J54_anchored_identity", ANCH)
def anchored_identity(x):
    """Entity of a slot from the anchor metric's slot plus the family's dominant slot delta."""
    b = _best_slots(x)
    m0 = b.filter("metric = 'm0'").select(*GROUP, "participant_id", F.col("slot_index").alias("anchor"))
    d = b.filter("metric = 'm1'").join(m0, [*GROUP, "participant_id"]).withColumn("delta", F.col("slot_index") - F.col("anchor"))
    d = d.groupBy("family_key", "delta").agg(F.count("*").alias("n"))
    d = o.best(d, ["family_key"], [F.desc("n"), F.asc("delta")]).select("family_key", "delta")
    spot = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    reach = m0.join(d, "family_key").withColumn("off", spot).withColumn("slot_index", F.col("anchor") + F.col("delta") + F.col("off"))
    t = x.cm.filter("metric = 'm1'").select(*GROUP, "slot_index").distinct()
    hit = t.join(reach, [*GROUP, "slot_index"]).withColumn("distance", F.abs("off"))
    return o.best(hit, [*GROUP, "slot_index"], [F.asc("distance"), F.asc("participant_id")]).select(*GROUP, "slot_index", "participant_id", "distance")


@query("J39_prototype_export", """WITH act AS (SELECT match_id, entity FROM (SELECT match_id, entity, count(*) AS n FROM {pair} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY n DESC, entity) = 1),
f AS (SELECT match_id, t // 86400000 AS frame, median(rx) AS raw, median(tx) AS target FROM {pair} SEMI JOIN act USING (match_id, entity) GROUP BY 1, 2), g AS (SELECT match_id, regr_slope(target, raw) AS a, regr_intercept(target, raw) AS b, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 3 AND regr_sxx(target, raw) > 1e-6)
SELECT match_id, any_value(n) AS frames, R6(any_value(a)) AS slope, R6(avg(abs(a * raw + b - target))) AS mean_error, R6(max(abs(a * raw + b - target))) AS max_error FROM f JOIN g USING (match_id) GROUP BY 1""")
def prototype_export(x):
    """Most active field per match, median per frame, fitted to the oracle, with its errors."""
    n = x.pair.groupBy("match_id", "entity").agg(F.count("*").alias("n"))
    act = o.best(n, ["match_id"], [F.desc("n"), F.asc("entity")]).select("match_id", "entity")
    rows = x.pair.join(act, ["match_id", "entity"], "left_semi").withColumn("frame", F.floor(F.col("t") / DAY_MS))
    f = q.medians(rows.select("match_id", "frame", F.col("rx").alias("raw"), F.col("tx").alias("target")), ["match_id", "frame"], ["raw", "target"], "")
    g = f.groupBy("match_id").agg(s.affine("raw", "target").alias("fit")).filter("fit.n >= 3 AND fit.valid")
    e = F.abs(F.col("fit.slope") * F.col("raw") + F.col("fit.intercept") - F.col("target"))
    return f.join(g, "match_id").groupBy("match_id").agg(F.max("fit.n").alias("frames"), F.max("fit.slope").alias("slope"), F.avg(e).alias("mean_error"), F.max(e).alias("max_error"))


LAYOUT = f"""WITH b AS (SELECT match_id, family_key, metric, participant_id, slot_index FROM {{cm}} QUALIFY row_number() OVER (PARTITION BY match_id, family_key, metric, participant_id {WIN}) = 1),
pr AS (SELECT *, list_position(['m2', 'm5', 'm0', 'm7'], metric) AS p FROM b), an AS (SELECT match_id, participant_id, metric AS am, slot_index AS asl FROM pr WHERE p IS NOT NULL AND p > 0 QUALIFY row_number() OVER (PARTITION BY match_id, participant_id ORDER BY p, slot_index) = 1),
d AS (SELECT b.metric, am, b.slot_index - asl AS delta, count(*) AS n FROM b JOIN an USING (match_id, participant_id) GROUP BY 1, 2, 3)
SELECT am AS anchor_metric, metric, delta, n, row_number() OVER (PARTITION BY am, metric ORDER BY n DESC, delta) = 1 AS dominant FROM d"""


@query("J40_family_layout", LAYOUT)
def family_layout(x):
    d = a.layout_deltas(_best_slots(x), ["match_id", "participant_id"], "metric", "slot_index", ["m2", "m5", "m0", "m7"])
    d = d.groupBy("anchor_metric", "metric", "delta").agg(F.count("*").alias("n"))
    top = o.best(d, ["anchor_metric", "metric"], [F.desc("n"), F.asc("delta")]).select("anchor_metric", "metric", F.col("delta").alias("dd"))
    return d.join(top, ["anchor_metric", "metric"]).withColumn("dominant", F.col("delta") == F.col("dd")).drop("dd")


@query("J42_multiview_agreement", """WITH a AS (SELECT match_id, event_id, entity, 100 * value AS x, 150.0 * k AS y, t FROM {ev}), p AS (SELECT match_id, event_id, x, y, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS n FROM a WHERE entity = 'view'),
c AS (SELECT match_id, avg(x) AS cx, avg(y) AS cy FROM a WHERE entity = 'click' GROUP BY 1), r AS (SELECT p.*, q.x AS sx, q.y AS sy FROM p JOIN p q ON p.match_id = q.match_id AND q.i = (p.i + 1) % p.n)
SELECT match_id, count(*) AS rows, R6(avg(sqrt(power(x - cx, 2) + power(y - cy, 2)))) AS companion_distance, R6(avg(sqrt(power(sx - cx, 2) + power(sy - cy, 2)))) AS control_distance FROM r JOIN c USING (match_id) GROUP BY 1""")
def multiview_agreement(x):
    """Primary positions against the mean companion of the match, with a shuffled control on both axes."""
    e = x.ev.select("match_id", "event_id", "entity", "t", (100 * F.col("value")).alias("x"), (150.0 * F.col("k")).alias("y"))
    c = e.filter("entity = 'click'").groupBy("match_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    r = m.shuffled_control(e.filter("entity = 'view'"), ["match_id"], ["t", "event_id"], 1, ["x", "y"], o.time_block("t", DAY_MS)).join(c, "match_id")

    def far(px, py):
        return F.sqrt(F.pow(F.col(px) - F.col("cx"), F.lit(2.0)) + F.pow(F.col(py) - F.col("cy"), F.lit(2.0)))

    return r.groupBy("match_id").agg(F.count("*").alias("rows"), F.avg(far("x", "y")).alias("companion_distance"), F.avg(far("control_x", "control_y")).alias("control_distance"))


VIEWED = """WITH a AS (SELECT match_id, event_id, entity, t, 160000 * CAST(floor(value / 25) AS BIGINT) AS xr, 192000 * (k // 20) AS yr, CASE WHEN event_id % 7 <> 0 THEN 100 * value END AS ox, CASE WHEN event_id % 7 <> 0 THEN 150.0 * k END AS oy FROM {ev}),
cl AS (SELECT match_id, t, xr AS cx, yr AS cy FROM a WHERE entity = 'click'), pl AS (SELECT * FROM a WHERE entity IN ('view', 'error')),
b AS (SELECT pl.*, cl.t AS bt, cl.cx AS bx, cl.cy AS b_y FROM pl ASOF LEFT JOIN cl ON pl.match_id = cl.match_id AND pl.t >= cl.t), n AS (SELECT b.*, cl.t AS ft, cl.cx AS fx, cl.cy AS fy FROM b ASOF LEFT JOIN cl ON b.match_id = cl.match_id AND b.t < cl.t),
v AS (SELECT match_id, event_id, entity, t, xr, yr, ox, oy, CASE WHEN bt IS NULL OR ft - t < t - bt THEN fx ELSE bx END AS cx, CASE WHEN bt IS NULL OR ft - t < t - bt THEN fy ELSE b_y END AS cy FROM n)"""
DIVISORS = (1, 2, 4, 8, 16, 32, 64, 128, 256)


def _viewed(x):
    """Stand-in views: an event's own raw pair is its primary, that of the nearest click of the match its companion."""
    oracle = F.col("event_id") % 7 != 0
    a_ = x.ev.select(
        "match_id", "event_id", "entity", "t", (160000 * F.floor(F.col("value") / 25)).alias("xr"), (192000 * F.floor(F.col("k") / 20)).alias("yr"),
        F.when(oracle, 100 * F.col("value")).alias("ox"), F.when(oracle, 150.0 * F.col("k")).alias("oy"),
    )
    clicks = a_.filter("entity = 'click'").select("match_id", "event_id", "t", "xr", "yr")
    near = tj.nearest(a_.filter("entity IN ('view', 'error')"), clicks, ["match_id"], "t", "event_id", DAY_MS)
    return near.withColumns({"cx": F.col("near.xr"), "cy": F.col("near.yr")}).drop("near", "delta")


@query("J42_coordinate_divisors", VIEWED + f""", p AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS n FROM v WHERE entity = 'view' AND cx IS NOT NULL),
r AS (SELECT p.*, q.cx AS sx, q.cy AS sy, unnest({list(DIVISORS)}) AS divisor FROM p JOIN p q ON q.match_id = p.match_id AND q.i = (p.i + 97) % p.n),
g AS (SELECT divisor, count(*) AS rows, count(*) FILTER (cx / divisor BETWEEN 0 AND 15000 AND cy / divisor BETWEEN 0 AND 15000) AS in_bounds, count(*) FILTER (cx < 65536 AND cy < 65536) AS zero_high,
 avg(sqrt((cx / divisor - ox) * (cx / divisor - ox) + (cy / divisor - oy) * (cy / divisor - oy))) AS od, avg(sqrt((sx / divisor - ox) * (sx / divisor - ox) + (sy / divisor - oy) * (sy / divisor - oy))) AS cd FROM r GROUP BY 1)
SELECT CAST(divisor AS BIGINT) AS divisor, rows, in_bounds, zero_high, R6(od) AS oracle_distance, R6(cd) AS control_distance, R6(in_bounds / rows) AS in_bounds_rate, row_number() OVER (ORDER BY in_bounds / rows DESC, od, divisor) AS rank FROM g""")
def coordinate_divisors(x):
    """Divisors of the companion coordinates against the oracle, with a control 97 rows on."""
    rows = _viewed(x).filter("entity = 'view' AND cx IS NOT NULL")
    return mv.divisor_scores(rows, ["match_id"], ["t", "event_id"], o.time_block("t", DAY_MS), ("cx", "cy"), ("ox", "oy"), DIVISORS, 15000, 97)


@query("J42_primary_companion", VIEWED + """ SELECT match_id, count(*) AS decoded, count(*) FILTER (xr = cx AND yr = cy) AS exact, R6(avg(CASE WHEN xr = cx AND yr = cy THEN 1.0 ELSE 0 END)) AS exact_rate,
 R6(avg(sqrt(((xr - cx) / 64) * ((xr - cx) / 64) + ((yr - cy) / 64) * ((yr - cy) / 64)))) AS distance, R6(max(sqrt(((xr - cx) / 64) * ((xr - cx) / 64) + ((yr - cy) / 64) * ((yr - cy) / 64)))) AS most_distance FROM v WHERE entity = 'view' AND cx IS NOT NULL GROUP BY 1""")
def primary_companion(x):
    """Raw pairs of primary and companion that agree, and the distance of their positions."""
    return mv.pair_agreement(_viewed(x).filter("entity = 'view'"), ["match_id"], ("xr", "yr"), ("cx", "cy"), 64)


@query("J42_removal_agreement", VIEWED + """, c AS (SELECT p.match_id, p.event_id AS link, p.t, p.xr, p.yr, p.cx, p.cy, e.xr AS rxr, e.yr AS ryr, e.cx AS rcx, e.cy AS rcy FROM v p JOIN v e ON e.match_id = p.match_id AND e.entity = 'error' AND e.t BETWEEN p.t AND p.t + 86400000 WHERE p.entity = 'view' AND p.cx IS NOT NULL AND e.cx IS NOT NULL),
l AS (SELECT match_id, link, any_value(t) AS t, any_value(cx) AS cx, any_value(cy) AS cy, count(*) AS n, count(*) FILTER (cx = rcx AND cy = rcy) AS hits FROM c GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY t, link) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS ln FROM l), s AS (SELECT i.match_id, i.link, j.cx AS sx, j.cy AS sy FROM i JOIN i j ON j.match_id = i.match_id AND j.i = (i.i + 1) % i.ln WHERE i.ln > 1),
k AS (SELECT match_id, count(*) AS control_candidates, count(*) FILTER (sx = rcx AND sy = rcy) AS control_exact FROM c JOIN s USING (match_id, link) GROUP BY 1),
r AS (SELECT match_id, count(*) AS candidates, count(*) FILTER (cx = rcx AND cy = rcy) AS companion_exact, count(*) FILTER (xr = rxr AND yr = ryr) AS primary_exact, R6(avg(sqrt(((cx - rcx) / 64) * ((cx - rcx) / 64) + ((cy - rcy) / 64) * ((cy - rcy) / 64)))) AS distance FROM c GROUP BY 1)
SELECT match_id, links, any_exact, all_exact, two_candidates, two_both_exact, candidates, companion_exact, primary_exact, distance, coalesce(control_candidates, 0) AS control_candidates, coalesce(control_exact, 0) AS control_exact
FROM (SELECT match_id, count(*) AS links, count(*) FILTER (hits > 0) AS any_exact, count(*) FILTER (hits = n) AS all_exact, count(*) FILTER (n = 2) AS two_candidates, count(*) FILTER (n = 2 AND hits = 2) AS two_both_exact FROM l GROUP BY 1) JOIN r USING (match_id) LEFT JOIN k USING (match_id)""")
def removal_agreement(x):
    """Records within a day after a placement against the placement, companion and primary, with the next link as control."""
    v = _viewed(x).filter("cx IS NOT NULL")
    cols = ["match_id", "event_id", "t", "xr", "yr", "cx", "cy"]
    pairs = tj.within(v.filter("entity = 'view'").select(*cols), v.filter("entity = 'error'").select(*cols), ["match_id"], "t", DAY_MS).filter("r_t >= t").withColumnRenamed("event_id", "link")
    views = [{"primary": (f"{p}xr", f"{p}yr"), "companion": (f"{p}cx", f"{p}cy")} for p in ("", "r_")]
    return mv.removal_agreement(pairs, ["match_id"], "link", ["t", "link"], o.time_block("t", DAY_MS), *views, 64)
