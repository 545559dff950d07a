"""Quality gates and the remaining evidence joins."""

from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import gates as g
from eventloom.operators import matching as m
from eventloom.operators import ordered as o
from eventloom.operators import rollups as r
from eventloom.operators import series as sr
from eventloom.operators import timejoin as tj
from eventloom.plans.registry import query
from eventloom.plans.aggregates import SCORE_CTE
from eventloom.plans.scorecards import WIN, win
from eventloom.plans.standins import DAY_MS

RULES_SQL = "count(*) FILTER (NOT coalesce(value BETWEEN 0.05 AND 300, false)) AS value_range, count(*) FILTER (NOT coalesce(k BETWEEN 0 AND 98, false)) AS k_range, count(*) FILTER (NOT coalesce(entity IN ('click', 'view', 'error', 'purchase', 'signup'), false)) AS known_type"


def _rules():
    return {
        "value_range": F.col("value").between(0.05, 300), "k_range": F.col("k").between(0, 98),
        "known_type": F.col("entity").isin("click", "view", "error", "purchase", "signup"),
    }


@query("K1_event_contract", f"SELECT entity, count(*) AS rows, {RULES_SQL}, count(*) FILTER (NOT (value BETWEEN 0.05 AND 300)) + count(*) FILTER (NOT (k BETWEEN 0 AND 98)) = 0 AS passes FROM {{ev}} GROUP BY 1")
def event_contract(x):
    return g.contract_summary(x.ev, _rules(), ["entity"])


@query("K1_contract_violations", "SELECT event_id, 'value_range' AS violation FROM {ev} WHERE NOT (value BETWEEN 0.05 AND 300) UNION ALL SELECT event_id, 'k_range' FROM {ev} WHERE NOT (k BETWEEN 0 AND 98)")
def contract_violations(x):
    return g.contract(x.ev, _rules(), ["event_id"])


@query("K2_expected_count_gate", """WITH a AS (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT l_returnflag AS flag, count(*) FILTER (l_linestatus IN ('O', 'F')) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'Z', 5)
SELECT flag, a.n, e.n AS expected_n, a.n IS NOT DISTINCT FROM e.n AS passes FROM a FULL JOIN e USING (flag)""")
def expected_count_gate(x):
    li = x.lineitem.groupBy(F.col("l_returnflag").alias("flag"))
    actual = li.agg(F.count("*").alias("n"))
    off = F.when(F.col("flag") == "R", 1).otherwise(0)
    exp = x.lineitem.filter("l_linestatus IN ('O', 'F')").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")).withColumn("n", F.col("n") + off)
    exp = exp.unionByName(x.spark.range(1).select(F.lit("Z").alias("flag"), F.lit(5).cast("long").alias("n")))
    return g.expected_counts(actual, exp, ["flag"], ["n"])


@query("K3_breakdown_consistency", """SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price, part_total, coalesce(CAST(floor(o_totalprice) AS BIGINT) = part_total, part_total IS NULL AND o_totalprice IS NULL) AS consistent FROM orders FULL JOIN (SELECT l_orderkey AS o_orderkey, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS part_total FROM lineitem GROUP BY 1) USING (o_orderkey)""")
def breakdown_consistency(x):
    parents = x.orders.select("o_orderkey", F.floor("o_totalprice").alias("price"))
    parts = x.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.floor("l_extendedprice").alias("price"))
    return g.breakdown(parents, parts, ["o_orderkey"], "price")


@query("K4_ordering_sanity", """WITH p AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2), q AS (SELECT *, lag(s) OVER w AS ps, lag(l_linenumber) OVER w AS pr FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT l_orderkey, count(*) AS rows, count(*) FILTER (s > ps) AS rises, count(*) FILTER (l_linenumber <> coalesce(pr, 0) + 1) AS gaps FROM q GROUP BY 1""")
def ordering_sanity(x):
    p = x.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("score"))
    return g.ordering(p, ["l_orderkey"], "l_linenumber", "score")


@query("K6_blocker_class", """WITH sl AS (SELECT DISTINCT match_id, slot_index FROM {cm}), e AS (SELECT match_id, slot_index, max(score) AS sc FROM {cm} WHERE correlation >= 0.97 GROUP BY 1, 2), j AS (SELECT sl.match_id, count(*) AS slots, count(e.slot_index) AS with_edges, count(*) FILTER (sc >= 0.8) AS assigned, count(*) FILTER (sc >= 0.96) AS stable FROM sl LEFT JOIN e USING (match_id, slot_index) GROUP BY 1)
SELECT match_id, slots, with_edges, assigned, stable, CASE WHEN with_edges = 0 THEN 'slots-without-edges' WHEN assigned = 0 THEN 'slots-without-assignments' WHEN stable = 0 THEN 'unstable-only' ELSE 'none' END AS blocker FROM j""")
def blocker_class(x):
    sl = x.cm.select("match_id", "slot_index").distinct()
    e = x.cm.filter("correlation >= 0.97").groupBy("match_id", "slot_index").agg(F.max("score").alias("sc"))
    j = sl.join(e, ["match_id", "slot_index"], "left").groupBy("match_id").agg(
        F.count("*").alias("slots"), F.count("sc").alias("with_edges"), F.count_if(F.col("sc") >= 0.8).alias("assigned"), F.count_if(F.col("sc") >= 0.96).alias("stable")
    )
    cls = F.when(F.col("with_edges") == 0, "slots-without-edges").when(F.col("assigned") == 0, "slots-without-assignments").when(F.col("stable") == 0, "unstable-only").otherwise("none")
    return j.withColumn("blocker", cls)


@query("K7_schema_drift", """WITH a AS (SELECT family_key, slot_index, metric, max(overlap) AS peak, min(overlap) AS low FROM {cm} WHERE version_group = 'O' AND match_id < 40 GROUP BY 1, 2, 3), b AS (SELECT family_key, slot_index, metric, max(overlap) AS peak, min(overlap) AS low FROM {cm} WHERE version_group = 'F' AND match_id >= 60 GROUP BY 1, 2, 3)
SELECT family_key, slot_index, metric, CASE WHEN a.peak IS NULL THEN 'added' WHEN b.peak IS NULL THEN 'removed' WHEN a.peak <> b.peak OR a.low <> b.low THEN 'changed' ELSE 'same' END AS status,
 CASE WHEN a.peak IS NOT NULL AND b.peak IS NOT NULL AND (a.peak <> b.peak OR a.low <> b.low) THEN concat_ws(',', CASE WHEN a.peak <> b.peak THEN 'peak' END, CASE WHEN a.low <> b.low THEN 'low' END) END AS fields FROM a FULL JOIN b USING (family_key, slot_index, metric)""")
def schema_drift(x):
    """Patterns of an earlier run (one version, first matches) against a later run."""
    def run(cond):
        return x.cm.filter(cond).groupBy("family_key", "slot_index", "metric").agg(F.max("overlap").alias("peak"), F.min("overlap").alias("low"))

    return g.drift(run("version_group = 'O' AND match_id < 40"), run("version_group = 'F' AND match_id >= 60"), ["family_key", "slot_index", "metric"], ["peak", "low"])


@query("K8_failure_taxonomy", """SELECT version_group, CASE WHEN overlap < 6 THEN 'insufficient-overlap' WHEN nrmse > 0.8 THEN 'distance' WHEN correlation < 0.3 THEN 'axis' WHEN score < 0.4 THEN 'score' ELSE 'passing' END AS failure, count(*) AS n FROM {cm} GROUP BY 1, 2""")
def failure_taxonomy(x):
    c = F.col
    cls = F.when(c("overlap") < 6, "insufficient-overlap").when(c("nrmse") > 0.8, "distance").when(c("correlation") < 0.3, "axis").when(c("score") < 0.4, "score").otherwise("passing")
    return x.cm.groupBy("version_group", cls.alias("failure")).agg(F.count("*").alias("n"))


@query("K9_artifact_verifier", """SELECT version_group, count(*) AS rows, count(*) FILTER (NOT (metric LIKE 'm%')) AS schema_tag, count(*) FILTER (NOT (score BETWEEN 0 AND 1)) AS score_bounds, count(*) FILTER (NOT (slot_index BETWEEN 1 AND 6)) AS slot_bounds, count(*) FILTER (NOT (slot_index BETWEEN 1 AND 6)) = 0 AS passes FROM {cm} GROUP BY 1""")
def artifact_verifier(x):
    rules = {"schema_tag": F.col("metric").startswith("m"), "score_bounds": F.col("score").between(0, 1), "slot_bounds": F.col("slot_index").between(1, 6)}
    return g.contract_summary(x.cm, rules, ["version_group"])


@query("A12_manifest_reconciliation", """WITH m AS (SELECT c_custkey AS id, 1 AS n FROM customer), s AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), f AS (SELECT DISTINCT user_id AS id, 1 AS n FROM events),
a AS (SELECT coalesce(m.id, s.id, f.id) AS id, coalesce(m.n, 0) AS mn, coalesce(s.n, 0) AS sn, coalesce(f.n, 0) AS fn FROM m FULL JOIN s ON m.id = s.id FULL JOIN f ON f.id = coalesce(m.id, s.id))
SELECT id, 'missing-manifest' AS violation FROM a WHERE mn = 0 UNION ALL SELECT id, 'duplicate-schema' FROM a WHERE sn > 1 UNION ALL SELECT id, 'missing-schema' FROM a WHERE sn = 0 UNION ALL SELECT id, 'missing-files' FROM a WHERE fn = 0""")
def manifest_reconciliation(x):
    return g.reconcile(
        {
            "manifest": x.customer.select(F.col("c_custkey").alias("id")),
            "schema": x.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")),
            "files": x.events.select(F.col("user_id").alias("id")).distinct(),
        },
        "id",
    )


MPAIR = """mp AS (SELECT match_id, metric, event_id, t, v FROM (SELECT match_id, event_id, t + 500 AS t, unnest(['k', 'running']) AS metric, unnest([CAST(k AS DOUBLE), sum(value) OVER (PARTITION BY match_id ORDER BY t, event_id)]) AS v FROM {ev})),
em AS (SELECT e.*, unnest(['k', 'running']) AS metric FROM {ev} e), bb AS (SELECT e.*, x.t AS bt, x.v AS bv FROM em e ASOF LEFT JOIN mp x ON x.match_id = e.match_id AND x.metric = e.metric AND e.t >= x.t),
ff AS (SELECT b.*, x.t AS ft, x.v AS fv FROM bb b ASOF LEFT JOIN mp x ON x.match_id = b.match_id AND x.metric = b.metric AND b.t < x.t),
pr AS (SELECT match_id, entity || '|' || metric AS entity, event_id, t, value AS rx, CASE WHEN bv IS NULL THEN fv WHEN fv IS NULL THEN bv WHEN t = bt THEN bv ELSE bv + (fv - bv) * ((t - bt)::DOUBLE / (ft - bt)) END AS tx FROM ff),"""


@query("C19_candidate_metric_scores", "WITH " + MPAIR + SCORE_CTE[len("WITH "):].replace("{pair}", "pr") + """ SELECT match_id, entity, n AS overlap, R6(slope) AS slope, R6(nrmse) AS nrmse, R6(c) AS correlation, R6(base) AS score, R6(base * val) AS effective FROM h""")
def candidate_metric_scores(x):
    """Every candidate series of a match against every metric series of the same match."""
    metrics = o.scan(x.ev, ["match_id"], ["t", "event_id"], o.time_block("t", DAY_MS), {"run": o.run_sum("value")})
    cells = F.array(
        F.struct(F.lit("k").alias("metric"), F.col("k").cast("double").alias("v")), F.struct(F.lit("running").alias("metric"), F.col("run").alias("v"))
    )
    target = metrics.select("match_id", "event_id", (F.col("t") + 500).alias("t"), F.explode(cells).alias("c")).select("match_id", "event_id", "t", "c.*")
    names = F.explode(F.array(F.lit("k"), F.lit("running"))).alias("metric")
    cand = x.ev.select("match_id", "entity", "event_id", "t", F.col("value").alias("rx"), names)
    p = tj.interpolate(cand, target, ["match_id", "metric"], "t", "event_id", DAY_MS, ["v"])
    p = p.withColumn("entity", F.concat_ws("|", "entity", "metric")).withColumnRenamed("at_v", "tx")
    limits = {"monotonic": True, "min_correlation": 0.5, "max_nrmse": 0.9}
    out = sr.score_match(p, ["match_id", "entity"], ["t", "event_id"], o.time_block("t", DAY_MS), "rx", "tx", 6, limits)
    return out.select("match_id", "entity", "overlap", "slope", "nrmse", "correlation", "score", "effective")


@query("C34_lost_candidate_funnel", """WITH a AS (SELECT DISTINCT match_id, family_key, slot_index FROM {cm} WHERE score >= 0.9), b AS (SELECT DISTINCT match_id, family_key, slot_index FROM {cm} WHERE score >= 0.9 AND correlation >= 0.3), c AS (SELECT DISTINCT match_id, family_key, slot_index FROM {cm} WHERE score >= 0.9 AND correlation >= 0.3 AND nrmse <= 0.5)
SELECT CASE WHEN b.match_id IS NULL THEN 'lost-at-extraction' WHEN c.match_id IS NULL THEN 'lost-at-validation' ELSE 'kept' END AS stage, count(*) AS n FROM a LEFT JOIN (SELECT * FROM b) b USING (match_id, family_key, slot_index) LEFT JOIN (SELECT * FROM c) c USING (match_id, family_key, slot_index) GROUP BY 1""")
def lost_candidate_funnel(x):
    keys = ["match_id", "family_key", "slot_index"]
    a = x.cm.filter("score >= 0.9")
    stages = [("lost-at-extraction", a.filter("correlation >= 0.3")), ("lost-at-validation", a.filter("correlation >= 0.3 AND nrmse <= 0.5"))]
    out, stage = a.select(*keys).distinct(), None
    for i, (name, df) in enumerate(stages):
        out = out.join(df.select(*keys, F.lit(True).alias(f"_s{i}")).distinct(), keys, "left")
        gone = F.col(f"_s{i}").isNull()
        stage = F.when(gone, name) if stage is None else stage.when(gone, name)
    return out.groupBy(stage.otherwise("kept").alias("stage")).agg(F.count("*").alias("n"))


@query("C35_oracle_gap", f"""WITH rk AS (SELECT match_id, slot_index, participant_id, score, row_number() OVER (PARTITION BY match_id, slot_index {WIN}) AS rk, max(score) OVER (PARTITION BY match_id, slot_index) AS best FROM {{cm}}), orc2 AS (SELECT match_id, slot_index, max_by(participant_id, (correlation, o1, o3, o4)) AS truth FROM {{cm}} GROUP BY 1, 2),
j AS (SELECT o.match_id, o.slot_index, min(rk) AS rk, max(score) AS sc, any_value(best) AS best FROM orc2 o JOIN rk ON rk.match_id = o.match_id AND rk.slot_index = o.slot_index AND rk.participant_id = o.truth GROUP BY 1, 2)
SELECT CASE WHEN rk = 1 THEN 'rank_1' WHEN rk <= 3 THEN 'rank_2_3' WHEN rk <= 10 THEN 'rank_4_10' ELSE 'rank_11_plus' END AS rank_bucket, CASE WHEN best - sc <= 0 THEN 'none' WHEN best - sc <= 0.05 THEN 'small' ELSE 'large' END AS gap_bucket, count(*) AS n FROM j GROUP BY 1, 2""")
def oracle_gap(x):
    """Rank of the oracle's entity among the scored alternatives and its score gap."""
    keys = ["match_id", "slot_index"]
    truth = x.cm.groupBy(*keys).agg(F.max_by("participant_id", F.struct("correlation", "o1", "o3", "o4")).alias("participant_id"))
    per = o.best(x.cm, [*keys, "participant_id"], win()).withColumn("spot", F.struct(-F.col("score"), -F.col("correlation"), "nrmse", "participant_id", "o1", "o3", "o4"))
    mine = per.join(truth, [*keys, "participant_id"], "left_semi").select(*keys, F.col("spot").alias("mine"), F.col("score").alias("sc"))
    # rank = rows strictly before the oracle's best row, plus one
    rows = x.cm.select(*keys, "score", F.struct(-F.col("score"), -F.col("correlation"), "nrmse", "participant_id", "o1", "o3", "o4").alias("spot"))
    j = rows.join(mine, keys).groupBy(*keys).agg((F.count_if(F.col("spot") < F.col("mine")) + 1).alias("rk"), F.max("sc").alias("sc"), F.max("score").alias("best"))
    rank = F.when(F.col("rk") == 1, "rank_1").when(F.col("rk") <= 3, "rank_2_3").when(F.col("rk") <= 10, "rank_4_10").otherwise("rank_11_plus")
    gap = F.col("best") - F.col("sc")
    return j.groupBy(rank.alias("rank_bucket"), F.when(gap <= 0, "none").when(gap <= 0.05, "small").otherwise("large").alias("gap_bucket")).agg(F.count("*").alias("n"))


@query("C36_best_hypothesis", "SELECT match_id, participant_id, family_key, slot_index, R6(score) AS score FROM {cm} QUALIFY row_number() OVER (PARTITION BY match_id, participant_id ORDER BY CAST(correlation >= 0.5 AS INT) DESC, score DESC, nrmse, o1, o3, o4) = 1")
def best_hypothesis(x):
    order = [F.desc((F.col("correlation") >= 0.5).cast("int")), F.desc("score"), F.asc("nrmse"), F.asc("o1"), F.asc("o3"), F.asc("o4")]
    return o.best(x.cm, ["match_id", "participant_id"], order).select("match_id", "participant_id", "family_key", "slot_index", "score")


@query("C37_ordinal_frame_join", """WITH k AS (SELECT o_custkey AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seg, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 0 END AS explicit FROM orders), f AS (SELECT user_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id FROM events)
SELECT k.m, k.o_orderkey, f.event_id FROM k JOIN f ON f.m = k.m AND f.frame = coalesce(explicit, seg - 1)""")
def ordinal_frame_join(x):
    """Keyframe sample to oracle frame by explicit index, else by segment ordinal."""
    k = x.orders.select(F.col("o_custkey").alias("m"), "o_orderkey", "o_orderdate", F.when(F.col("o_orderpriority") == "5-LOW", 0).alias("explicit"))
    k = o.position(k, ["m"], ["o_orderdate", "o_orderkey"], F.year("o_orderdate").cast("long"), "seg")
    k = k.select("m", "o_orderkey", F.coalesce("explicit", F.col("seg") - 1).alias("frame"))
    f = o.position(x.ev.select(F.col("match_id").alias("m"), "t", "event_id"), ["m"], ["t", "event_id"], o.time_block("t", DAY_MS), "frame")
    return k.join(f.select("m", (F.col("frame") - 1).alias("frame"), "event_id"), ["m", "frame"]).select("m", "o_orderkey", "event_id")


@query("C38_snapshot_frame_validation", """WITH a AS (SELECT match_id, dense_rank() OVER (PARTITION BY match_id ORDER BY t) AS n, t, k FROM {dec}), b AS (SELECT match_id, dense_rank() OVER (PARTITION BY match_id ORDER BY t) AS n, t, k FROM {orc}), x AS (SELECT DISTINCT k FROM {ev} WHERE value > 300)
SELECT a.match_id, count(*) AS snapshots, count(*) FILTER (abs(a.t - b.t) <= 1) AS time_ok, count(*) FILTER (a.k = b.k) AS value_ok, count(*) FILTER (a.k <> b.k AND x.k IS NOT NULL) AS excused FROM a JOIN b USING (match_id, n) LEFT JOIN x ON x.k = a.k GROUP BY 1""")
def snapshot_frame_validation(x):
    """Ordinal join of snapshots and frames, ±1 ms, with an approved-exception table."""
    blk = o.time_block("t", DAY_MS)

    def ranked(df, ident):
        return o.islands(df, ["match_id"], ["t", "id"], blk, F.col("_p").isNull() | (F.col("_p") != F.col("t")), "n", {"_p": "t"}).select("match_id", "n", "t", "k")

    a = ranked(x.dec, "id")
    b = ranked(x.orc, "id").withColumnsRenamed({"t": "bt", "k": "bk"})
    ex = x.ev.filter("value > 300").select("k").distinct().withColumn("approved", F.lit(True))
    j = a.join(b, ["match_id", "n"]).join(ex, "k", "left")
    same = F.col("k") == F.col("bk")
    return j.groupBy("match_id").agg(
        F.count("*").alias("snapshots"), F.count_if(F.abs(F.col("t") - F.col("bt")) <= 1).alias("time_ok"), F.count_if(same).alias("value_ok"), F.count_if(~same & F.col("approved")).alias("excused")
    )


@query("C40_series_end_check", f"""WITH f AS (SELECT match_id, entity, max_by(value, (t, event_id)) AS last_v, max(t) AS last_t FROM {{ev}} GROUP BY 1, 2), tot AS (SELECT match_id, avg(value) AS final, max(t) AS end_t FROM {{ev}} GROUP BY 1)
SELECT entity, CASE WHEN end_t - last_t <= {DAY_MS} THEN 'final_window' ELSE 'early' END AS part, count(*) AS series, R6(avg(abs(last_v - final) / greatest(final, 1))) AS mean_relative_error, count(*) FILTER (abs(last_v - final) / greatest(final, 1) <= 0.25) AS close FROM f JOIN tot USING (match_id) GROUP BY 1, 2""")
def series_end_check(x):
    f = x.ev.groupBy("match_id", "entity").agg(F.max_by("value", F.struct("t", "event_id")).alias("last_v"), F.max("t").alias("last_t"))
    tot = x.ev.groupBy("match_id").agg(F.avg("value").alias("final"), F.max("t").alias("end_t"))
    err = F.abs(F.col("last_v") - F.col("final")) / F.greatest(F.col("final"), F.lit(1.0))
    part = F.when(F.col("end_t") - F.col("last_t") <= DAY_MS, "final_window").otherwise("early")
    return f.join(tot, "match_id").groupBy("entity", part.alias("part")).agg(F.count("*").alias("series"), F.avg(err).alias("mean_relative_error"), F.count_if(err <= 0.25).alias("close"))


@query("C41_evidence_join", """WITH a AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS labelled, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT source, count(*) AS vectors FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1)
SELECT source, docs, coalesce(labelled, 0) AS labelled, coalesce(good, 0) AS good, coalesce(vectors, 0) AS vectors, CASE WHEN labelled IS NULL AND vectors IS NULL THEN 'none' WHEN labelled IS NULL OR vectors IS NULL THEN 'partial' ELSE 'full' END AS status FROM a LEFT JOIN b USING (source) LEFT JOIN c USING (source)""")
def evidence_join(x):
    d = x.documents.select("doc_id", "source")
    a = d.groupBy("source").agg(F.count("*").alias("docs"))
    b = d.join(x.labels, "doc_id").groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))
    c = d.join(x.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id").groupBy("source").agg(F.count("*").alias("vectors"))
    out = a.join(b, "source", "left").join(c, "source", "left")
    no_l, no_v = F.col("labelled").isNull(), F.col("vectors").isNull()
    out = out.withColumn("status", F.when(no_l & no_v, "none").when(no_l | no_v, "partial").otherwise("full"))
    return out.fillna({"labelled": 0, "good": 0, "vectors": 0})


@query("C42_target_dossier", """WITH rk AS (SELECT source, count(*) AS records FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10), s AS (SELECT source, avg(n_chars) AS mean_len, max(n_chars) AS max_len FROM documents GROUP BY 1), c AS (SELECT source, count(*) FILTER (lang = 'en') AS target FROM documents GROUP BY 1)
SELECT source, records, R6(mean_len) AS mean_len, max_len, target FROM rk LEFT JOIN s USING (source) LEFT JOIN c USING (source)""")
def target_dossier(x):
    """Top targets with their sample and cohort summaries; one pass, then the top ten."""
    d = x.documents.groupBy("source").agg(
        F.count("*").alias("records"), F.avg("n_chars").alias("mean_len"), F.max("n_chars").alias("max_len"), F.count_if(F.col("lang") == "en").alias("target")
    )
    return d.orderBy(F.desc("records"), "source").limit(10)
