"""Windows, ordering and set checks over the stand-in views."""

from pyspark.sql import functions as F

from eventloom.operators import ordered as o
from eventloom.operators import sequences as sq
from eventloom.operators import timejoin as tj
from eventloom.plans.registry import query
from eventloom.plans.standins import DAY_MS, TX_BLOCK_MS, TX_ORDER

ORDER = ["t", "event_id"]
ME = ["match_id", "entity"]
W = "WINDOW w AS (PARTITION BY match_id, entity ORDER BY t, event_id)"
AT = 15 * DAY_MS


def blk():
    return o.time_block("t", DAY_MS)


@query("E1_field_changes", f"SELECT event_id, R6(d) AS delta FROM (SELECT event_id, value - lag(value) OVER w AS d, greatest(1e-3, abs(lag(value) OVER w) * 1e-6) AS eps FROM {{ev}} {W}) WHERE abs(d) > eps")
def field_changes(x):
    return sq.field_changes(x.ev, ME, ORDER, blk(), "value", F.lit(True)).select("event_id", "delta")


@query("E2_snapshot_transitions", """SELECT match_id, block_index, len, p AS before_len, block_index = pi + 1 AS contiguous FROM (SELECT *, lag(len) OVER w AS p, lag(block_index) OVER w AS pi FROM {pk} WINDOW w AS (PARTITION BY match_id ORDER BY block_index)) WHERE pi IS NOT NULL""")
def snapshot_transitions(x):
    d = x.pk.select("match_id", "block_index", "len")
    return sq.transitions(d, ["match_id"], ["block_index"], o.time_block("block_index", 4096), "block_index", ["len"])


@query("E3_cumulative_state", """SELECT event_id, count(*) FILTER (entity = 'click') OVER w AS kills, count(*) FILTER (entity = 'error') OVER w AS deaths, max(CASE WHEN entity = 'error' THEN t END) OVER w AS last_death
 FROM {ev} WINDOW w AS (PARTITION BY match_id ORDER BY t, event_id)""")
def cumulative_state(x):
    e = F.col("entity")
    out = sq.cumulative_counts(x.ev, ["match_id"], ORDER, blk(), "t", {"kills": e == "click", "deaths": e == "error"}, ("last_death", e == "error"))
    return out.select("event_id", "kills", "deaths", "last_death")


@query("E4_latest_snapshot", f"""SELECT match_id, coalesce(max_by(t, (t, event_id)) FILTER (t <= {AT}), min_by(t, (t, event_id))) AS t, R6(coalesce(max_by(value, (t, event_id)) FILTER (t <= {AT}), min_by(value, (t, event_id)))) AS value FROM {{ev}} GROUP BY 1""")
def latest_snapshot(x):
    return sq.latest_at(x.ev, ["match_id"], "t", AT, ORDER, ["value"])


@query("E5_state_flags", f"""SELECT event_id, CASE WHEN value < 10 THEN 1 ELSE 0 END AS is_dead, CASE WHEN t - max(CASE WHEN entity = 'error' THEN t END) OVER v <= 60000 THEN 1 ELSE 0 END AS recent_death,
 CASE WHEN lag(value) OVER v < 10 AND value >= 10 THEN 1 ELSE 0 END AS respawned FROM {{ev}} WINDOW v AS (PARTITION BY match_id ORDER BY t, event_id)""")
def state_flags(x):
    health = F.when(F.col("value") < 10, 0).otherwise(1)
    return sq.life_flags(x.ev, ["match_id"], ORDER, blk(), "t", health, F.col("entity") == "error").select("event_id", "is_dead", "recent_death", "respawned")


@query("E6_marker_state", f"""WITH p AS (SELECT event_id, match_id, t FROM {{ev}} WHERE entity = 'signup'), r AS (SELECT match_id, min(t) AS removed_t FROM {{ev}} WHERE entity = 'error' AND t > {10 * DAY_MS} GROUP BY 1)
SELECT CASE WHEN removed_t <= {AT} AND {AT} - removed_t <= {DAY_MS} THEN 'removal_pulse' WHEN t <= {AT} AND {AT} - t <= {DAY_MS} THEN 'placement_pulse' WHEN removed_t > {AT} AND t <= {AT} THEN 'active' ELSE 'hidden' END AS state, count(*) AS markers
FROM p LEFT JOIN r USING (match_id) GROUP BY 1""")
def marker_state(x):
    from eventloom.operators.matching import lifecycle

    rem = x.ev.filter(f"entity = 'error' AND t > {10 * DAY_MS}")
    lives = lifecycle(x.ev.filter("entity = 'signup'"), rem, ["match_id"], "t")
    return sq.marker_state(lives, AT, DAY_MS, "t", "removed_t").groupBy("state").agg(F.count("*").alias("markers"))


@query("E7_group_ranking", "SELECT match_id, event_id, row_number() OVER (PARTITION BY match_id ORDER BY value DESC, k DESC, t, event_id) AS rank FROM {ev} QUALIFY rank <= 3")
def group_ranking(x):
    return o.top_k(x.ev, ["match_id"], [F.desc("value"), F.desc("k"), F.asc("t"), F.asc("event_id")], 3, "rank").select("match_id", "event_id", "rank")


CLUSTER = """WITH p AS (SELECT l_suppkey AS g, l_shipdate::DATE - DATE '1995-01-01' AS slot, sum(l_quantity) AS w, count(*) AS n FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY g ORDER BY slot) <= {gap} THEN 0 ELSE 1 END AS s FROM p), i AS (SELECT *, sum(s) OVER (PARTITION BY g ORDER BY slot) AS cluster FROM f)
SELECT g, CAST(cluster AS BIGINT) AS cluster, CAST(min(slot) AS BIGINT) AS first_slot, CAST(max(slot) AS BIGINT) AS last_slot, count(*) AS slots, CAST(sum(n) AS BIGINT) AS entries, R6(sum(w)) AS weight FROM i GROUP BY 1, 2"""


def _slots(x):
    return x.lineitem.select(
        F.col("l_suppkey").alias("g"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("slot"), F.col("l_quantity").alias("w")
    )


@query("E9_slot_clusters_gap1", CLUSTER.format(gap=1))
def slot_clusters_gap1(x):
    return sq.slot_clusters(_slots(x), ["g"], "slot", 1, "w")


@query("E9_slot_clusters_gap2", CLUSTER.format(gap=2))
def slot_clusters_gap2(x):
    return sq.slot_clusters(_slots(x), ["g"], "slot", 2, "w")


@query("E10_layout_clusters_by_anchor", """WITH a AS (SELECT match_id, family_key, min(slot_index) AS anchor FROM {cm} WHERE metric = 'm0' GROUP BY 1, 2)
SELECT family_key, anchor, count(DISTINCT match_id) AS matches, min(slot_index) AS band_start, max(slot_index) AS band_end, count(DISTINCT metric) AS metrics FROM {cm} JOIN a USING (match_id, family_key) GROUP BY 1, 2""")
def layout_clusters_by_anchor(x):
    a = x.cm.filter("metric = 'm0'").groupBy("match_id", "family_key").agg(F.min("slot_index").alias("anchor"))
    return x.cm.join(a, ["match_id", "family_key"]).groupBy("family_key", "anchor").agg(
        F.count_distinct("match_id").alias("matches"), F.min("slot_index").alias("band_start"), F.max("slot_index").alias("band_end"), F.count_distinct("metric").alias("metrics")
    )


@query("E11_probe_samples", """WITH p AS (SELECT event_id, match_id, row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY match_id) AS n FROM {ev}),
q AS (SELECT DISTINCT match_id, CAST(floor(i * (n - 1) / 7 + 0.5) AS BIGINT) + 1 AS rn FROM p, range(0, 8) r(i) WHERE n > 8)
SELECT match_id, event_id FROM p WHERE n <= 8 OR (match_id, rn) IN (SELECT match_id, rn FROM q)""")
def probe_samples(x):
    return sq.probe_samples(x.ev, ["match_id"], ORDER, blk(), 8).select("match_id", "event_id")


@query("E12_edge_values", "SELECT match_id, entity, R6(min_by(value, (t, event_id))) AS first_value, R6(max_by(value, (t, event_id))) AS last_value, R6(max_by(value, (t, event_id))) AS last_finite, count(*) AS samples FROM {ev} GROUP BY 1, 2")
def edge_values(x):
    return sq.edge_values(x.ev, ME, ORDER, "value")


LAY = """WITH b AS (SELECT match_id, seg_id, t AS s, t + len * 1000 AS e FROM {seg}), g AS (SELECT *, max(e) OVER (PARTITION BY match_id ORDER BY s, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM b)
SELECT match_id, seg_id, 'segment' AS kind, s AS "from", e AS "to" FROM g UNION ALL SELECT match_id, seg_id, 'gap', coalesce(far, 0), s FROM g WHERE s > coalesce(far, 0)"""


@query("E13_byte_layout", LAY)
def byte_layout(x):
    b = x.seg.select("match_id", "seg_id", F.col("t").alias("s"), (F.col("t") + F.col("len") * 1000).alias("e"))
    return sq.byte_layout(b, ["match_id"], "s", "e", "seg_id", o.time_block("s", TX_BLOCK_MS))


@query("E14_equal_time_groups", """SELECT match_id, CAST(sum(c) OVER (PARTITION BY match_id ORDER BY t, o1, o2, o3, o4) AS BIGINT) AS group_no, o1, o3 FROM (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY match_id ORDER BY t, o1, o2, o3, o4) = t THEN 0 ELSE 1 END AS c FROM {tx})""")
def equal_time_groups(x):
    return sq.same_time_groups(x.tx, ["match_id"], TX_ORDER, o.time_block("t", TX_BLOCK_MS), "t").select("match_id", "group_no", "o1", "o3")


@query("E15_monotone_check", """SELECT match_id, count(*) AS rows, count(*) FILTER (value < pv) AS value_falls, count(*) FILTER (k < pk2) AS k_falls FROM (SELECT *, lag(value) OVER w AS pv, lag(k) OVER w AS pk2 FROM {ev} WINDOW w AS (PARTITION BY match_id ORDER BY t, event_id)) GROUP BY 1""")
def monotone_check(x):
    return sq.monotone_check(x.ev, ["match_id"], ORDER, blk(), ["value", "k"])


@query("E15_group_cardinality", "SELECT match_id, t, count(DISTINCT item_id) AS items, count(DISTINCT item_id) = 7 AS complete FROM {tx} GROUP BY 1, 2")
def group_cardinality(x):
    n = F.count_distinct("item_id")
    return x.tx.groupBy("match_id", "t").agg(n.alias("items"), (n == 7).alias("complete"))


@query("E16_ordinal_maps", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS global_ordinal, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS family_ordinal FROM documents")
def ordinal_maps(x):
    """Family ordinal by block scan; the global one adds the sizes of earlier families."""
    d = x.documents.select("doc_id", "source")
    fam = o.position(d, ["source"], ["doc_id"], o.time_block("doc_id", 1 << 16), "family_ordinal")
    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    base = o.scan(sizes.withColumn("g", F.lit(0)), ["g"], ["source"], None, {"upto": o.run_sum("n")})
    base = base.select("source", (F.col("upto") - F.col("n")).alias("base"))
    out = fam.join(base, "source").withColumn("family_ordinal", F.col("family_ordinal") - 1)
    return out.select("doc_id", (F.col("base") + F.col("family_ordinal")).alias("global_ordinal"), "family_ordinal")


@query("E17_nearby_events", f"""WITH a AS (SELECT *, abs(t - {AT}) AS d, count(*) FILTER (abs(t - {AT}) <= {DAY_MS}) OVER (PARTITION BY match_id) AS n FROM {{ev}})
SELECT match_id, event_id FROM a WHERE n = 0 OR d <= {DAY_MS} QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY d, t, event_id) <= 8""")
def nearby_events(x):
    return sq.nearby(x.ev, ["match_id"], "t", AT, DAY_MS, 8, "event_id").select("match_id", "event_id")


@query("E18_trailing_points", "SELECT match_id, event_id FROM {ev} QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY t DESC, event_id DESC) <= 5")
def trailing_points(x):
    return o.top_k(x.ev, ["match_id"], [F.desc("t"), F.desc("event_id")], 5).select("match_id", "event_id")


@query("E19_series_plausibility", f"""WITH d AS (SELECT match_id, entity, value, value - lag(value) OVER w AS d FROM {{ev}} {W}),
g AS (SELECT match_id, entity, avg(CASE WHEN value BETWEEN 5 AND 150 THEN 1.0 ELSE 0 END) AS r, count(d) AS n, count(*) FILTER (d >= -1e-6) AS up, count(*) FILTER (abs(d) > 90) AS j FROM d GROUP BY 1, 2)
SELECT match_id, entity, R6((0.7 * r + 0.3 * CASE WHEN n > 0 THEN up / n ELSE 1 END) * CASE WHEN n > 0 AND j > 0 THEN greatest(0.22, 1 - 1.35 * j / n) ELSE 1 END) AS plausibility FROM g""")
def series_plausibility(x):
    return sq.plausible_series(x.ev, ME, ORDER, blk(), "value", 5, 150, 90)


@query("E20_field_summary", f"""WITH d AS (SELECT match_id, entity, k, lag(k) OVER w AS p FROM {{ev}} {W})
SELECT match_id, entity, count(*) AS samples, count(DISTINCT k) AS unique_values, count(p) AS transitions, count(*) FILTER (k <> p) AS changed, min(k) AS low, max(k) AS high,
 CASE WHEN count(*) FILTER (k <> p) = 0 THEN 'static' WHEN count(*) FILTER (k <> p) >= count(p) / 2 THEN 'dynamic' ELSE 'mixed' END AS archetype FROM d GROUP BY 1, 2""")
def field_summary(x):
    return sq.field_summary(x.ev, ME, ORDER, blk(), "k")


@query("E21_position_profile", """WITH d AS (SELECT match_id, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS s FROM {tgt} WINDOW w AS (PARTITION BY match_id ORDER BY t, event_id))
SELECT match_id, count(*) AS samples, count(*) FILTER (s <= 5000) AS smooth_steps, count(*) FILTER (s >= 10000) AS moving_steps,
 CASE WHEN count(*) FILTER (s <= 5000) >= 0.8 * count(s) THEN 'smooth' WHEN count(*) FILTER (s >= 10000) >= 0.2 * count(s) THEN 'moving' ELSE 'still' END AS class FROM d GROUP BY 1""")
def position_profile(x):
    return sq.position_profile(x.tgt, ["match_id"], ORDER, blk(), "x", "y", 5000, 10000)


@query("F1_global_top_k", "SELECT event_id, R6(value) AS value, k FROM {ev} ORDER BY value DESC, k DESC, t, event_id LIMIT 25")
def global_top_k(x):
    return x.ev.orderBy(F.desc("value"), F.desc("k"), "t", "event_id").limit(25).select("event_id", "value", "k")


@query("F2_score_vector_order", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars // 100 DESC, length(source) DESC, doc_id DESC) AS rank FROM documents QUALIFY rank <= 10")
def score_vector_order(x):
    vec = F.array(F.floor(F.col("n_chars") / 100), F.length("source").cast("long"), F.col("doc_id"))
    return o.top_k(x.documents.select("lang", "doc_id", vec.alias("v")), ["lang"], [F.desc("v")], 10, "rank").select("doc_id", "rank")


@query("F3_physical_order_strictness", """SELECT match_id, count(*) AS rows, count(*) FILTER (p IS NOT NULL AND NOT (p < (t, o1))) AS violations FROM (SELECT match_id, t, o1, lag((t, o1)) OVER (PARTITION BY match_id ORDER BY t, o1, o2, o3, o4) AS p FROM {tx}) GROUP BY 1""")
def physical_order_strictness(x):
    return sq.strict_order(x.tx, ["match_id"], TX_ORDER, o.time_block("t", TX_BLOCK_MS), ["t", "o1"])


@query("F4_event_union", """SELECT 'kill' AS kind, event_id, t, k AS actor, CAST(NULL AS BIGINT) AS item FROM {ev} WHERE entity = 'click' UNION ALL SELECT 'ward', event_id, t, NULL, NULL FROM {ev} WHERE entity = 'view'
UNION ALL SELECT 'item', event_id, t, NULL, k FROM {ev} WHERE entity = 'purchase'""")
def event_union(x):
    def part(kind, entity, **cols):
        return x.ev.filter(F.col("entity") == entity).select(F.lit(kind).alias("kind"), "event_id", "t", *[F.col(c).alias(n) for n, c in cols.items()])

    streams = [part("kill", "click", actor="k"), part("ward", "view"), part("item", "purchase", item="k")]
    out = streams[0]
    for s_ in streams[1:]:
        out = out.unionByName(s_, allowMissingColumns=True)
    return out.orderBy("t", "event_id")


@query("F5_dedupe_keep_best", "SELECT match_id, k, event_id FROM {ev} QUALIFY row_number() OVER (PARTITION BY match_id, k ORDER BY value DESC, t, event_id) = 1")
def dedupe_keep_best(x):
    return sq.dedupe(x.ev, ["match_id", "k"], [F.desc("value"), F.asc("t"), F.asc("event_id")]).select("match_id", "k", "event_id")


@query("F6_canonical_and_aliases", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical, count(*) OVER (PARTITION BY text) AS members, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_alias FROM documents")
def canonical_and_aliases(x):
    d = x.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return sq.canonical(d, ["h"], ["doc_id"], "doc_id").drop("h")


@query("F7_physical_key_union", """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1, 2 HAVING count(*) > 1""")
def physical_key_union(x):
    li = x.lineitem
    keys = ["l_orderkey", "l_linenumber"]
    both = li.filter("l_linestatus = 'O'").select(*keys).unionAll(li.filter("l_linestatus = 'F'").select(*keys))
    return both.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


@query("F8_partition_assertion", """WITH p AS (SELECT DISTINCT o_custkey AS id, 'a' AS p FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT DISTINCT o_custkey, 'b' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 200000),
c AS (SELECT id, count(*) AS n FROM p GROUP BY 1) SELECT status, count(*) AS ids FROM (SELECT CASE WHEN n IS NULL THEN 'uncovered' WHEN n > 1 THEN 'overlap' ELSE 'ok' END AS status FROM (SELECT c_custkey AS id FROM customer) LEFT JOIN c USING (id)) GROUP BY 1""")
def partition_assertion(x):
    whole = x.customer.select(F.col("c_custkey").alias("id"))
    od = x.orders.select(F.col("o_custkey").alias("id"), "o_totalprice", "o_orderstatus")
    parts = {"a": od.filter("o_totalprice > 400000"), "b": od.filter("o_orderstatus = 'F' AND o_totalprice < 200000")}
    return sq.partition_assertion(whole, parts, "id").groupBy("status").agg(F.count("*").alias("ids"))


@query("F9_discovery_holdout_split", """WITH m AS (SELECT DISTINCT version_group || family_key AS g, match_id FROM {cm}), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY match_id) AS rn, count(*) OVER (PARTITION BY g) AS n FROM m)
SELECT g, match_id, CASE WHEN n > 1 AND rn > n - ceil(n / 3) THEN 'holdout' ELSE 'discovery' END AS partition FROM r""")
def discovery_holdout_split(x):
    m = x.cm.select(F.concat("version_group", "family_key").alias("g"), "match_id").distinct()
    return sq.discovery_split(m, "g", ["match_id"])
