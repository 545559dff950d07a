"""Joins and matching over the stand-in views."""

from pyspark.sql import functions as F

from eventloom.operators import matching as m
from eventloom.operators import ordered as o
from eventloom.operators import timejoin as tj
from eventloom.plans.registry import query
from eventloom.plans.standins import DAY_MS, TX_BLOCK_MS, TX_ORDER

TOL = 1
GREEDY = """WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY match_id, entity ORDER BY t, id) AS i FROM {dec}),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, entity ORDER BY t, id) AS j FROM {orc}),
walk AS (
  SELECT match_id, entity, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS p, CAST(NULL AS BIGINT) AS hit
  FROM (SELECT DISTINCT match_id, entity FROM d)
  UNION ALL
  SELECT w.match_id, w.entity, d.i, coalesce(min(r.j), any_value(w.p)), min(r.j)
  FROM walk w JOIN d ON d.match_id = w.match_id AND d.entity = w.entity AND d.i = w.i + 1
  LEFT JOIN r ON r.match_id = w.match_id AND r.entity = w.entity AND r.j > w.p AND abs(r.t - d.t) <= 1
  GROUP BY w.match_id, w.entity, d.i),
hits AS (SELECT w.match_id, w.entity, d.id AS decoded_id, d.t AS decoded_t, r.id AS oracle_id, r.t AS oracle_t
  FROM walk w JOIN d ON d.match_id = w.match_id AND d.entity = w.entity AND d.i = w.i
  LEFT JOIN r ON r.match_id = w.match_id AND r.entity = w.entity AND r.j = w.hit),
pairs AS (SELECT * FROM hits UNION ALL SELECT match_id, entity, NULL, NULL, id, t FROM r
  WHERE id NOT IN (SELECT oracle_id FROM hits WHERE oracle_id IS NOT NULL))
"""
SUMMARY = """count(*) FILTER (decoded_id IS NOT NULL AND oracle_id IS NOT NULL) AS matched,
 count(*) FILTER (oracle_id IS NULL) AS extra, count(*) FILTER (decoded_id IS NULL) AS missing,
 coalesce(max(abs(decoded_t - oracle_t)), 0) AS max_delta"""


@query("C1_exact_entity_join", """WITH a AS (SELECT team, team_position, roster_index, gold FROM {roster}),
b AS (SELECT team, team_position, min(roster_index) AS other, min(gold) AS g FROM {roster} GROUP BY 1, 2)
SELECT a.roster_index, a.team, a.team_position, a.roster_index = b.other AS roster_index_equal,
 a.gold = b.g AS gold_equal FROM a LEFT JOIN b USING (team, team_position)""")
def exact_entity_join(x):
    right = x.roster.groupBy("team", "team_position").agg(
        F.min("roster_index").alias("roster_index"), F.min("gold").alias("gold")
    )
    out = m.entity_flags(x.roster, right, ["team", "team_position"], ["roster_index", "gold"])
    return out.select("roster_index", "team", "team_position", "roster_index_equal", "gold_equal")


@query("C2_best_scored_roster_match", """WITH l AS (SELECT s_suppkey AS id, s_suppkey % 10 AS match_id, CAST(n_regionkey AS BIGINT) AS team,
  CASE WHEN s_acctbal < 3000 THEN 'BUILDING' WHEN s_acctbal < 6000 THEN 'MACHINERY' ELSE 'NONE' END AS team_position,
  'Customer#' || right(s_name, 9) AS champion FROM supplier JOIN nation ON s_nationkey = n_nationkey),
s AS (SELECT l.id, r.roster_index AS candidate, CAST(CASE WHEN l.champion = r.champion THEN 4 ELSE 0 END
  + CASE WHEN l.team = r.team THEN 2 ELSE 0 END
  + CASE WHEN l.team_position = r.team_position THEN 2 ELSE 0 END AS BIGINT) AS score FROM l JOIN {roster} r ON l.match_id = r.roster_index % 10)
SELECT id, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, candidate) AS n FROM s)
WHERE n = 1""")
def best_scored_roster_match(x):
    bal = F.col("s_acctbal")
    left = x.supplier.join(x.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10).alias("match_id"),
        F.col("n_regionkey").cast("long").alias("team"),
        F.when(bal < 3000, "BUILDING").when(bal < 6000, "MACHINERY").otherwise("NONE").alias("team_position"),
        F.concat(F.lit("Customer#"), F.substring("s_name", -9, 9)).alias("champion"),
    )
    roster = x.roster.withColumn("match_id", F.col("roster_index") % 10)
    return m.best_scored(left, roster, ["match_id"], {"champion": 4, "team": 2, "team_position": 2}, "id", "roster_index")


@query("C3_greedy_one_to_one", GREEDY + f"SELECT match_id, entity, {SUMMARY} FROM pairs GROUP BY 1, 2")
def greedy_one_to_one(x):
    pairs = m.greedy_match(x.dec, x.orc, ["match_id", "entity"], "t", "id", TOL, DAY_MS)
    return m.match_summary(pairs, ["match_id", "entity"])


FLAG_SQL = f"""WITH RECURSIVE {GREEDY[len('WITH RECURSIVE '):].rstrip()},
per AS (SELECT match_id, {SUMMARY} FROM pairs GROUP BY 1)
SELECT CAST(grouping(match_id) AS BIGINT) AS corpus, match_id, CAST(sum(matched) AS BIGINT) AS matched,
 CAST(sum(extra) AS BIGINT) AS extra, CAST(sum(missing) AS BIGINT) AS missing, max(max_delta) AS max_delta,
 R6(sum(matched) / (sum(matched) + sum(extra))) AS precision, R6(sum(matched) / (sum(matched) + sum(missing))) AS recall,
 sum(extra) + sum(missing) = 0 AS passes
FROM per GROUP BY ROLLUP (match_id)"""


@query("flagship_stream_validation", FLAG_SQL)
def flagship_stream_validation(x):
    """Greedy tolerance match, extra/missing, per-match and corpus rollup, gate."""
    pairs = m.greedy_match(x.dec, x.orc, ["match_id", "entity"], "t", "id", TOL, DAY_MS)
    per = m.match_summary(pairs, ["match_id"])
    total = {c: F.sum(c) for c in ("matched", "extra", "missing")}
    return per.rollup("match_id").agg(
        F.grouping("match_id").cast("long").alias("corpus"),
        *[v.alias(c) for c, v in total.items()],
        F.max("max_delta").alias("max_delta"),
        F.try_divide(total["matched"], total["matched"] + total["extra"]).alias("precision"),
        F.try_divide(total["matched"], total["matched"] + total["missing"]).alias("recall"),
        (total["extra"] + total["missing"] == 0).alias("passes"),
    )


@query("C3_exact_time_match", """WITH d AS (SELECT *, row_number() OVER (PARTITION BY match_id, entity, t ORDER BY id) AS n FROM {dec}),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id, entity, t ORDER BY id) AS n FROM {orc})
SELECT count(*) FILTER (d.id IS NOT NULL AND r.id IS NOT NULL) AS matched, count(*) FILTER (r.id IS NULL) AS extra,
 count(*) FILTER (d.id IS NULL) AS missing FROM d FULL JOIN r USING (match_id, entity, t, n)""")
def exact_time_match(x):
    out = m.exact_match(x.dec, x.orc, ["match_id", "entity"], "t", "id")
    d, r = F.col("decoded_id").isNotNull(), F.col("oracle_id").isNotNull()
    return out.agg(
        F.count_if(d & r).alias("matched"), F.count_if(~r).alias("extra"), F.count_if(~d).alias("missing")
    )


OPTIMAL = """WITH RECURSIVE u AS (SELECT match_id, 0 AS side, id, t FROM {dec} UNION ALL SELECT match_id, 1, id, t FROM {orc}),
b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY match_id ORDER BY t, side, id) <= 5000 THEN 0 ELSE 1 END AS s FROM u),
p AS (SELECT *, sum(s) OVER (PARTITION BY match_id ORDER BY t, side, id) AS part FROM b),
r AS (SELECT match_id, part, side, t, row_number() OVER (PARTITION BY match_id, part, side ORDER BY t, id) AS n FROM p),
c AS (SELECT match_id, part, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS m FROM r GROUP BY 1, 2),
w AS (SELECT match_id, part, n, m, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, 0 AS half, {'a': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT)} AS v FROM c
 UNION ALL SELECT match_id, part, n, m, i, j, half, min(v) FROM (
  SELECT match_id, part, n, m, i + 1 AS i, j, 0 AS half, v FROM w WHERE half = 0 AND i < n
  UNION ALL SELECT match_id, part, n, m, i, j + 1, 0, v FROM w WHERE half = 0 AND j < m
  UNION ALL SELECT match_id, part, n, m, i, j, 0, v FROM w WHERE half = 1
  UNION ALL SELECT w.match_id, w.part, w.n, w.m, w.i + 1, w.j + 1, 1, {'a': v.a - 1, 'b': v.b + abs(d.t - o.t), 'c': greatest(v.c, abs(d.t - o.t))}
   FROM w JOIN r d ON d.match_id = w.match_id AND d.part = w.part AND d.side = 0 AND d.n = w.i + 1 JOIN r o ON o.match_id = w.match_id AND o.part = w.part AND o.side = 1 AND o.n = w.j + 1
   WHERE half = 0 AND abs(d.t - o.t) <= 5000) GROUP BY 1, 2, 3, 4, 5, 6, 7),
f AS (SELECT match_id, part, n, m, min(v) AS v FROM w WHERE i = n AND j = m AND half = 0 GROUP BY 1, 2, 3, 4)
SELECT match_id, CAST(sum(-v.a) AS BIGINT) AS matched, CAST(sum(n + v.a) AS BIGINT) AS extra, CAST(sum(m + v.a) AS BIGINT) AS missing, max(v.c) AS max_delta FROM f GROUP BY 1"""


@query("C4_optimal_one_to_one", OPTIMAL)
def optimal_one_to_one(x):
    pairs = m.optimal_match(x.dec, x.orc, ["match_id"], "t", "id", 5000, DAY_MS)
    return m.match_summary(pairs, ["match_id"])


NEIGHBOURS = """WITH l AS (SELECT event_id, match_id, t, k FROM {{ev}} WHERE entity = 'click'),
r AS (SELECT event_id, match_id, t, value FROM {{ev}} WHERE entity = 'view'),
b AS (SELECT l.*, r.t AS bt, r.value AS bv, r.event_id AS bid FROM l ASOF LEFT JOIN r ON l.match_id = r.match_id AND l.t >= r.t),
n AS (SELECT b.*, r.t AS ft, r.value AS fv, r.event_id AS fid FROM b ASOF LEFT JOIN r ON b.match_id = r.match_id AND b.t < r.t)
{body}"""


def _sides(x):
    left = x.ev.filter("entity = 'click'").select("event_id", "match_id", "t", "k")
    right = x.ev.filter("entity = 'view'").select("event_id", "match_id", "t", "value")
    return left, right


@query("C5_nearest_asof", NEIGHBOURS.format(body="""SELECT event_id, match_id, t,
 CASE WHEN d <= 7200000 THEN nid END AS near_id, CASE WHEN d <= 7200000 THEN d END AS delta FROM (
 SELECT *, CASE WHEN bt IS NULL OR ft - t < t - bt THEN fid ELSE bid END AS nid,
  least(coalesce(t - bt, 1e18), coalesce(ft - t, 1e18))::BIGINT AS d FROM n)"""))
def nearest_asof(x):
    left, right = _sides(x)
    out = tj.nearest(left, right, ["match_id"], "t", "event_id", DAY_MS, tolerance=7_200_000)
    return out.select("event_id", "match_id", "t", F.col("near.event_id").alias("near_id"), "delta")


@query("C6_interpolating_join", NEIGHBOURS.format(body="""SELECT event_id, match_id, t, R6(CASE WHEN bt IS NULL THEN fv
 WHEN ft IS NULL THEN bv WHEN t = bt THEN bv ELSE bv + (fv - bv) * ((t - bt)::DOUBLE / (ft - bt)) END) AS at_value FROM n"""))
def interpolating_join(x):
    left, right = _sides(x)
    out = tj.interpolate(left, right, ["match_id"], "t", "event_id", DAY_MS, ["value"])
    return out.select("event_id", "match_id", "t", "at_value")


@query("C7_event_anchor_rmse", NEIGHBOURS.format(body="""SELECT match_id, count(d) AS anchors,
 R6(sqrt(avg(power(k - v, 2)) FILTER (d IS NOT NULL))) AS rmse FROM (
 SELECT *, CASE WHEN nd <= 3600000 THEN nd END AS d FROM (SELECT *,
  CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t <= t - bt) THEN ft - t ELSE t - bt END AS nd,
  CASE WHEN ft IS NOT NULL AND (bt IS NULL OR ft - t <= t - bt) THEN fv ELSE bv END AS v FROM n)) GROUP BY 1"""))
def event_anchor_rmse(x):
    left, right = _sides(x)
    out = tj.nearest(left, right, ["match_id"], "t", "event_id", DAY_MS, tolerance=3_600_000, later_wins=True)
    sq = F.pow(F.col("k") - F.col("near.value"), F.lit(2.0))
    return out.groupBy("match_id").agg(F.count("delta").alias("anchors"), F.sqrt(F.avg(sq)).alias("rmse"))


@query("C8_interval_assignment", """WITH f AS (SELECT match_id, t, event_id,
  row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) - 1 AS frame FROM {ev} WHERE entity = 'signup'),
e AS (SELECT e.match_id, e.event_id, e.entity, f.frame FROM (SELECT * FROM {ev} WHERE entity <> 'signup') e
  ASOF JOIN f ON e.match_id = f.match_id AND e.t >= f.t)
SELECT match_id, frame, count(*) AS events, count(*) FILTER (entity = 'error') AS errors FROM e GROUP BY 1, 2""")
def interval_assignment(x):
    frames = o.position(
        x.ev.filter("entity = 'signup'").select("match_id", "t", "event_id"),
        ["match_id"], ["t", "event_id"], o.time_block("t", DAY_MS), "frame",
    ).withColumn("frame", F.col("frame") - 1)
    events = x.ev.filter("entity <> 'signup'").select("match_id", "t", "event_id", "entity")
    out = tj.neighbours(events, frames, ["match_id"], "t", "event_id", DAY_MS, backward="f", forward=None)
    return out.filter("f IS NOT NULL").groupBy("match_id", F.col("f.frame").alias("frame")).agg(
        F.count("*").alias("events"), F.count_if(F.col("entity") == "error").alias("errors")
    )


@query("C9_interval_overlap", """WITH f AS (SELECT match_id, event_id, t AS s, lead(t) OVER (PARTITION BY match_id ORDER BY t, event_id) AS e FROM {ev}),
c AS (SELECT DISTINCT t // 3600000 AS chunk FROM {ev})
SELECT f.event_id, count(*) AS chunks, min(c.chunk) AS first_chunk FROM f JOIN c
 ON c.chunk * 3600000 < f.e AND (c.chunk + 1) * 3600000 > f.s WHERE f.e > f.s GROUP BY 1""")
def interval_overlap(x):
    hour = 3_600_000
    frames = o.scan(x.ev, ["match_id"], ["t", "event_id"], o.time_block("t", DAY_MS), {"e": o.following("t")})
    frames = frames.select("event_id", F.col("t").alias("s"), "e", F.lit(0).alias("g"))
    chunks = x.ev.select(tj.bucket("t", hour).alias("chunk")).distinct()
    chunks = chunks.select("chunk", (F.col("chunk") * hour).alias("cs"), ((F.col("chunk") + 1) * hour).alias("ce"), F.lit(0).alias("g"))
    out = tj.overlaps(frames, chunks, ["g"], ("s", "e"), ("cs", "ce"), hour, ["event_id", "chunk"])
    return out.groupBy("event_id").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first_chunk"))


@query("C10_fixed_buckets", """SELECT t // 30000 + 4 AS chunk, entity, count(*) AS events, R6(sum(value)) AS total FROM {ev} GROUP BY 1, 2""")
def fixed_buckets(x):
    return x.ev.groupBy(tj.bucket("t", 30_000, 4).alias("chunk"), "entity").agg(
        F.count("*").alias("events"), F.sum("value").alias("total")
    )


DAYS = "WITH e AS (SELECT *, t // 86400000 AS day FROM {ev})"


def _daily(x):
    return x.ev.withColumn("day", tj.bucket("t", DAY_MS))


@query("C11_exclusive_preceding_owner", DAYS + """, s AS (SELECT *,
 max(CASE WHEN entity = 'click' THEN event_id END) OVER w AS oid, max(CASE WHEN entity = 'view' THEN event_id END) OVER w AS mid
 FROM e WINDOW w AS (PARTITION BY day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT s.day, s.event_id, o.match_id AS owner_of FROM s JOIN e o ON o.event_id = s.oid
WHERE s.entity = 'view' AND (s.mid IS NULL OR s.mid < s.oid) AND abs(o.t - s.t) <= 600000""")
def exclusive_preceding_owner(x):
    out = m.exclusive_owner(
        _daily(x), ["day"], ["event_id"], o.time_block("t", 3_600_000),
        F.col("entity") == "click", F.col("entity") == "view", "t", "match_id", 600_000,
    )
    return out.select("day", "event_id", "owner_of")


@query("C12_latest_preceding_candidate", DAYS + """ SELECT m.day, m.event_id, count(*) AS candidates, max_by(c.match_id, c.event_id) AS latest_owner
FROM e m JOIN e c ON m.day = c.day AND c.entity = 'error' AND c.event_id < m.event_id AND abs(m.t - c.t) <= 900000
WHERE m.entity = 'purchase' GROUP BY 1, 2""")
def latest_preceding_candidate(x):
    d = _daily(x)
    return m.preceding_candidates(
        d.filter("entity = 'purchase'"), d.filter("entity = 'error'"), ["day"], "t", "event_id", "match_id", 900_000
    )


@query("C13_lifecycle_join", """SELECT p.event_id, p.match_id, p.t, r.removed_t FROM (SELECT * FROM {ev} WHERE entity = 'signup') p
LEFT JOIN (SELECT match_id, k, min(t) AS removed_t FROM {ev} WHERE entity = 'error' GROUP BY 1, 2) r
ON p.match_id = r.match_id AND p.k = r.k""")
def lifecycle_join(x):
    out = m.lifecycle(x.ev.filter("entity = 'signup'"), x.ev.filter("entity = 'error'"), ["match_id", "k"], "t")
    return out.select("event_id", "match_id", "t", "removed_t")


@query("C14_lifecycle_counts", """SELECT h.match_id, h.k, r.removed_t, count(*) FILTER (h.t < removed_t) AS before,
 count(*) FILTER (h.t = removed_t) AS "at", count(*) FILTER (h.t > removed_t) AS after FROM {ev} h
 JOIN (SELECT match_id, k, min(t) AS removed_t FROM {ev} WHERE entity = 'error' GROUP BY 1, 2) r
 ON h.match_id = r.match_id AND h.k = r.k GROUP BY 1, 2, 3""")
def lifecycle_counts(x):
    return m.lifecycle_counts(x.ev, x.ev.filter("entity = 'error'"), ["match_id", "k"], "t")


@query("C15_adjacent_pairs", DAYS + """ SELECT day, event_id, entity FROM (SELECT *, lead(entity) OVER w AS ne, lead(event_id) OVER w AS ni
 FROM e WINDOW w AS (PARTITION BY day ORDER BY event_id)) WHERE ne = entity AND ni = event_id + 1""")
def adjacent_pairs(x):
    out = m.adjacent_pairs(_daily(x), ["day"], ["event_id"], o.time_block("t", 3_600_000), ["entity"], "event_id")
    return out.select("day", "event_id", "entity")


@query("C16_add_before_removal", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY match_id, entity, item_id ORDER BY t, o1, o2, o3, o4) AS n FROM {tx}),
w AS (SELECT *, max(CASE WHEN op = 'ADD' THEN n END) OVER v AS an, max(CASE WHEN op = 'REMOVE' THEN n END) OVER v AS rn FROM s
 WINDOW v AS (PARTITION BY match_id, entity, item_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT w.match_id, w.entity, w.item_id, w.t, w.o1, s.o1 AS add_order FROM w JOIN s ON s.match_id = w.match_id AND s.entity = w.entity
 AND s.item_id = w.item_id AND s.n = w.an WHERE w.op = 'REMOVE' AND w.an > coalesce(w.rn, 0)""")
def add_before_removal(x):
    out = m.add_before_removal(
        x.tx, ["match_id", "entity", "item_id"], TX_ORDER, o.time_block("t", TX_BLOCK_MS),
        F.col("op") == "ADD", F.col("op") == "REMOVE", F.col("o1"),
    )
    return out.select("match_id", "entity", "item_id", "t", "o1", F.col("add_info").alias("add_order"))


@query("C17_group_label_association", DAYS + """, c AS (SELECT l.event_id, count(g.event_id) AS groups FROM e l LEFT JOIN e g
 ON l.day = g.day AND g.entity = 'click' AND abs(l.t - g.t) <= 300000 WHERE l.entity = 'purchase' GROUP BY 1)
SELECT CASE groups WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS association, count(*) AS labels FROM c GROUP BY 1""")
def group_label_association(x):
    d = _daily(x)
    out = m.association(d.filter("entity = 'purchase'"), d.filter("entity = 'click'"), ["day"], "t", "event_id", 300_000)
    return out.groupBy("association").agg(F.count("*").alias("labels"))


@query("C18_companion_groups", DAYS + """ SELECT l.day, l.event_id, b.entity, count(*) AS blocks, min(abs(l.t - b.t)) AS closest
 FROM e l JOIN e b ON l.day = b.day AND b.entity <> 'error' AND abs(l.t - b.t) <= 300000 WHERE l.entity = 'error' GROUP BY 1, 2, 3""")
def companion_groups(x):
    d = _daily(x)
    return m.companions(
        d.filter("entity = 'error'"), d.filter("entity <> 'error'"), ["day"], "t", "event_id", "entity", 300_000
    )


@query("C21_cohort_compare", """WITH a AS (SELECT source, count(*) AS target_rows FROM documents WHERE lang = 'en' GROUP BY 1),
b AS (SELECT source, count(*) AS background_rows FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT source, coalesce(target_rows, 0) AS target_rows, coalesce(background_rows, 0) AS background_rows FROM a FULL JOIN b USING (source)""")
def cohort_compare(x):
    en = F.col("lang") == "en"
    return x.documents.groupBy("source").agg(
        F.count_if(en).alias("target_rows"), F.count_if(~en).alias("background_rows")
    )


@query("C22_missing_extra", """SELECT match_id, entity, t, 'missing' AS status FROM (SELECT match_id, entity, t FROM {dec} EXCEPT SELECT match_id, entity, t FROM {orc})
UNION ALL SELECT match_id, entity, t, 'extra' FROM (SELECT match_id, entity, t FROM {orc} EXCEPT SELECT match_id, entity, t FROM {dec})""")
def missing_extra(x):
    return m.anti_both(x.dec, x.orc, ["match_id", "entity", "t"])


@query("C23_cell_compare", """WITH a AS (SELECT l_orderkey AS o, l_partkey AS p, 'qty' AS field, CAST(sum(l_quantity) AS VARCHAR) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_orderkey AS o, l_partkey AS p, 'qty' AS field, CASE WHEN sum(l_tax) > 0.07 THEN '' ELSE CAST(sum(l_quantity + CASE WHEN l_discount > 0.08 THEN 0.5 WHEN l_discount > 0.05 THEN 3 ELSE 0 END) AS VARCHAR) END AS v FROM lineitem GROUP BY 1, 2)
SELECT cell, count(*) AS cells FROM (SELECT CASE WHEN a.v IS NOT DISTINCT FROM nullif(b.v, '') THEN 'equal'
 WHEN abs(TRY_CAST(a.v AS DOUBLE) - TRY_CAST(nullif(b.v, '') AS DOUBLE)) <= 1 THEN 'close' WHEN a.v IS NULL THEN 'extra'
 WHEN nullif(b.v, '') IS NULL THEN 'missing' ELSE 'different' END AS cell FROM a FULL JOIN b USING (o, p, field)) GROUP BY 1""")
def cell_compare(x):
    li = x.lineitem.withColumnsRenamed({"l_orderkey": "o", "l_partkey": "p"})
    spot = ["o", "p", F.lit("qty").alias("field")]
    bump = F.when(F.col("l_discount") > 0.08, 0.5).when(F.col("l_discount") > 0.05, 3.0).otherwise(0.0)
    a = li.groupBy(*spot).agg(F.sum("l_quantity").alias("v"))
    b = li.groupBy(*spot).agg(
        F.when(F.sum("l_tax") > 0.07, "").otherwise(F.sum(F.col("l_quantity") + bump).cast("string")).alias("v")
    )
    return m.cell_compare(a, b, ["o", "p", "field"], "v", 1.0).groupBy("cell").agg(F.count("*").alias("cells"))


@query("C24_assignment_compare", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY match_id, family_key, slot_index ORDER BY score DESC, participant_id) AS n FROM {cm}),
s AS (SELECT *, row_number() OVER (PARTITION BY match_id, family_key, slot_index ORDER BY correlation DESC, participant_id) AS n FROM {cm} WHERE version_group = 'O')
SELECT CASE WHEN s.match_id IS NULL THEN 'missing' WHEN s.participant_id = r.participant_id THEN 'match' ELSE 'conflict' END AS status,
 count(*) AS slots FROM (SELECT * FROM r WHERE n = 1) r LEFT JOIN (SELECT * FROM s WHERE n = 1) s USING (match_id, family_key, slot_index) GROUP BY 1""")
def assignment_compare(x):
    slot = ["match_id", "family_key", "slot_index"]
    a = o.best(x.cm, slot, [F.desc("score"), F.asc("participant_id")]).select(*slot, F.col("participant_id").alias("a"))
    b = o.best(x.cm.filter("version_group = 'O'"), slot, [F.desc("correlation"), F.asc("participant_id")])
    b = b.select(*slot, F.col("participant_id").alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "match").otherwise("conflict")
    return a.join(b, slot, "left").groupBy(status.alias("status")).agg(F.count("*").alias("slots"))


@query("C25_neighbourhood", DAYS + """, p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY event_id) AS pos FROM e)
SELECT a.entity, CAST(b.pos - a.pos AS BIGINT) AS "offset", b.entity AS near_entity, count(*) AS n FROM p a JOIN p b
 ON a.day = b.day AND abs(b.pos - a.pos) BETWEEN 1 AND 2 WHERE a.entity = 'error' GROUP BY 1, 2, 3""")
def neighbourhood(x):
    near = m.neighbourhood(
        _daily(x), ["day"], ["event_id"], o.time_block("t", 3_600_000), [-2, -1, 1, 2], ["entity"]
    ).filter("entity = 'error'")
    return near.groupBy("entity", "offset", "near_entity").agg(F.count("*").alias("n"))


@query("C25_centered_ngrams", DAYS + """ SELECT gram, count(*) AS n FROM (SELECT lag(entity) OVER w || '>' || entity || '>' || lead(entity) OVER w AS gram FROM e
 WINDOW w AS (PARTITION BY day ORDER BY event_id)) WHERE gram IS NOT NULL GROUP BY 1""")
def centered_ngrams(x):
    s = o.scan(
        _daily(x), ["day"], ["event_id"], o.time_block("t", 3_600_000),
        {"p": o.prev("entity"), "n": o.following("entity")},
    ).filter("p IS NOT NULL AND n IS NOT NULL")
    return s.groupBy(F.concat_ws(">", "p", "entity", "n").alias("gram")).agg(F.count("*").alias("n"))


@query("C32_multiset_difference", """SELECT match_id, item_id, CAST(sum(s) AS BIGINT) AS surplus FROM (
 SELECT match_id, item_id, CASE WHEN op = 'ADD' THEN 1 ELSE -1 END AS s FROM {tx}) GROUP BY 1, 2 HAVING sum(s) <> 0""")
def multiset_difference(x):
    return m.multiset_difference(x.tx.filter("op = 'ADD'"), x.tx.filter("op = 'REMOVE'"), ["match_id"], "item_id")


@query("C32_multiset_relation", """SELECT match_id, t, bool_and(s = 0) AS equal, bool_and(s <= 0) AS subset FROM (SELECT match_id, t, item_id,
 sum(CASE WHEN entity = 'O' THEN 1 ELSE -1 END) AS s FROM {tx} GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def multiset_relation(x):
    return m.multiset_relation(x.tx.filter("entity = 'O'"), x.tx.filter("entity = 'F'"), ["match_id", "t"], "item_id")


@query("C33_shuffled_control", """WITH p AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT a.doc_id, a.lang, b.n_chars AS control_n_chars FROM p a JOIN p b ON a.lang = b.lang AND b.i = (a.i + 3) % a.n""")
def shuffled_control(x):
    # a language may hold a third of the documents, so positions come from blocks of ids
    docs = x.documents.select("doc_id", "lang", "n_chars")
    out = m.shuffled_control(docs, ["lang"], ["doc_id"], 3, ["n_chars"], o.time_block("doc_id", 1 << 16))
    return out.select("doc_id", "lang", "control_n_chars")


@query("C39_three_way_outcome", GREEDY.rstrip() + """, lone AS (SELECT match_id, decoded_id, decoded_t AS t FROM pairs WHERE oracle_id IS NULL), rest AS (SELECT match_id, oracle_t AS t FROM pairs WHERE decoded_id IS NULL),
wr AS (SELECT DISTINCT decoded_id FROM lone JOIN rest ON lone.match_id = rest.match_id AND abs(lone.t - rest.t) <= 1)
SELECT match_id, CASE WHEN decoded_id IS NULL THEN 'missing' WHEN oracle_id IS NOT NULL THEN 'matched' WHEN decoded_id IN (SELECT decoded_id FROM wr) THEN 'wrong' ELSE 'extra' END AS outcome, count(*) AS events FROM pairs GROUP BY 1, 2""")
def three_way_outcome(x):
    out = m.label_outcomes(x.dec, x.orc, ["match_id"], ["entity"], "t", "id", TOL, DAY_MS)
    return out.groupBy("match_id", "outcome").agg(F.count("*").alias("events"))
