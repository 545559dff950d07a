"""Event assembly and state folds over the stand-in views."""

from pyspark.sql import functions as F

from eventloom.functions import binary as bn
from eventloom.operators import folds as fd
from eventloom.operators import matching as m
from eventloom.operators import ordered as o
from eventloom.operators import sequences as sq
from eventloom.operators import timejoin as tj
from eventloom.plans.registry import query
from eventloom.plans.standins import DAY_MS, MATCH_CUT, TX_BLOCK_MS, TX_ORDER, with_part

YEAR = TX_BLOCK_MS
TXO = "t, o1, o2, o3, o4"


def txblk():
    return o.time_block("t", YEAR)


@query("I1_kill_assembly", """WITH e AS (SELECT *, t // 86400000 AS day, k // 34 AS who FROM {ev}), p AS (SELECT *, min(CASE WHEN entity = 'purchase' THEN event_id END) OVER (PARTITION BY day ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mk FROM e),
r AS (SELECT p.day, p.mk, mm.who AS victim, mm.t, list(p.who ORDER BY p.event_id) AS ids, bool_and(p.value <= 200) AS ok FROM p JOIN e mm ON mm.event_id = p.mk WHERE p.entity IN ('click', 'view') AND abs(mm.t - p.t) <= 1800000 GROUP BY 1, 2, 3, 4)
SELECT day, t, CASE WHEN NOT ok THEN 'owner-outside-range' WHEN ids[1] <> victim THEN 'victim-mismatch' ELSE 'ok' END AS code, victim, CASE WHEN len(ids) = 1 THEN 0 ELSE ids[-1] END AS killer, array_to_string(CASE WHEN len(ids) <= 2 THEN [] ELSE ids[2:len(ids) - 1] END, ',') AS assists FROM r""")
def kill_assembly(x):
    e = x.ev.withColumns({"day": tj.bucket("t", DAY_MS), "who": F.floor(F.col("k") / 34).cast("long")})
    out = fd.kill_events(
        e, ["day"], ["event_id"], o.time_block("t", 3_600_000), "t", "who", F.col("entity").isin("click", "view"), F.col("entity") == "purchase", 1_800_000, F.col("value") <= 200
    )
    return out.select("day", "t", "code", "victim", "killer", F.array_join(F.col("assists").cast("array<string>"), ",").alias("assists"))


RULES = [("user", 0, 200, "start", 0, 0x54), ("user", 201, 9999, "end", 0, 0x2E), ("assistant", 0, 9999, "end", 0, 0x2E), ("system", 0, 9999, "start", 1, 0x68)]


@query("I2_objective_classification", """WITH r AS (SELECT * FROM (VALUES ('user', 0, 200, 'start', 0, 84), ('user', 201, 9999, 'end', 0, 46), ('assistant', 0, 9999, 'end', 0, 46), ('system', 0, 9999, 'start', 1, 104)) v(packet_type, lo, hi, anchor, off, byte))
SELECT p.packet_type, anchor, count(*) AS n FROM {pk} p JOIN r ON p.packet_type = r.packet_type AND len BETWEEN lo AND hi AND CAST('0x' || substr(hx, CAST(2 * CASE WHEN anchor = 'start' THEN off ELSE len - 1 - off END + 1 AS BIGINT), 2) AS BIGINT) = byte GROUP BY 1, 2""")
def objective_classification(x):
    rules = x.spark.createDataFrame(RULES, "packet_type string, min_length int, max_length int, anchor string, offset int, byte int")
    hit = fd.classify_by_rules(x.pk, rules, "packet_type", "len", "payload", bn.u8)
    return hit.groupBy("packet_type", "anchor").agg(F.count("*").alias("n"))


@query("I3_lifecycle_summary", """WITH e AS (SELECT *, t // 86400000 AS day FROM {ev}), s AS (SELECT *, max(CASE WHEN entity = 'click' THEN event_id END) OVER w AS oid, max(CASE WHEN entity = 'view' THEN event_id END) OVER w AS mid FROM e WINDOW w AS (PARTITION BY day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT s.day, s.event_id FROM s JOIN e o ON o.event_id = s.oid WHERE s.entity = 'view' AND (s.mid IS NULL OR s.mid < s.oid) AND abs(o.t - s.t) <= 600000),
k AS (SELECT r.day, r.event_id FROM e r JOIN e c ON r.day = c.day AND c.entity = 'error' AND c.event_id < r.event_id AND abs(r.t - c.t) <= 600000 WHERE r.entity = 'signup' GROUP BY 1, 2)
SELECT d.day, placements, coalesce(pn, 0) AS owned, removals, coalesce(kn, 0) AS killed FROM (SELECT day, count(*) FILTER (entity = 'view') AS placements, count(*) FILTER (entity = 'signup') AS removals FROM e GROUP BY 1) d
LEFT JOIN (SELECT day, count(*) AS pn FROM p GROUP BY 1) USING (day) LEFT JOIN (SELECT day, count(*) AS kn FROM k GROUP BY 1) USING (day)""")
def lifecycle_summary(x):
    """Placements paired with owners and removals with killers, per match."""
    e = x.ev.withColumn("day", tj.bucket("t", DAY_MS))
    kind = F.col("entity")
    own = m.exclusive_owner(e, ["day"], ["event_id"], o.time_block("t", 3_600_000), kind == "click", kind == "view", "t", "match_id", 600_000)
    kill = m.preceding_candidates(e.filter(kind == "signup"), e.filter(kind == "error"), ["day"], "t", "event_id", "match_id", 600_000)
    base = e.groupBy("day").agg(F.count_if(kind == "view").alias("placements"), F.count_if(kind == "signup").alias("removals"))
    out = base.join(own.groupBy("day").agg(F.count("*").alias("owned")), "day", "left").join(kill.groupBy("day").agg(F.count("*").alias("killed")), "day", "left")
    return out.fillna({"owned": 0, "killed": 0})


SIG = f"""WITH g AS (SELECT match_id, t, string_agg(flag || ':' || CAST(item_id AS VARCHAR), '>' ORDER BY o1, o2, o3, o4) AS signature, CASE WHEN min(entity) = max(entity) THEN min(entity) ELSE 'FO' END AS label FROM {{tx}} GROUP BY 1, 2),
tp AS (SELECT signature, min(label) AS label, count(*) AS support FROM g WHERE match_id < {MATCH_CUT} GROUP BY 1 HAVING count(*) >= 2 AND min(label) = max(label))"""


def _groups(x):
    seq = F.array_sort(F.collect_list(F.struct("o1", "o2", "o3", "o4", "flag", "item_id")))  # one same-time transaction
    g = x.tx.groupBy("match_id", "t").agg(seq.alias("s"), F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    sig = F.array_join(F.transform("s", lambda v: F.concat_ws(":", v["flag"], v["item_id"].cast("string"))), ">")
    return g.select("match_id", "t", sig.alias("signature"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("FO").alias("label"))


@query("I4_bundle_templates", SIG + f""" SELECT CASE WHEN g.match_id < {MATCH_CUT} THEN 'discovery' ELSE 'holdout' END AS part, count(*) AS groups, count(tp.label) AS candidates, count(*) FILTER (tp.label = g.label) AS exact, count(*) FILTER (tp.label <> g.label) AS wrong FROM g LEFT JOIN tp USING (signature) GROUP BY 1""")
def bundle_templates(x):
    """Signatures with one label in discovery become templates; scored on both partitions."""
    g = with_part(_groups(x), x.tx, "match_id")
    tp = g.filter("early").groupBy("signature").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).filter("n >= 2 AND a = b")
    out = g.join(tp.select("signature", F.col("a").alias("tl")), "signature", "left")
    return out.groupBy(F.when(F.col("early"), "discovery").otherwise("holdout").alias("part")).agg(
        F.count("*").alias("groups"), F.count("tl").alias("candidates"), F.count_if(F.col("tl") == F.col("label")).alias("exact"), F.count_if(F.col("tl") != F.col("label")).alias("wrong")
    )


@query("I5_isolated_adds", f"""WITH a AS (SELECT match_id, entity, t, count(*) AS n, max(o3) AS part FROM {{tx}} WHERE op = 'ADD' GROUP BY 1, 2, 3), r AS (SELECT DISTINCT match_id, entity, t FROM {{tx}} WHERE op = 'REMOVE')
SELECT a.match_id, a.entity, a.t, part FROM a WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.match_id = a.match_id AND r.entity = a.entity AND abs(r.t - a.t) <= {3 * DAY_MS}) AND part IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def isolated_adds(x):
    """Exactly one add, no removal close by, and a catalogued item."""
    a = x.tx.filter("op = 'ADD'").groupBy("match_id", "entity", "t").agg(F.count("*").alias("n"), F.max("o3").alias("part")).filter("n = 1").drop("n")
    r = x.tx.filter("op = 'REMOVE'").select("match_id", "entity", "t").distinct()
    near = tj.within(a, r, ["match_id", "entity"], "t", 3 * DAY_MS).select("match_id", "entity", "t").distinct()
    items = x.part.filter("p_size > 10").select(F.col("p_partkey").alias("part"))
    return a.join(near, ["match_id", "entity", "t"], "left_anti").join(items, "part", "left_semi").select("match_id", "entity", "t", "part")


@query("I6_sale_operations", """SELECT match_id, t, max(o3) FILTER (op = 'REMOVE') AS part, max(bit_count(o3 & 21) % 2) FILTER (op = 'REMOVE') AS parity FROM {tx} GROUP BY 1, 2 HAVING count(*) FILTER (op = 'ADD') = 0 AND count(*) FILTER (op = 'REMOVE') = 1 AND max((o3 >> 2) & 7) FILTER (op = 'REMOVE') < 5""")
def sale_operations(x):
    """Groups of no add and one removal whose payload bits pass the predicate."""
    rem = F.col("op") == "REMOVE"
    g = x.tx.groupBy("match_id", "t").agg(
        F.count_if(~rem).alias("adds"), F.count_if(rem).alias("removals"), F.max(F.when(rem, F.col("o3"))).alias("part")
    ).filter("adds = 0 AND removals = 1")
    return g.filter(bn.bit_slice("part", 2, 3) < 5).select("match_id", "t", "part", bn.parity("part", 21).alias("parity"))


@query("I7_substitution_decode", """WITH m AS (SELECT b, count(*) AS n FROM {cell} GROUP BY 1 HAVING count(*) >= 200) SELECT c.family, count(*) AS cells, CAST(sum(CASE WHEN m.b IS NOT NULL THEN m.b // 16 END) AS BIGINT) AS decoded_sum, count(*) FILTER (m.b IS NULL AND c.family < 5) AS by_domain, count(*) FILTER (m.b IS NULL AND c.family >= 5) AS unknown FROM {cell} c LEFT JOIN m USING (b) GROUP BY 1""")
def substitution_decode(x):
    """Known symbols decode through the map; an unknown one only if every domain value projects alike."""
    known = x.cell.groupBy("b").agg(F.count("*").alias("n")).filter("n >= 200").select("b", F.floor(F.col("b") / 16).alias("plain"))
    narrow, wide = F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(40))
    domain = F.when(F.col("family") < 5, narrow).otherwise(wide)
    projected = F.transform(domain, lambda v: F.floor(v / 16))
    agreed = F.array_min(projected) == F.array_max(projected)
    out = x.cell.join(F.broadcast(known), "b", "left")  # at most 256 symbols
    missing = F.col("plain").isNull()
    return out.groupBy("family").agg(
        F.count("*").alias("cells"), F.sum("plain").alias("decoded_sum"), F.count_if(missing & agreed).alias("by_domain"), F.count_if(missing & ~agreed).alias("unknown")
    )


@query("I8_multiset_fold", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY match_id, entity, item_id ORDER BY {TXO}) AS n, CASE WHEN op = 'ADD' THEN 1 ELSE -1 END AS d FROM {{tx}}),
w AS (SELECT match_id, entity, item_id, n, o1, o2, o3, o4, t, greatest(0, d) AS c, greatest(0, d) AS eff FROM s WHERE n = 1 UNION ALL SELECT s.match_id, s.entity, s.item_id, s.n, s.o1, s.o2, s.o3, s.o4, s.t, greatest(0, w.c + s.d), greatest(0, w.c + s.d) - w.c FROM w JOIN s ON s.match_id = w.match_id AND s.entity = w.entity AND s.item_id = w.item_id AND s.n = w.n + 1)
SELECT match_id, entity, item_id, count(*) AS events, CAST(max(c) AS BIGINT) AS peak, CAST(max_by(c, n) AS BIGINT) AS final_count, CAST(sum(eff) AS BIGINT) AS net, CAST(max(held) AS BIGINT) AS held_peak
FROM (SELECT *, sum(eff) OVER (PARTITION BY match_id, entity ORDER BY {TXO} ROWS UNBOUNDED PRECEDING) AS held FROM w) GROUP BY 1, 2, 3""")
def multiset_fold(x):
    f = _fold(x)
    spot = F.struct(*TX_ORDER)
    return f.groupBy("match_id", "entity", "item_id").agg(
        F.count("*").alias("events"), F.max("count").alias("peak"), F.max_by("count", spot).alias("final_count"), F.sum("change").alias("net"), F.max("held").alias("held_peak")
    )


def _fold(x):
    delta = F.when(F.col("op") == "ADD", 1).otherwise(-1).cast("long")
    return fd.multiset_fold(x.tx, ["match_id", "entity"], "item_id", TX_ORDER, txblk(), delta)


POLICIES = ("removed_first", "removed_last", "removed_lowest", "lowest")


def _reduced(x, policies, fold=fd.slot_fold):
    tx = x.tx.withColumn("slot", F.col("item_id") - 1)
    return fold(tx, ["match_id", "entity"], "t", TX_ORDER, txblk(), F.col("op") == "ADD", "slot", policies)


REDUCED = f"""WITH RECURSIVE ps AS (SELECT unnest({list(POLICIES)}) AS policy),
q AS (SELECT match_id, entity, t, op = 'ADD' AS a, item_id - 1 AS slot, row_number() OVER (PARTITION BY match_id, entity ORDER BY t, op = 'ADD', o1, o2, o3, o4) AS n FROM {{tx}}),
w AS (SELECT DISTINCT policy, match_id, entity, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS t, CAST(0 AS BIGINT) AS mask, CAST([] AS BIGINT[]) AS gone, CAST('' AS VARCHAR) AS action, CAST(-1 AS BIGINT) AS at_slot FROM q, ps
 UNION ALL SELECT policy, match_id, entity, n, t, CASE WHEN at_slot < 0 THEN mask WHEN a THEN mask | (1 << at_slot) ELSE mask & (127 - (1 << at_slot)) END, CASE WHEN a THEN gone ELSE list_append(gone, at_slot) END,
  CASE WHEN NOT a THEN CASE WHEN (mask >> at_slot) & 1 = 1 THEN 'hit' ELSE 'empty' END WHEN at_slot < 0 THEN 'overflow' ELSE 'add' END, at_slot
 FROM (SELECT *, CASE WHEN NOT a THEN slot ELSE coalesce(CASE policy WHEN 'removed_first' THEN free[1] WHEN 'removed_last' THEN free[-1] WHEN 'removed_lowest' THEN list_min(free) END,
   list_min([CAST(s AS BIGINT) FOR s IN range(7) IF (mask >> s) & 1 = 0]), -1) END AS at_slot
  FROM (SELECT *, [s FOR s IN gone IF (mask >> s) & 1 = 0] AS free FROM (SELECT w.policy, q.match_id, q.entity, q.n, q.t, q.a, q.slot, w.mask, CASE WHEN w.t = q.t THEN w.gone ELSE CAST([] AS BIGINT[]) END AS gone
   FROM w JOIN q ON q.match_id = w.match_id AND q.entity = w.entity AND q.n = w.n + 1))))"""


@query("I9_slot_reducer", REDUCED + f" SELECT match_id, entity, action, at_slot, count(*) AS n FROM w WHERE n > 0 AND policy = '{POLICIES[0]}' GROUP BY 1, 2, 3, 4")
def slot_reducer(x):
    """Seven-slot forward reducer; per track the count of each action and of adds per slot."""
    return _reduced(x, POLICIES[:1]).groupBy("match_id", "entity", "action", "at_slot").agg(F.count("*").alias("n"))


@query("I10_policy_sweep", REDUCED + f""",
s AS (SELECT *, row_number() OVER (PARTITION BY match_id, entity, item_id ORDER BY {TXO}) AS n, CASE WHEN op = 'ADD' THEN 1 ELSE -1 END AS d FROM {{tx}}),
f AS (SELECT match_id, entity, item_id, n, greatest(0, d) AS c FROM s WHERE n = 1 UNION ALL SELECT s.match_id, s.entity, s.item_id, s.n, greatest(0, f.c + s.d) FROM f JOIN s ON s.match_id = f.match_id AND s.entity = f.entity AND s.item_id = f.item_id AND s.n = f.n + 1),
l AS (SELECT policy, match_id, entity, at_slot AS slot, max_by(action, n) = 'add' AS taken FROM w WHERE action IN ('add', 'hit') GROUP BY 1, 2, 3, 4),
h AS (SELECT policy, match_id, entity, item_id - 1 AS slot, max_by(c, n) > 0 AS held FROM f, ps GROUP BY 1, 2, 3, 4),
k AS (SELECT policy, match_id, entity, count(*) FILTER (coalesce(taken, false) <> coalesce(held, false)) AS wrong, count(*) FILTER (taken) AS taken, count(*) FILTER (held) AS held FROM l FULL JOIN h USING (policy, match_id, entity, slot) GROUP BY 1, 2, 3)
SELECT policy, count(*) AS tracks, count(*) FILTER (wrong = 0) AS exact_slots, count(*) FILTER (taken = held) AS multiset, CAST(sum(7 - wrong) AS BIGINT) AS cells FROM k GROUP BY 1""")
def policy_sweep(x):
    """Final slots of every track under each placement policy against the track's own final state.

    The test data has no final slots, so a stand-in serves as the truth: by the multiset fold, which knows
    no slots, an item that is still held takes the slot of its number. A track is exact when all seven slots
    agree, and agrees as a multiset when as many are taken; cells count the slots that agree.
    """
    track = ["policy", "match_id", "entity"]
    # the last add or hit of a slot says whether it is taken at the end
    last = _reduced(x, POLICIES, fd.final_slots)
    held = _fold(x).groupBy("match_id", "entity", (F.col("item_id") - 1).alias("slot")).agg((F.max_by("count", F.struct(*TX_ORDER)) > 0).alias("held"))
    held = held.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in POLICIES])))
    cells = last.join(held, [*track, "slot"], "full").fillna(False, ["taken", "held"])
    tracks = cells.groupBy(*track).agg(
        F.count_if(F.col("taken") != F.col("held")).alias("wrong"), F.count_if("taken").alias("taken"), F.count_if("held").alias("held")
    )
    return tracks.groupBy("policy").agg(
        F.count("*").alias("tracks"), F.count_if(F.col("wrong") == 0).alias("exact_slots"), F.count_if(F.col("taken") == F.col("held")).alias("multiset"),
        F.sum(F.lit(7) - F.col("wrong")).alias("cells"),
    )


@query("I14_balance_projection", """WITH f AS (SELECT match_id, item_id, count(*) FILTER (entity = 'O') AS final FROM {tx} GROUP BY 1, 2) SELECT match_id, item_id, final - CAST(sum(CASE WHEN op = 'ADD' THEN 1 ELSE -1 END) AS BIGINT) AS imbalance FROM {tx} JOIN f USING (match_id, item_id) GROUP BY 1, 2, final""")
def balance_projection(x):
    """Final holdings minus the signed events, per item."""
    return x.tx.groupBy("match_id", "item_id").agg(
        (F.count_if(F.col("entity") == "O") - F.sum(F.when(F.col("op") == "ADD", 1).otherwise(-1))).alias("imbalance")
    )


@query("I15_gold_ledger", f"""WITH e AS (SELECT match_id, t // {YEAR} AS iv, t, CASE flag WHEN 'A' THEN 'purchase' WHEN 'N' THEN 'component' ELSE 'undo' END AS kind, CASE WHEN p_size > 48 THEN NULL ELSE CAST(floor(p_retailprice) AS BIGINT) END AS cost, CASE WHEN qty > 49 THEN NULL ELSE CAST(qty AS BIGINT) END AS gain FROM {{tx}} JOIN part ON p_partkey = o3),
g AS (SELECT match_id, iv, t, count(*) FILTER (kind = 'purchase') AS p, sum(CASE kind WHEN 'purchase' THEN cost WHEN 'component' THEN -cost END) AS net, count(*) FILTER (kind <> 'undo' AND cost IS NULL) AS gap, coalesce(sum(gain) FILTER (kind = 'undo'), 0) AS u, count(*) FILTER (kind = 'undo' AND gain IS NULL) AS ug FROM e GROUP BY 1, 2, 3)
SELECT match_id, iv AS interval, CAST(sum(CASE WHEN p > 0 AND gap = 0 THEN net ELSE 0 END - u) AS BIGINT) AS adjustment, bool_and((p = 0 OR gap = 0) AND ug = 0) AS complete FROM g GROUP BY 1, 2""")
def gold_ledger(x):
    e = x.tx.join(x.part, F.col("o3") == F.col("p_partkey")).select(
        "match_id", F.floor(F.col("t") / YEAR).alias("interval"), "t",
        F.when(F.col("flag") == "A", "purchase").when(F.col("flag") == "N", "component").otherwise("undo").alias("kind"),
        F.when(F.col("p_size") <= 48, F.floor("p_retailprice")).alias("cost"), F.when(F.col("qty") <= 49, F.col("qty").cast("long")).alias("gain"),
    )
    return fd.ledger(e, ["match_id"], "interval", "t", "kind", "cost", "gain")


SNAP = f"""WITH y AS (SELECT match_id, t // {YEAR} AS yr, item_id, max_by(disc, (t, o1, o2, o3, o4)) AS v FROM {{tx}} GROUP BY 1, 2, 3), s AS (SELECT match_id, yr, unnest(range(0, 7)) AS slot FROM (SELECT DISTINCT match_id, yr FROM y)),
a AS (SELECT s.match_id, s.yr, s.slot, coalesce(y.v, 0) AS v FROM s LEFT JOIN y ON y.match_id = s.match_id AND y.yr = s.yr AND y.item_id = s.slot + 1), yrs AS (SELECT match_id, yr, lag(yr) OVER (PARTITION BY match_id ORDER BY yr) AS py FROM (SELECT DISTINCT match_id, yr FROM y)),"""


def _snapshots(x):
    y = x.tx.groupBy("match_id", F.floor(F.col("t") / YEAR).alias("yr"), "item_id").agg(F.max_by("disc", F.struct(*TX_ORDER)).alias("v"))
    y = y.groupBy("match_id", "yr").agg(F.map_from_entries(F.collect_list(F.struct("item_id", "v"))).alias("mp"))
    slots = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.coalesce(F.col("mp")[i.cast("long")], F.lit(0).cast("long")))
    return y.select("match_id", "yr", slots.alias("slots"))


@query("I16_rearrangements", SNAP + """ c AS (SELECT a.match_id, a.yr, a.slot, b.v AS b, a.v AS a FROM a JOIN yrs ON yrs.match_id = a.match_id AND yrs.yr = a.yr JOIN a b ON b.match_id = a.match_id AND b.yr = yrs.py AND b.slot = a.slot),
sm AS (SELECT match_id, yr, list_sort(list(b)) = list_sort(list(a)) AS same FROM c GROUP BY 1, 2), ch AS (SELECT * FROM c WHERE b <> a),
mv AS (SELECT x.match_id, x.yr, x.b AS item, x.slot AS from_slot, min(z.slot) AS to_slot, count(*) AS n FROM ch x JOIN ch z ON x.match_id = z.match_id AND x.yr = z.yr AND z.slot <> x.slot AND z.a = x.b WHERE x.b <> 0 GROUP BY 1, 2, 3, 4)
SELECT match_id, yr, same AS same_multiset, item, from_slot, to_slot FROM mv JOIN sm USING (match_id, yr) WHERE n = 1""")
def rearrangements(x):
    return fd.rearrangements(_snapshots(x), ["match_id"], "yr", "slots")


@query("I17_ordered_embeddings", """WITH p AS (SELECT DISTINCT l_orderkey AS g, l_returnflag AS f, l_linenumber AS p FROM lineitem), q AS (SELECT g FROM p GROUP BY 1 HAVING count(DISTINCT f) = 3),
c AS (SELECT a.g, count(*) AS n, min((a.p, n.p, r.p)) AS e FROM p a JOIN p n ON a.g = n.g AND n.f = 'N' AND n.p > a.p JOIN p r ON r.g = a.g AND r.f = 'R' AND r.p > n.p WHERE a.f = 'A' GROUP BY 1)
SELECT g, CAST(least(2, coalesce(n, 0)) AS BIGINT) AS embeddings, CASE WHEN n > 0 THEN CAST(e[1] AS VARCHAR) || ',' || CAST(e[2] AS VARCHAR) || ',' || CAST(e[3] AS VARCHAR) END AS earliest FROM q LEFT JOIN c USING (g)""")
def ordered_embeddings(x):
    d = x.lineitem.groupBy(F.col("l_orderkey").alias("g"), "l_returnflag").agg(F.array_sort(F.collect_set("l_linenumber")).alias("ps"))
    d = d.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "ps"))), lambda v: v["ps"]).alias("domains")).filter("size(domains) = 3")
    return fd.ordered_embeddings(d, ["g"], "domains", 7)


UNDO = f"""WITH s AS (SELECT match_id, t, disc AS item FROM {{tx}} WHERE flag = 'R'), u AS (SELECT match_id, t, disc AS item, count(*) AS n FROM {{tx}} WHERE flag = 'N' GROUP BY 1, 2, 3), b AS (SELECT match_id, t, max(item) AS truth FROM u GROUP BY 1, 2),
f AS (SELECT u.match_id, u.t, count(DISTINCT u.item) AS d, max(u.item) AS i FROM u JOIN s ON s.match_id = u.match_id AND s.item = u.item AND s.t <= u.t AND u.t - s.t <= {6 * DAY_MS} WHERE u.n = 1 GROUP BY 1, 2)
SELECT match_id, CASE WHEN d = 1 THEN CASE WHEN i = truth THEN 'exact' ELSE 'wrong' END ELSE 'unavailable' END AS validation, count(*) AS undos FROM b LEFT JOIN f USING (match_id, t) GROUP BY 1, 2"""


@query("I18_undo_linkage", UNDO)
def undo_linkage(x):
    sales = x.tx.filter("flag = 'R'").select("match_id", "t", F.col("disc").alias("item"))
    u = x.tx.filter("flag = 'N'").groupBy("match_id", "t", F.col("disc").alias("item")).agg(F.count("*").alias("n"))
    top = u.groupBy("match_id", "t").agg(F.max("item").alias("truth"))
    u = u.join(top, ["match_id", "t"]).withColumn("uid", F.col("t"))
    out = fd.undo_linkage(sales, u, ["match_id"], "t", "uid", "item", 6 * DAY_MS)
    return out.groupBy("match_id", "validation").agg(F.count("*").alias("undos"))


@query("I19_grammar_check", """WITH p AS (SELECT *, lag(packet_type) OVER w AS pv, lead(packet_type) OVER w AS nx FROM {pk} WINDOW w AS (PARTITION BY match_id ORDER BY block_index))
SELECT match_id, count(*) AS tokens, count(*) FILTER (NOT (pv IS NULL OR pv || '>' || packet_type IN ('system>user', 'user>assistant', 'assistant>user'))) AS bad_steps,
 bool_and((pv IS NULL OR pv || '>' || packet_type IN ('system>user', 'user>assistant', 'assistant>user')) AND (pv IS NOT NULL OR packet_type IN ('system', 'user')) AND (nx IS NOT NULL OR packet_type = 'assistant')) AS exact FROM p GROUP BY 1""")
def grammar_check(x):
    allowed = [("system", "user"), ("user", "assistant"), ("assistant", "user")]
    d = x.pk.select("match_id", "block_index", "packet_type")
    return fd.grammar_check(d, ["match_id"], ["block_index"], o.time_block("block_index", 4096), "packet_type", allowed, ["system", "user"], ["assistant"])


@query("I20_strict_labels", f"""WITH g AS (SELECT match_id, t, count(*) AS n, count(*) FILTER (flag = 'N') AS d, count(*) FILTER (flag = 'A') AS p, count(*) FILTER (flag = 'R') AS s, max(t) OVER (PARTITION BY match_id) AS lt FROM {{tx}} GROUP BY 1, 2),
b AS (SELECT match_id, t FROM {{tx}} WHERE disc >= 8), c AS (SELECT g.*, (SELECT count(*) FROM b WHERE b.match_id = g.match_id AND abs(b.t - g.t) <= {DAY_MS}) AS near FROM g)
SELECT CASE WHEN n = 2 AND d = 1 AND p = 1 THEN 'replacement' ELSE 'sale' END AS label, count(*) AS n, count(*) FILTER (t = lt) AS without_later FROM c WHERE near = 1 AND ((n = 2 AND d = 1 AND p = 1) OR (n = 1 AND s = 1)) GROUP BY 1""")
def strict_labels(x):
    """Exactly one destroy+purchase, or one lone sale, with exactly one block close by."""
    flag = F.col("flag")
    g = x.tx.groupBy("match_id", "t").agg(
        F.count("*").alias("n"), F.count_if(flag == "N").alias("d"), F.count_if(flag == "A").alias("p"), F.count_if(flag == "R").alias("s")
    )
    last = g.groupBy("match_id").agg(F.max("t").alias("lt"))
    blocks = x.tx.filter("disc >= 8").select("match_id", "t", F.col("o1").alias("b"))
    kind = F.when((F.col("n") == 2) & (F.col("d") == 1) & (F.col("p") == 1), "replacement").when((F.col("n") == 1) & (F.col("s") == 1), "sale")
    g = g.withColumn("label", kind).filter("label IS NOT NULL")
    spots = g.select("match_id", "t", F.col("t").alias("b"))
    near = tj.window_counts(spots, blocks, ["match_id"], "t", "b", DAY_MS, "near").filter("near = 1").select("match_id", F.col("b").alias("t"))
    out = g.join(near, ["match_id", "t"]).join(last, "match_id")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("t") == F.col("lt")).alias("without_later"))


@query("I21_latest_item_action", f"""WITH y AS (SELECT DISTINCT match_id, item_id, (t // {YEAR} + 1) * {YEAR} AS cut FROM {{tx}}) SELECT y.match_id, y.item_id, y.cut, max_by(CASE WHEN op = 'ADD' THEN 'acquire' ELSE 'remove' END, (a.t, o1, o2, o3, o4)) AS action, max(a.t) AS t FROM y JOIN {{tx}} a ON a.match_id = y.match_id AND a.item_id = y.item_id AND a.t <= y.cut + 1 GROUP BY 1, 2, 3""")
def latest_item_action(x):
    """Latest labelled action per item at each snapshot time, by backward as-of."""
    cut = (F.floor(F.col("t") / YEAR) + 1) * YEAR
    y = x.tx.select("match_id", "item_id", (cut + 1).alias("t")).distinct().withColumn("o", F.array(F.lit(0.0)))
    a = x.tx.withColumns({"action": F.when(F.col("op") == "ADD", "acquire").otherwise("remove"), "o": F.array("o1", "o2", "o3", "o4").cast("array<double>")})
    a = a.select("match_id", "item_id", "t", "o", "action")
    out = tj.neighbours(y, a, ["match_id", "item_id"], "t", "o", YEAR, backward="b", forward=None)
    return out.select("match_id", "item_id", (F.col("t") - 1).alias("cut"), F.col("b.action").alias("action"), F.col("b.t").alias("t"))


@query("I21_snapshot_vs_fold", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY match_id, entity, item_id ORDER BY {TXO}) AS n, CASE WHEN op = 'ADD' THEN 1 ELSE -1 END AS d FROM {{tx}}),
w AS (SELECT match_id, entity, item_id, n, t, greatest(0, d) AS c FROM s WHERE n = 1 UNION ALL SELECT s.match_id, s.entity, s.item_id, s.n, s.t, greatest(0, w.c + s.d) FROM w JOIN s ON s.match_id = w.match_id AND s.entity = w.entity AND s.item_id = w.item_id AND s.n = w.n + 1),
f AS (SELECT match_id, entity, item_id, t // {YEAR} AS yr, max_by(c, n) AS folded FROM w GROUP BY 1, 2, 3, 4), l AS (SELECT match_id, entity, item_id, t // {YEAR} AS yr, sum(d) AS d FROM s GROUP BY 1, 2, 3, 4), lc AS (SELECT *, sum(d) OVER (PARTITION BY match_id, entity, item_id ORDER BY yr) AS net FROM l),
p AS (SELECT match_id, entity, yr, bool_and(folded = greatest(net, 0)) AS ex, bool_and(folded <= greatest(net, 0)) AS sb FROM f JOIN lc USING (match_id, entity, item_id, yr) GROUP BY 1, 2, 3)
SELECT yr, count(*) AS snapshots, count(*) FILTER (ex) AS exact, count(*) FILTER (sb) AS subset, count(*) FILTER (NOT sb) AS false_extra FROM p GROUP BY 1""")
def snapshot_vs_fold(x):
    """Folded state at each year's end against the net labelled count: exact, subset or false extra."""
    yr = F.floor(F.col("t") / YEAR)
    spot = F.struct(*TX_ORDER)
    f = _fold(x).groupBy("match_id", "entity", "item_id", yr.alias("yr")).agg(F.max_by("count", spot).alias("folded"))
    sign = F.when(F.col("op") == "ADD", 1).otherwise(-1)
    lab = x.tx.groupBy("match_id", "entity", "item_id", yr.alias("yr")).agg(F.sum(sign).alias("d"))
    lab = o.scan(lab, ["match_id", "entity", "item_id"], ["yr"], None, {"net": o.run_sum("d")})
    j = f.join(lab, ["match_id", "entity", "item_id", "yr"])
    per = j.groupBy("match_id", "entity", "yr").agg(
        F.bool_and(F.col("folded") == F.greatest("net", F.lit(0))).alias("exact"), F.bool_and(F.col("folded") <= F.greatest("net", F.lit(0))).alias("subset")
    )
    return per.groupBy("yr").agg(
        F.count("*").alias("snapshots"), F.count_if("exact").alias("exact"), F.count_if("subset").alias("subset"), F.count_if(~F.col("subset")).alias("false_extra")
    )


CLOSE = """WITH RECURSIVE c AS (SELECT c_custkey AS node, c_custkey // 2 AS ancestor FROM customer WHERE c_custkey > 0 UNION SELECT c.node, c.ancestor // 2 FROM c WHERE c.ancestor > 0)"""


def _closure(x):
    e = x.customer.filter("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 2).alias("parent"))
    return fd.closure(e, "child", "parent")


@query("C29_transitive_closure", CLOSE + " SELECT node, ancestor FROM c")
def transitive_closure(x):
    return _closure(x)


@query("C29_recipe_equivalence", "SELECT p_brand, p_type, p_size, count(*) AS members, min(p_partkey) AS canonical FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1")
def recipe_equivalence(x):
    return x.part.groupBy("p_brand", "p_type", "p_size").agg(F.count("*").alias("members"), F.min("p_partkey").alias("canonical")).filter("members > 1")


@query("C30_candidate_sets", CLOSE + f""", fa AS (SELECT match_id, entity, disc AS item, min((t, o1, o2, o3, o4)) AS fo FROM {{tx}} WHERE op = 'ADD' GROUP BY 1, 2, 3), r AS (SELECT match_id, entity, disc AS truth, qty, (t, o1, o2, o3, o4) AS ro, o1, o3 FROM {{tx}} WHERE op = 'REMOVE'),
j AS (SELECT r.match_id, r.o1, r.o3, any_value(truth) AS truth, count(fa.item) AS n, bool_or(fa.item = truth) AS hit FROM r JOIN c ON c.node = CAST(r.qty AS BIGINT) JOIN fa ON fa.match_id = r.match_id AND fa.entity = r.entity AND fa.item = c.ancestor AND fa.fo < r.ro GROUP BY r.match_id, r.entity, r.ro, r.o1, r.o3)
SELECT CASE WHEN n = 1 AND hit THEN 'singleton_correct' WHEN n = 1 THEN 'singleton_wrong' WHEN hit THEN 'ambiguous' ELSE 'impossible' END AS class, count(*) AS removals, CAST(sum(n) AS BIGINT) AS candidates, max(n) AS most FROM j GROUP BY 1""")
def candidate_sets(x):
    """Prior adds that the recipe closure allows, per removal.

    An item is a prior add when its first add comes earlier, so one row per item replaces a
    growing set per removal.
    """
    spot = F.struct(*TX_ORDER)
    first = x.tx.filter("op = 'ADD'").groupBy("match_id", "entity", F.col("disc").alias("item")).agg(F.min(spot).alias("fo"))
    rem = x.tx.filter("op = 'REMOVE'").select("match_id", "entity", F.col("disc").alias("truth"), F.col("qty").cast("long").alias("node"), spot.alias("ro"))
    allowed = _closure(x).select("node", F.col("ancestor").alias("item"))
    j = rem.join(allowed, "node").join(first, ["match_id", "entity", "item"]).filter("fo < ro")
    g = j.groupBy("match_id", "entity", "ro").agg(F.count("*").alias("n"), F.bool_or(F.col("item") == F.col("truth")).alias("hit"))
    cls = F.when((F.col("n") == 1) & F.col("hit"), "singleton_correct").when(F.col("n") == 1, "singleton_wrong").when(F.col("hit"), "ambiguous").otherwise("impossible")
    return g.groupBy(cls.alias("class")).agg(F.count("*").alias("removals"), F.sum("n").alias("candidates"), F.max("n").alias("most"))


@query("C31_physical_predecessor", """SELECT match_id, o1, o3, t, count(*) FILTER (op = 'ADD') OVER (PARTITION BY match_id, entity ORDER BY t, o1, o2, o3, o4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_adds FROM {tx} QUALIFY op = 'REMOVE'""")
def physical_predecessor(x):
    add = F.col("op") == "ADD"
    out = o.scan(x.tx, ["match_id", "entity"], TX_ORDER, txblk(), {"prior_adds": o.run_count(add)})
    return out.filter(~add).select("match_id", "o1", "o3", "t", "prior_adds")
