"""Sweeps and learning over fixed-size records joined with document labels."""

from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import matching as m
from eventloom.operators import ordered as o
from eventloom.operators import payload as pl
from eventloom.operators import quantiles as q
from eventloom.operators import series as sr
from eventloom.operators import sweeps as sw
from eventloom.operators import timejoin as tj
from eventloom.plans.registry import query
from eventloom.plans.standins import DAY_MS, MATCH_CUT, REC_CUT, with_part

# fixed values: rough centres of the two targets, only there for numeric accuracy
CENTER = {"y1": 2500.0, "y2": 127.0}
LABS = """WITH lb AS (SELECT family, rec_id, arr, CAST(n_chars AS DOUBLE) AS y1, CAST(arr[3] + 2 * arr[10] AS DOUBLE) / 3 + n_chars / 400.0 AS y2 FROM {rec} JOIN documents ON doc_id = rec_id)"""


def _lab(x):
    """Records with two targets: the document's length and a mix of two record bytes."""
    d = x.documents.select(F.col("doc_id").alias("rec_id"), "n_chars")
    mix = (F.element_at("arr", 3) + 2 * F.element_at("arr", 10)).cast("double") / 3 + F.col("n_chars") / 400.0
    return x.rec.join(d, "rec_id").select("family", "rec_id", "arr", F.col("n_chars").cast("double").alias("y1"), mix.alias("y2"))


def _fields():
    out = [sw.Field(i, i, "u", 1) for i in range(64)]
    out += [sw.Field(100 + i, i, "u", 2) for i in range(63)]
    out += [sw.Field(200 + i, i, "u", 2, little=False) for i in range(63)]
    return out


SPECS = LABS + """, sp AS (SELECT family, y1, y2, unnest(range(64)) AS spec, unnest(arr) AS v FROM lb UNION ALL
 SELECT family, y1, y2, 100 + i, arr[i + 1] + 256 * arr[i + 2] FROM lb, (SELECT unnest(range(63)) AS i) UNION ALL SELECT family, y1, y2, 200 + i, 256 * arr[i + 1] + arr[i + 2] FROM lb, (SELECT unnest(range(63)) AS i)),
sl AS (SELECT family, spec, v, unnest(['y1', 'y2']) AS target, unnest([y1, y2]) AS y FROM sp),
e AS (SELECT spec, target, family, count(*) AS n, regr_sxy(y, v) AS xy, regr_sxx(y, v) AS xx, regr_syy(y, v) AS yy FROM sl GROUP BY 1, 2, 3),
w AS (SELECT spec, target, sum(xy) / sqrt(sum(xx) * sum(yy)) AS wr FROM e GROUP BY 1, 2), g AS (SELECT spec, target, count(*) AS n, corr(y, v) AS gr, regr_sxx(y, v) AS spread FROM sl GROUP BY 1, 2),
sc AS (SELECT *, 0.68 * abs(wr) + 0.32 * abs(gr) AS score FROM g JOIN w USING (spec, target) WHERE spread > 1e-9)"""


def _scores(x):
    sums = sw.moments(_lab(x), ["family"], "arr", ["y1", "y2"], _fields(), CENTER)
    return sw.field_scores(sums, ["family"])


@query("J1_byte_field_sweep", SPECS + """ SELECT spec, target, n, R6(wr) AS within_r, R6(gr) AS global_r, R6(score) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, spec) <= 20""")
def byte_field_sweep(x):
    t = o.top_k(_scores(x), ["target"], [F.desc(F.round("score", 9)), F.asc("spec")], 20)
    return t.select("spec", "target", F.col("n").cast("long").alias("n"), "within_r", "global_r", "score")


BITS = LABS + """, wd AS (SELECT rec_id, y2, i, arr[i + 1] + (coalesce(arr[i + 2], 0) << 8) + (coalesce(arr[i + 3], 0) << 16) + (coalesce(arr[i + 4], 0) << 24) AS le, (arr[i + 1] << 24) + (coalesce(arr[i + 2], 0) << 16) + (coalesce(arr[i + 3], 0) << 8) + coalesce(arr[i + 4], 0) AS be FROM lb, (SELECT unnest(range(64)) AS i)),
b AS (SELECT y2, i * 8 + s AS st, w, s, le, be FROM wd, (SELECT unnest(range(8)) AS s), (SELECT unnest(range(10, 19)) AS w) WHERE i * 8 + s + w <= 512),
v AS (SELECT st, w, 1 AS little, (le >> s) & ((1 << w) - 1) AS v, y2 FROM b UNION ALL SELECT st, w, 0, (be >> (32 - s - w)) & ((1 << w) - 1), y2 FROM b),
g AS (SELECT st, w, little, corr(y2, v) AS r, count(DISTINCT v) AS d FROM v GROUP BY 1, 2, 3)"""


@query("J2_bit_field_sweep", BITS + """ SELECT st AS start_bit, w AS width, little = 1 AS little, R6(abs(r)) AS correlation FROM g WHERE d >= 5 ORDER BY round(abs(r), 9) DESC, st, w, little DESC LIMIT 40""")
def bit_field_sweep(x):
    """All bit windows of 10 to 18 bits in both orders against one target, with five or more values."""
    fields, spec = [], 0
    for start in range(512):
        for width in range(10, 19):
            for little in (True, False):
                if start + width <= 512:
                    fields.append(sw.Field(start * 64 + width * 2 + int(little), start, "bits", width, little))
    lab = _lab(x)
    sc = sw.field_scores(sw.moments(lab, [], "arr", ["y2"], fields, CENTER), [])
    sc = sc.join(sw.smallest_values(lab, "arr", fields, 5).filter("distinct_values >= 5"), "spec")
    low = F.pmod(F.col("spec"), F.lit(64))
    out = sc.select(
        F.floor(F.col("spec") / 64).alias("start_bit"), F.floor(low / 2).alias("width"), (F.pmod(low, F.lit(2)) == 1).alias("little"), F.abs("global_r").alias("correlation")
    )
    return out.orderBy(F.desc(F.round("correlation", 9)), "start_bit", "width", F.desc("little")).limit(40)


TRANSFORMS = [("one", 1.0, 0.0), ("half", 0.5, 0.0), ("tenth", 0.1, 0.0), ("ten", 10.0, 0.0), ("shifted", 1.0, 64.0), ("flipped", -1.0, 255.0)]
TSQL = "(SELECT * FROM (VALUES ('one', 1.0, 0.0), ('half', 0.5, 0.0), ('tenth', 0.1, 0.0), ('ten', 10.0, 0.0), ('shifted', 1.0, 64.0), ('flipped', -1.0, 255.0)) z(id, sc, sh))"


@query("J3_strided_sweep", LABS + """, v AS (SELECT st, e, i, CASE e WHEN 1 THEN arr[i + 1] + 256 * arr[i + 1 + st] ELSE 256 * arr[i + 1] + arr[i + 1 + st] END AS v, y2 FROM lb, (SELECT unnest([1, 2, 4]) AS st), (SELECT unnest([1, 0]) AS e), (SELECT unnest(range(63)) AS i) WHERE i + st < 64),
g AS (SELECT st, e, i, abs(corr(y2, v)) AS r FROM v GROUP BY 1, 2, 3) SELECT i AS "offset", st AS stride, e = 1 AS little, R6(r) AS correlation FROM g ORDER BY round(r, 9) DESC, i, st, e DESC LIMIT 30""")
def strided_sweep(x):
    fields = [sw.Field(i * 16 + st * 2 + int(le), i, "u", 2, le, st) for i in range(63) for st in (1, 2, 4) for le in (True, False) if i + st < 64]
    sc = sw.field_scores(sw.moments(_lab(x), [], "arr", ["y2"], fields, CENTER), [])
    low = F.pmod(F.col("spec"), F.lit(16))
    out = sc.select(F.floor(F.col("spec") / 16).alias("offset"), F.floor(low / 2).alias("stride"), (F.pmod(low, F.lit(2)) == 1).alias("little"), F.abs("global_r").alias("correlation"))
    return out.orderBy(F.desc(F.round("correlation", 9)), "offset", "stride", F.desc("little")).limit(30)


@query("J4_direct_transform_fields", LABS + f""", v AS (SELECT unnest(range(64)) AS spec, unnest(arr) AS v, y2 FROM lb), g AS (SELECT spec, id, sqrt(avg(power(sc * v + sh - y2, 2))) AS rmse FROM v, {TSQL} GROUP BY 1, 2)
SELECT spec, id AS transform, R6(rmse) AS rmse FROM g QUALIFY row_number() OVER (PARTITION BY spec ORDER BY rmse, id) = 1""")
def direct_transform_fields(x):
    sums = sw.moments(_lab(x), [], "arr", ["y2"], _fields()[:64], CENTER)
    return sw.transform_errors(sums, TRANSFORMS, CENTER).select("spec", "transform", "rmse")


@query("D74_best_direct_transform", LABS + f""", v AS (SELECT unnest(range(64)) AS spec, unnest(arr) AS v, y2 FROM lb), g AS (SELECT spec, id, sc, sh, sqrt(avg(power(sc * v + sh - y2, 2))) AS rmse FROM v, {TSQL} GROUP BY ALL),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY spec ORDER BY rmse, id) = 1) SELECT spec, any_value(id) AS transform, R6(avg(CASE WHEN abs(sc * v + sh - y2) <= 20 THEN 1.0 ELSE 0 END)) AS within_tolerance, R6(max(abs(sc * v + sh - y2))) AS max_error FROM v JOIN b USING (spec) GROUP BY 1""")
def best_direct_transform(x):
    """Best fixed transform per field and how many rows it hits within tolerance."""
    lab = _lab(x)
    best = sw.transform_errors(sw.moments(lab, [], "arr", ["y2"], _fields()[:64], CENTER), TRANSFORMS, CENTER)
    rows = lab.select("y2", F.posexplode("arr").alias("spec", "v")).join(F.broadcast(best.select("spec", "transform", "scale", "shift")), "spec")
    err = F.abs(F.col("scale") * F.col("v") + F.col("shift") - F.col("y2"))
    return rows.groupBy("spec").agg(F.max("transform").alias("transform"), s.ratio(err <= 20).alias("within_tolerance"), F.max(err).alias("max_error"))


@query("J5_pair_scoring", SPECS + """, tk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, spec) AS r, spec % 100 AS off, CASE WHEN spec < 100 THEN 1 ELSE 2 END AS w FROM sc QUALIFY r <= 12)
SELECT a.spec AS x_spec, b.spec AS y_spec, R6(a.score + b.score) AS score FROM tk a JOIN tk b ON a.target = 'y1' AND b.target = 'y2' AND (a.off + a.w <= b.off OR b.off + b.w <= a.off) AND abs(a.off - b.off) <= 16""")
def pair_scoring(x):
    """Best x-fields with best y-fields that do not overlap and lie within 128 bits."""
    t = o.top_k(_scores(x), ["target"], [F.desc(F.round("score", 9)), F.asc("spec")], 12)
    t = t.select("target", "spec", "score", F.pmod("spec", F.lit(100)).alias("off"), F.when(F.col("spec") < 100, 1).otherwise(2).alias("w"))
    a = t.filter("target = 'y1'").select(F.lit(1).alias("g"), F.col("spec").alias("x_spec"), F.col("score").alias("xs"), F.col("off").alias("xo"), F.col("w").alias("xw"))
    b = t.filter("target = 'y2'").select(F.lit(1).alias("g"), F.col("spec").alias("y_spec"), F.col("score").alias("ys"), F.col("off").alias("yo"), F.col("w").alias("yw"))
    apart = (F.col("xo") + F.col("xw") <= F.col("yo")) | (F.col("yo") + F.col("yw") <= F.col("xo"))
    return a.join(F.broadcast(b), "g").filter(apart & (F.abs(F.col("xo") - F.col("yo")) <= 16)).select("x_spec", "y_spec", (F.col("xs") + F.col("ys")).alias("score"))


@query("J6_coordinate_plausibility", LABS + """, v AS (SELECT i, arr[i + 1] * 60 AS px, arr[i + 2] * 60 AS py, 7500 + y1 / 10 AS ox, 7600 AS oy FROM lb, (SELECT unnest(range(63)) AS i)), d AS (SELECT *, sqrt(power(px - ox, 2) + power(py - oy, 2)) AS d FROM v), m AS (SELECT median(d) AS md FROM d)
SELECT i AS "offset", R6(avg(CASE WHEN px BETWEEN 0 AND 15000 AND py BETWEEN 0 AND 15000 THEN 1.0 ELSE 0 END)) AS in_bounds, R6(avg(CASE WHEN d <= 1500 THEN 1.0 ELSE 0 END)) AS near_owner, R6(avg(CASE WHEN d < md THEN 1.0 ELSE 0 END)) AS closer_than_median FROM d, m GROUP BY 1""")
def coordinate_plausibility(x):
    lab = _lab(x)
    v = lab.select("y1", "arr", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("offset"))
    px, py = F.element_at("arr", F.col("offset") + 1) * 60, F.element_at("arr", F.col("offset") + 2) * 60
    d = F.sqrt(F.pow(px - (7500 + F.col("y1") / 10), F.lit(2.0)) + F.pow(py - F.lit(7600.0), F.lit(2.0)))
    v = v.select("offset", px.alias("px"), py.alias("py"), d.alias("d"), F.lit(0).alias("g"))
    med = q.quantiles(v, ["g"], "d", {"md": 0.5})
    v = v.join(F.broadcast(med), "g")
    return v.groupBy("offset").agg(
        s.ratio(F.col("px").between(0, 15000) & F.col("py").between(0, 15000)).alias("in_bounds"), s.ratio(F.col("d") <= 1500).alias("near_owner"), s.ratio(F.col("d") < F.col("md")).alias("closer_than_median")
    )


SHIFTS = [-7_200_000, -3_600_000, 0, 3_600_000, 7_200_000]


@query("J7_time_shift_search", """WITH sh AS (SELECT unnest([-7200000, -3600000, 0, 3600000, 7200000]) AS s), c AS (SELECT match_id, s, event_id, t + s AS t FROM {ev}, sh WHERE entity = 'click'), e AS (SELECT match_id, event_id AS eid, t AS et FROM {ev} WHERE entity = 'purchase'),
b AS (SELECT c.*, e.et AS bt, e.eid AS bid FROM c ASOF LEFT JOIN e ON c.match_id = e.match_id AND c.t >= e.et), n AS (SELECT b.*, e.et AS ft, e.eid AS fid FROM b ASOF LEFT JOIN e ON b.match_id = e.match_id AND b.t < e.et),
h AS (SELECT match_id, s, CASE WHEN bt IS NULL OR ft - t < t - bt THEN fid ELSE bid END AS eid, CASE WHEN bt IS NULL OR ft - t < t - bt THEN ft - t ELSE t - bt END AS d FROM n),
g AS (SELECT match_id, s, count(*) AS changes, count(*) FILTER (d <= 3600000) AS mc, count(DISTINCT eid) FILTER (d <= 3600000) AS me, avg(d) FILTER (d <= 3600000) AS ad FROM h GROUP BY 1, 2), en AS (SELECT match_id, count(*) AS events FROM e GROUP BY 1),
p AS (SELECT g.*, events, mc / changes AS pr, me / events AS rc FROM g JOIN en USING (match_id)), f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM p),
z AS (SELECT *, (pr * 0.2 + rc * 0.5 + f1 * 0.2 + CASE WHEN mc > 0 THEN greatest(0, 1 - ad / 3600000) ELSE 0 END * 0.1) * least(1, me / 10) * least(1, mc / 10) * greatest(0.2, 1 - abs(s) / 7200000 * 0.8) AS score FROM f)
SELECT match_id, s AS shift, R6(pr) AS precision, R6(rc) AS recall, R6(score) AS score FROM z QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY round(score, 9) DESC, pr DESC, coalesce(ad, 1e18), s) = 1""")
def time_shift_search(x):
    """Best constant shift between two streams per match (fixed score weights)."""
    shifts = F.array(*[F.lit(v).cast("long") for v in SHIFTS])
    c = x.ev.filter("entity = 'click'").select("match_id", "event_id", "t", F.explode(shifts).alias("shift")).withColumn("t", F.col("t") + F.col("shift"))
    e = x.ev.filter("entity = 'purchase'").select("match_id", "event_id", "t")
    es = e.withColumn("shift", F.explode(shifts))
    near = tj.nearest(c, es, ["match_id", "shift"], "t", "event_id", DAY_MS, tolerance=3_600_000)
    g = near.groupBy("match_id", "shift").agg(
        F.count("*").alias("changes"), F.count("delta").alias("mc"), F.count_distinct("near.event_id").alias("me"), F.avg("delta").alias("ad")
    ).join(e.groupBy("match_id").agg(F.count("*").alias("events")), "match_id")
    pr, rc = F.col("mc") / F.col("changes"), F.col("me") / F.col("events")
    f1 = F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0))
    close = F.when(F.col("mc") > 0, F.greatest(F.lit(0.0), 1 - F.col("ad") / 3_600_000)).otherwise(0.0)
    cover = F.least(F.lit(1.0), F.col("me") / 10) * F.least(F.lit(1.0), F.col("mc") / 10)
    penalty = F.greatest(F.lit(0.2), 1 - F.abs("shift") / 7_200_000 * 0.8)
    g = g.withColumns({"precision": pr, "recall": rc, "score": (pr * 0.2 + rc * 0.5 + f1 * 0.2 + close * 0.1) * cover * penalty})
    best = o.best(g, ["match_id"], [F.desc(F.round("score", 9)), F.desc("precision"), F.asc(F.coalesce("ad", F.lit(1e18))), F.asc("shift")])
    return best.select("match_id", "shift", "precision", "recall", "score")


@query("J8_shift_axis_alignment", """WITH v AS (SELECT p.match_id, p.entity, ax, CASE ax WHEN 'swapped' THEN ry ELSE rx END AS x, CASE ax WHEN 'swapped' THEN rx WHEN 'flipped' THEN -ry ELSE ry END AS y, tx, ty FROM {pair} p, (SELECT unnest(['normal', 'swapped', 'flipped']) AS ax)),
g AS (SELECT match_id, entity, ax, count(*) AS n, CASE WHEN regr_sxx(tx, x) <= 1e-9 OR regr_syy(tx, x) <= 1e-9 THEN 0 ELSE corr(tx, x) END AS cx, CASE WHEN regr_sxx(ty, y) <= 1e-9 OR regr_syy(ty, y) <= 1e-9 THEN 0 ELSE corr(ty, y) END AS cy FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 6)
SELECT match_id, entity, ax AS axis, R6((cx + cy) / 2) AS alignment FROM g QUALIFY row_number() OVER (PARTITION BY match_id, entity ORDER BY round((cx + cy) / 2, 9) DESC, ax) = 1""")
def shift_axis_alignment(x):
    axes = F.array(F.lit("normal"), F.lit("swapped"), F.lit("flipped"))
    v = x.pair.withColumn("axis", F.explode(axes))
    sw_, fl = F.col("axis") == "swapped", F.col("axis") == "flipped"
    v = v.withColumns({"x": F.when(sw_, F.col("ry")).otherwise(F.col("rx")), "y": F.when(sw_, F.col("rx")).when(fl, -F.col("ry")).otherwise(F.col("ry"))})
    g = v.groupBy("match_id", "entity", "axis").agg(F.count("*").alias("n"), ((s.pearson_zero("x", "tx") + s.pearson_zero("y", "ty")) / 2).alias("alignment")).filter("n >= 6")
    return o.best(g, ["match_id", "entity"], [F.desc(F.round("alignment", 9)), F.asc("axis")]).drop("n")


TRAIN = """WITH c AS (SELECT pos, b // 8 AS key, family % 3 AS label, rec_id FROM {cell}), tr AS (SELECT * FROM c WHERE rec_id < REC_CUT), te AS (SELECT * FROM c WHERE rec_id >= REC_CUT)""".replace("REC_CUT", REC_CUT)


def _cells(x):
    c = x.cell.select("pos", F.floor(F.col("b") / 8).alias("key"), F.pmod("family", F.lit(3)).alias("label"), "rec_id", "family")
    parted = with_part(c, x.rec, "rec_id")
    return c, parted.filter("early").drop("early"), parted.filter("NOT early").drop("early")


@query("J9_conflict_free_lookup", TRAIN + """, lk AS (SELECT pos, key, min(label) AS p FROM tr GROUP BY 1, 2 HAVING min(label) = max(label))
SELECT pos, count(*) AS rows, count(*) FILTER (p = label) AS exact, count(*) FILTER (p <> label) AS wrong, count(*) FILTER (p IS NULL) AS unavailable FROM te LEFT JOIN lk USING (pos, key) GROUP BY 1""")
def conflict_free_lookup(x):
    _, tr, te = _cells(x)
    return sw.score_lookup(te, sw.learn_lookup(tr, ["pos"], "key", "label"), ["pos"], "key", "label")


@query("J10_majority_lookup", TRAIN + """, n AS (SELECT pos, key, label, count(*) AS n FROM tr GROUP BY 1, 2, 3), lk AS (SELECT pos, key, label AS p FROM n QUALIFY row_number() OVER (PARTITION BY pos, key ORDER BY n DESC, CAST(label AS VARCHAR)) = 1)
SELECT pos, count(*) AS rows, count(*) FILTER (p = label) AS exact, count(*) FILTER (p <> label) AS wrong, count(*) FILTER (p IS NULL) AS unavailable FROM te LEFT JOIN lk USING (pos, key) GROUP BY 1""")
def majority_lookup(x):
    _, tr, te = _cells(x)
    return sw.score_lookup(te, sw.learn_lookup(tr, ["pos"], "key", "label", strict=False), ["pos"], "key", "label")


@query("J11_xor_linkage", """WITH g AS (SELECT family, rec_id, pos // 8 AS row, pos % 8 AS off, b // 16 AS b FROM {cell}), n AS (SELECT a.off AS a_off, z.off AS b_off, xor(a.b, z.b) AS x, count(*) AS n FROM g a JOIN g z ON a.rec_id = z.rec_id AND a.row = z.row AND a.off < z.off GROUP BY 1, 2, 3)
SELECT a_off, b_off, max(x) FILTER (r = 1) AS constant, max(n) AS support, CAST(sum(n) AS BIGINT) AS rows, R6(max(n) / sum(n)) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY a_off, b_off ORDER BY n DESC, x) AS r FROM n) GROUP BY 1, 2""")
def xor_linkage(x):
    """Every column pair of the 8-byte record row; the eight columns of a row pair inside the record."""
    row = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("arr", i * 8 + 1, 8), lambda v: F.floor(v / 16)))
    r = x.rec.select(F.explode(row).alias("r"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a_off"), F.lit(b).alias("b_off"), F.element_at("r", a + 1).alias("a"), F.element_at("r", b + 1).alias("b")) for a in range(8) for b in range(a + 1, 8)])
    p = r.select(F.explode(pairs).alias("p")).select("p.*")
    return sw.xor_linkage(p, ["a_off", "b_off"], "a", "b")


@query("J12_xor_bit_models", """WITH c AS (SELECT pos, b, family & 1 AS label, count(*) AS n FROM {cell} GROUP BY 1, 2, 3), k AS (SELECT pos, mask, sum(CASE WHEN bit_count(b & mask) % 2 = label THEN n ELSE 0 END) AS s, sum(n) AS rows FROM c, (SELECT unnest(range(1, 256)) AS mask) GROUP BY 1, 2),
a AS (SELECT *, greatest(s, rows - s) / rows AS acc FROM k) SELECT pos, mask, CAST(s AS BIGINT) AS same, CAST(rows AS BIGINT) AS rows, R6(acc) AS accuracy, s * 2 < rows AS inverted FROM a QUALIFY row_number() OVER (PARTITION BY pos ORDER BY acc DESC, mask) = 1""")
def xor_bit_models(x):
    c = x.cell.groupBy("pos", "b", F.col("family").bitwiseAND(F.lit(1)).alias("label")).agg(F.count("*").alias("n"))
    return o.best(sw.mask_models(c, ["pos"], "b", "label", "n"), ["pos"], [F.desc("accuracy"), F.asc("mask")])


@query("J13_mask_classifier", """WITH c AS (SELECT pos, b, count(*) FILTER (family = 3) AS p, count(*) FILTER (family <> 3) AS q FROM {cell} GROUP BY 1, 2), k AS (SELECT pos, mask, b & mask AS code, sum(p) AS p, sum(q) AS q FROM c, (SELECT unnest(range(1, 256)) AS mask) GROUP BY 1, 2, 3),
g AS (SELECT pos, mask, count(*) FILTER (p > 0) AS accepted, CAST(coalesce(sum(q) FILTER (p > 0), 0) AS BIGINT) AS false_positives, CAST(sum(p) AS BIGINT) AS positives FROM k GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY pos ORDER BY false_positives, accepted, mask) = 1""")
def mask_classifier(x):
    """255 masks for every byte position."""
    pos = F.col("family") == 3
    c = x.cell.groupBy("pos", "b").agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"))
    return sw.mask_classifier(c, ["pos"], "b", "p", "q")


@query("J14_truth_table_coverage", """WITH o AS (SELECT b, count(*) AS n, count(DISTINCT family) AS labels FROM {cell} GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'missing' WHEN labels > 1 THEN 'conflicting' ELSE 'observed' END AS status, count(*) AS codes, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT unnest(range(256)) AS b) LEFT JOIN o USING (b) GROUP BY 1""")
def truth_table_coverage(x):
    seen = x.cell.groupBy("b").agg(F.count("*").alias("n"), F.count_distinct("family").alias("labels"))
    codes = x.spark.range(256).withColumnRenamed("id", "b")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("labels") > 1, "conflicting").otherwise("observed")
    return codes.join(seen, "b", "left").groupBy(status.alias("status")).agg(F.count("*").alias("codes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


SUB = """WITH c AS (SELECT pos, b AS raw, rec_id, CASE WHEN pos = 7 AND rec_id > 300 THEN b // 2 ELSE xor(b, 90) END AS plain FROM {cell}), tr AS (SELECT * FROM c WHERE rec_id < REC_CUT), te AS (SELECT * FROM c WHERE rec_id >= REC_CUT)""".replace("REC_CUT", REC_CUT)


def _sub(x):
    b = F.col("b")
    plain = F.when((F.col("pos") == 7) & (F.col("rec_id") > 300), F.floor(b / 2)).otherwise(b.bitwiseXOR(F.lit(90)))
    c = x.cell.select("pos", b.alias("raw"), "rec_id", plain.alias("plain"), F.lit(0).alias("g"))
    parted = with_part(c, x.rec, "rec_id")
    return parted.filter("early").drop("early"), parted.filter("NOT early").drop("early")


@query("J15_substitution_learning", SUB + """, n AS (SELECT raw, plain, count(*) AS n FROM tr GROUP BY 1, 2), st AS (SELECT raw, min(plain) AS p FROM n GROUP BY 1 HAVING count(*) = 1), nz AS (SELECT raw, plain AS p FROM n QUALIFY row_number() OVER (PARTITION BY raw ORDER BY n DESC, CAST(plain AS VARCHAR)) = 1)
SELECT 'strict' AS mode, count(*) AS rows, count(*) FILTER (p = plain) AS exact, count(*) FILTER (p <> plain) AS wrong, count(*) FILTER (p IS NULL) AS unavailable FROM te LEFT JOIN st USING (raw) UNION ALL
SELECT 'noisy', count(*), count(*) FILTER (p = plain), count(*) FILTER (p <> plain), count(*) FILTER (p IS NULL) FROM te LEFT JOIN nz USING (raw)""")
def substitution_learning(x):
    tr, te = _sub(x)
    out = None
    for name, strict in (("strict", True), ("noisy", False)):
        part = sw.score_lookup(te, sw.learn_lookup(tr, ["g"], "raw", "plain", strict), ["g"], "raw", "plain").withColumn("mode", F.lit(name)).drop("g")
        out = part if out is None else out.unionByName(part)
    return out


@query("J16_lane_substitution_ranking", SUB + """, st AS (SELECT pos, raw, min(plain) AS p FROM tr GROUP BY 1, 2 HAVING min(plain) = max(plain)), g AS (SELECT pos, count(*) AS rows, count(*) FILTER (p = plain) AS exact, count(*) FILTER (p <> plain) AS wrong FROM te LEFT JOIN st USING (pos, raw) GROUP BY 1)
SELECT pos, rows, exact, wrong, row_number() OVER (ORDER BY exact DESC, wrong, pos) AS rank FROM g QUALIFY rank <= 20""")
def lane_substitution_ranking(x):
    tr, te = _sub(x)
    g = sw.score_lookup(te, sw.learn_lookup(tr, ["pos"], "raw", "plain"), ["pos"], "raw", "plain").withColumn("g", F.lit(0))
    return o.top_k(g, ["g"], [F.desc("exact"), F.asc("wrong"), F.asc("pos")], 20, "rank").select("pos", "rows", "exact", "wrong", "rank")


PROJ = """WITH p AS (SELECT spec, rec_id, family, v, CAST(floor(arr[6] / 7.0 + 0.3) AS BIGINT) AS label FROM (SELECT family, rec_id, arr, unnest(range(64)) AS spec, unnest(arr) / 7.0 AS v FROM {rec}))"""


def _proj(x):
    label = F.floor(F.element_at("arr", 6) / 7.0 + 0.3).cast("long")
    return x.rec.select("family", "rec_id", label.alias("label"), F.posexplode("arr").alias("spec", "b")).withColumn("v", F.col("b") / 7.0)


@query("J17_exact_projection_search", PROJ + " SELECT spec, count(*) AS rows, count(*) FILTER (floor(v + 0.3) = label) AS exact, bool_and(floor(v + 0.3) = label) AS promoted FROM p GROUP BY 1 HAVING count(*) FILTER (floor(v + 0.3) = label) > 0")
def exact_projection_search(x):
    hit = F.floor(F.col("v") + 0.3) == F.col("label")
    return _proj(x).groupBy("spec").agg(F.count("*").alias("rows"), F.count_if(hit).alias("exact"), F.bool_and(hit).alias("promoted")).filter("exact > 0")


@query("J18_projection_epsilon", PROJ + " SELECT spec, count(*) AS rows, R6(max(label - v)) AS lower, R6(min(label + 1 - v)) AS upper, max(label - v) < min(label + 1 - v) AS feasible FROM p GROUP BY 1")
def projection_epsilon(x):
    return sw.projection_interval(_proj(x), ["spec"], "v", "label")


@query("J49_row_projection_monotone", PROJ + """, q AS (SELECT *, floor(v + 0.3) AS pr, lag(floor(v + 0.3)) OVER (PARTITION BY family, spec ORDER BY rec_id) AS pp FROM p) SELECT spec, family, count(*) AS rows, R6(max(label - v)) AS lower, R6(min(label + 1 - v)) AS upper, count(*) FILTER (pr < pp) AS falls FROM q GROUP BY 1, 2""")
def row_projection_monotone(x):
    """Projection interval per track and falls of the projected series."""
    p = _proj(x).withColumn("pr", F.floor(F.col("v") + 0.3))
    p = o.scan(p, ["family", "spec"], ["rec_id"], o.time_block("rec_id", 1 << 14), {"pp": o.prev("pr")})
    return p.groupBy("spec", "family").agg(
        F.count("*").alias("rows"), F.max(F.col("label") - F.col("v")).alias("lower"), F.min(F.col("label") + 1 - F.col("v")).alias("upper"), F.count_if(F.col("pr") < F.col("pp")).alias("falls")
    )


@query("J19_residual_correction", """WITH r AS (SELECT rec_id, arr, arr[4] - arr[12] AS residual FROM {rec}), v AS (SELECT rec_id, residual, unnest(range(64)) AS spec, unnest(arr) AS v FROM r)
SELECT spec, sgn, count(*) FILTER (sgn * v + 127 = residual + 127 + CASE WHEN sgn > 0 THEN 127 ELSE -127 END) AS exact, count(*) AS rows FROM v, (SELECT unnest([1, -1]) AS sgn) GROUP BY 1, 2""")
def residual_correction(x):
    """Which signed field explains the residual up to a constant."""
    r = x.rec.select((F.element_at("arr", 4) - F.element_at("arr", 12)).alias("residual"), F.posexplode("arr").alias("spec", "v"))
    r = r.withColumn("sgn", F.explode(F.array(F.lit(1), F.lit(-1))))
    hit = F.col("sgn") * F.col("v") == F.col("residual") + F.when(F.col("sgn") > 0, 127).otherwise(-127)
    return r.groupBy("spec", "sgn").agg(F.count_if(hit).alias("exact"), F.count("*").alias("rows"))


@query("J20_subset_mask_classifier", """WITH h AS (SELECT match_id, bit_or(1 << CASE entity || CAST(value > 120 AS VARCHAR) WHEN 'clicktrue' THEN 0 WHEN 'errortrue' THEN 1 WHEN 'purchasetrue' THEN 2 WHEN 'signuptrue' THEN 3 WHEN 'viewtrue' THEN 4 ELSE 5 END) AS mask, max(value) > 250 AS label FROM {ev} GROUP BY 1),
c AS (SELECT mask, label, count(*) AS n FROM h GROUP BY 1, 2) SELECT m, CAST(sum(CASE WHEN mask & m = m AND label THEN n ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN mask & m = m AND NOT label THEN n ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN label THEN n ELSE 0 END) AS BIGINT) AS positives, CAST(bit_count(m) AS BIGINT) AS size FROM c, (SELECT unnest(range(1, 32)) AS m) GROUP BY 1""")
def subset_mask_classifier(x):
    names = ["click", "error", "purchase", "signup", "view"]
    bit = F.lit(32)
    for i, name in enumerate(names):
        bit = F.when((F.col("entity") == name) & (F.col("value") > 120), F.lit(1 << i)).otherwise(bit)
    h = x.ev.groupBy("match_id").agg(F.bit_or(bit.cast("long")).alias("mask"), (F.max("value") > 250).alias("label"))
    return sw.subset_masks(h, "mask", "label", 5)


UNION_CTE = """WITH r AS (SELECT family, rec_id, arr, lag(arr) OVER (PARTITION BY family ORDER BY rec_id) AS p FROM {rec}), e AS (SELECT family, rec_id, unnest(range(1, 65)) AS off, unnest(arr) // 128 AS a, unnest(p) // 128 AS b FROM r WHERE p IS NOT NULL),
t AS (SELECT family, rec_id, bool_or(off IN (3, 6) AND a <> b) AS hit FROM e GROUP BY 1, 2), ch AS (SELECT e.family, e.rec_id, off, hit FROM e JOIN t USING (family, rec_id) WHERE a <> b), cl AS (SELECT off FROM ch GROUP BY 1 HAVING count(*) FILTER (NOT hit) = 0),
h AS (SELECT family, rec_id, off FROM ch SEMI JOIN cl USING (off) WHERE hit), tot AS (SELECT count(*) AS n FROM t WHERE hit)"""


def _changes(x):
    """Transitions of coarse records with their changed offsets; the label is a change at offset 3 or 6."""
    r = x.rec.select("family", "rec_id", F.transform("arr", lambda v: F.floor(v / 128)).alias("a"))
    r = o.scan(r, ["family"], ["rec_id"], o.time_block("rec_id", 1 << 14), {"p": o.prev("a")}).filter("p IS NOT NULL")
    changed = F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: F.element_at("a", i) != F.element_at("p", i))
    r = r.select("family", "rec_id", changed.alias("ch"))
    return r.withColumn("hit", F.array_contains("ch", 3) | F.array_contains("ch", 6))


@query("J21_change_marker_union", UNION_CTE + """, s AS (SELECT CAST(off AS VARCHAR) AS union_of, 1 AS size, count(*) AS covered FROM h GROUP BY off), d AS (SELECT CAST(x.off AS VARCHAR) || '+' || CAST(y.off AS VARCHAR) AS union_of, 2 AS size, (SELECT count(DISTINCT (family, rec_id)) FROM h WHERE h.off = x.off OR h.off = y.off) AS covered FROM cl x JOIN cl y ON x.off < y.off)
SELECT u.* FROM (SELECT * FROM s UNION ALL SELECT * FROM d) u, tot WHERE covered = n""")
def change_marker_union(x):
    _, patterns = sw.change_patterns(_changes(x), "ch", "hit")
    return sw.exact_unions(patterns)


@query("J21_offset_coverage", UNION_CTE + ' SELECT off AS "offset", count(*) FILTER (hit) AS covered, count(*) FILTER (NOT hit) AS false_positives FROM ch GROUP BY 1')
def offset_coverage(x):
    return sw.change_patterns(_changes(x), "ch", "hit")[0]


@query("J21_greedy_cover", "WITH RECURSIVE " + UNION_CTE[len("WITH "):] + """, p AS (SELECT pattern, count(*) AS n FROM (SELECT list(off ORDER BY off) AS pattern FROM h GROUP BY family, rec_id) GROUP BY 1),
w AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS off, CAST(NULL AS BIGINT) AS gain
 UNION ALL SELECT step + 1, list_append(taken, -best.off), -best.off, best.gain FROM (SELECT step, taken, max({'gain': gain, 'off': -off}) AS best
  FROM (SELECT step, taken, off, CAST(sum(n) AS BIGINT) AS gain FROM (SELECT w.step, w.taken, CAST(unnest(p.pattern) AS BIGINT) AS off, p.n FROM w, p WHERE NOT list_has_any(p.pattern, w.taken)) GROUP BY step, taken, off) GROUP BY step, taken))
SELECT step, off AS "offset", gain FROM w WHERE step > 0""")
def greedy_cover(x):
    return sw.greedy_cover(sw.change_patterns(_changes(x), "ch", "hit")[1])


@query("J25_threshold_sweep", """WITH th AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS threshold) SELECT R6(threshold) AS threshold, count(*) FILTER (score >= threshold AND correlation >= 0.5) AS passes, count(*) FILTER (score >= threshold AND nrmse >= 0.5) AS control_passes, count(*) AS rows FROM {cm}, th GROUP BY threshold""")
def threshold_sweep(x):
    """One scored table against every threshold, real and control evidence side by side."""
    base = x.cm.groupBy(F.col("score").alias("sc")).agg(F.count_if(F.col("correlation") >= 0.5).alias("p"), F.count_if(F.col("nrmse") >= 0.5).alias("c"), F.count("*").alias("n"))
    base = base.withColumn("threshold", F.explode(F.array(*[F.lit(v) for v in (0.3, 0.5, 0.7, 0.9)])))
    ok = F.col("sc") >= F.col("threshold")
    return base.groupBy("threshold").agg(
        F.sum(F.when(ok, F.col("p")).otherwise(0)).alias("passes"), F.sum(F.when(ok, F.col("c")).otherwise(0)).alias("control_passes"), F.sum("n").alias("rows")
    )


@query("J26_leave_one_out_linear", """WITH p AS (SELECT entity, match_id, rx AS x, ry AS y FROM {pair}), m AS (SELECT entity, match_id, count(*) AS n FROM p GROUP BY 1, 2), f AS (SELECT m.entity, m.match_id, any_value(m.n) AS n, regr_slope(p.y, p.x) AS a, regr_intercept(p.y, p.x) AS b FROM m JOIN p ON p.entity = m.entity AND p.match_id <> m.match_id GROUP BY 1, 2)
SELECT f.entity, f.match_id, any_value(n) AS n, R6(any_value(a)) AS slope, R6(any_value(b)) AS intercept, R6(sqrt(avg(power(y - (a * x + b), 2)))) AS rmse FROM f JOIN p ON p.entity = f.entity AND p.match_id = f.match_id GROUP BY 1, 2""")
def leave_one_out_linear(x):
    a, b = F.col("rx"), F.col("ry")
    per = x.pair.groupBy("entity", "match_id").agg(
        F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")
    )
    return sw.leave_one_out_fit(per, "match_id", ["entity"])


@query("J26_leave_one_out_lookup", """WITH c AS (SELECT pos, b // 8 AS key, family % 3 AS label, family AS mt FROM {cell}), o AS (SELECT pos, key, label, mt, count(*) AS n FROM c GROUP BY 1, 2, 3, 4),
t AS (SELECT a.pos, a.key, a.mt, a.label, any_value(a.n) AS n, count(DISTINCT z.label) AS k, min(z.label) AS p FROM o a LEFT JOIN o z ON z.pos = a.pos AND z.key = a.key AND z.mt <> a.mt GROUP BY 1, 2, 3, 4)
SELECT pos, mt, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN k = 1 AND p = label THEN n ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN k = 1 AND p <> label THEN n ELSE 0 END) AS BIGINT) AS wrong, CAST(sum(CASE WHEN k <> 1 THEN n ELSE 0 END) AS BIGINT) AS unavailable FROM t GROUP BY 1, 2""")
def leave_one_out_lookup(x):
    """Lookup learned without the match (here a family), for every field."""
    c, _, _ = _cells(x)
    c = c.withColumnRenamed("family", "mt")
    return sw.leave_one_out_lookup(c, "mt", ["pos"], "key", "label")


@query("J26_leave_one_out_template", """WITH g AS (SELECT match_id, t, string_agg(flag, '>' ORDER BY o1, o2, o3, o4) AS sig, CASE WHEN min(entity) = max(entity) THEN min(entity) ELSE 'FO' END AS label FROM {tx} GROUP BY 1, 2), o AS (SELECT sig, label, match_id, count(*) AS n FROM g GROUP BY 1, 2, 3),
t AS (SELECT a.sig, a.match_id, a.label, any_value(a.n) AS n, count(DISTINCT z.label) AS k, min(z.label) AS p FROM o a LEFT JOIN o z ON z.sig = a.sig AND z.match_id <> a.match_id GROUP BY 1, 2, 3)
SELECT match_id, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN k = 1 AND p = label THEN n ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN k = 1 AND p <> label THEN n ELSE 0 END) AS BIGINT) AS wrong, CAST(sum(CASE WHEN k <> 1 THEN n ELSE 0 END) AS BIGINT) AS unavailable FROM t GROUP BY 1""")
def leave_one_out_template(x):
    seq = F.array_sort(F.collect_list(F.struct("o1", "o2", "o3", "o4", "flag")))  # one same-time transaction
    g = x.tx.groupBy("match_id", "t").agg(F.array_join(F.transform(seq, lambda v: v["flag"]), ">").alias("sig"), F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    g = g.withColumn("label", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("FO")).withColumn("g", F.lit(0))
    return sw.leave_one_out_lookup(g, "match_id", ["g"], "sig", "label").drop("g")


@query("J27_companion_search", """WITH e AS (SELECT *, t // 86400000 AS day, entity || ':' || CAST(k // 25 AS VARCHAR) AS fam FROM {ev}), l AS (SELECT day, event_id, t, k // 50 AS label FROM e WHERE entity = 'purchase'),
p AS (SELECT l.event_id, label, b.fam, b.k // 10 AS key FROM l JOIN e b ON l.day = b.day AND b.entity <> 'purchase' AND abs(l.t - b.t) <= 7200000), n AS (SELECT count(*) AS n FROM l),
f AS (SELECT fam, count(DISTINCT event_id) AS covered FROM p GROUP BY 1), k AS (SELECT fam, key, count(*) AS n, min(label) = max(label) AS clean FROM p GROUP BY 1, 2)
SELECT fam, covered, covered >= 0.5 * (SELECT n FROM n) AS qualifies, (SELECT count(*) FROM k WHERE k.fam = f.fam AND clean) AS clean_keys FROM f""")
def companion_search(x):
    e = x.ev.withColumns({"day": tj.bucket("t", DAY_MS), "fam": F.concat_ws(":", "entity", F.floor(F.col("k") / 25).cast("string"))})
    lab = e.filter("entity = 'purchase'").select("day", "t", "event_id", F.floor(F.col("k") / 50).alias("label"))
    other = e.filter("entity <> 'purchase'").select("day", "t", "fam", F.floor(F.col("k") / 10).alias("key"))
    n = lab.agg(F.count("*").alias("n"))

    def near(*names: str):
        """The windows of a family (or family and key) with the labels inside them, without pairs."""
        return tj.interval_stats(tj.covered(other, ["day", *names], "t", 7_200_000), lab, ["day"], names, "t", "event_id", "label").filter("n > 0")

    f = near("fam").groupBy("fam").agg(F.sum("n").alias("covered"))
    clean = F.bool_and("same") & (F.min("first") == F.max("first"))
    k = near("fam", "key").groupBy("fam", "key").agg(clean.alias("clean")).groupBy("fam").agg(F.count_if("clean").alias("clean_keys"))
    out = f.join(k, "fam").crossJoin(F.broadcast(n))  # one-row side
    return out.select("fam", "covered", (F.col("covered") >= 0.5 * F.col("n")).alias("qualifies"), "clean_keys")


@query("J44_float_sweep", LABS + """, sp AS (SELECT spec, CASE WHEN rec_id < """ + REC_CUT + """ THEN 'discovery' ELSE 'holdout' END AS part, v * 1.0 AS v, y2 FROM (SELECT rec_id, y2, unnest(range(64)) AS spec, unnest(arr) AS v FROM lb)),
g AS (SELECT spec, part, count(*) AS n, sqrt(greatest(0, var_pop(y2) - power(covar_pop(y2, v), 2) / var_pop(v))) / greatest(stddev_pop(y2), 1) AS e FROM sp GROUP BY 1, 2) SELECT spec, R6(max(e) FILTER (part = 'discovery')) AS discovery_nrmse, R6(max(e) FILTER (part = 'holdout')) AS holdout_nrmse, bool_and(e <= 0.9) AS passes FROM g GROUP BY 1""")
def float_sweep(x):
    """Normalised error per field in discovery and hold-out; promoted only when both pass."""
    lab = with_part(_lab(x), x.rec, "rec_id").withColumn("part", F.when(F.col("early"), "discovery").otherwise("holdout"))
    sums = sw.moments(lab, ["part"], "arr", ["y2"], _fields()[:64], CENTER)
    c = F.col
    xx, yy, xy = c("sxx") - c("sx") * c("sx") / c("n"), c("syy") - c("sy") * c("sy") / c("n"), c("sxy") - c("sx") * c("sy") / c("n")
    e = F.sqrt(F.greatest(F.lit(0.0), yy - xy * xy / xx) / c("n")) / F.greatest(F.sqrt(yy / c("n")), F.lit(1.0))
    g = sums.withColumn("e", e)
    return g.groupBy("spec").agg(
        F.max(F.when(c("part") == "discovery", c("e"))).alias("discovery_nrmse"), F.max(F.when(c("part") == "holdout", c("e"))).alias("holdout_nrmse"), F.bool_and(c("e") <= 0.9).alias("passes")
    )


@query("J45_width_sweep", LABS + """, sp AS (SELECT unnest(range(64)) AS spec, unnest(arr) AS v, y2 FROM lb UNION ALL SELECT 100 + i, arr[i + 1] + 256 * arr[i + 2], y2 FROM lb, (SELECT unnest(range(63)) AS i))
SELECT spec, count(*) FILTER (v = y2) AS exact, count(*) FILTER (floor(v) = floor(y2)) AS floor_hits, count(*) FILTER (floor(v + 0.5) = floor(y2 + 0.5)) AS round_hits, R6(avg(abs(v - y2))) AS mae FROM sp GROUP BY 1""")
def width_sweep(x):
    sums = sw.moments(_lab(x), [], "arr", ["y2"], _fields()[:127], CENTER)
    return sums.select("spec", *[F.col(c).cast("long").alias(c) for c in ("exact", "floor_hits", "round_hits")], (F.col("abs_err") / F.col("n")).alias("mae"))


@query("J46_derived_differences", """WITH r AS (SELECT arr, arr[20] / 4.0 AS a, arr[33] / 4.0 AS b FROM {rec}), t AS (SELECT *, CAST(floor(a - b) AS BIGINT) AS target FROM r), v AS (SELECT i, arr[i + 1] / 4.0 AS x, b, target FROM t, (SELECT unnest(range(64)) AS i))
SELECT i AS spec, count(*) FILTER (trunc(x - b) = target) AS truncated_difference, count(*) FILTER (trunc(x) - trunc(b) = target) AS difference_of_truncated, count(*) FILTER (floor(x - b + 0.5) = target) AS rounded, count(*) FILTER (floor(x - b) = target) AS floored FROM v GROUP BY 1""")
def derived_differences(x):
    """Hypotheses about how a field minus another one was projected."""
    a, b = F.element_at("arr", 20) / 4.0, F.element_at("arr", 33) / 4.0
    r = x.rec.select(b.alias("b"), F.floor(a - b).alias("target"), F.posexplode("arr").alias("spec", "v")).withColumn("x", F.col("v") / 4.0)
    d = F.col("x") - F.col("b")

    def trunc(c):
        return c.cast("long")

    t = F.col("target")
    return r.groupBy("spec").agg(
        F.count_if(trunc(d) == t).alias("truncated_difference"), F.count_if(trunc(F.col("x")) - trunc(F.col("b")) == t).alias("difference_of_truncated"),
        F.count_if(F.floor(d + 0.5) == t).alias("rounded"), F.count_if(F.floor(d) == t).alias("floored"),
    )


@query("J47_proved_templates", """WITH g AS (SELECT match_id, t, string_agg(flag, '>' ORDER BY o1, o2, o3, o4) AS sig, CASE WHEN min(entity) = max(entity) THEN min(entity) ELSE 'FO' END AS label, max(tax) <= 7 AS proof FROM {tx} GROUP BY 1, 2),
tp AS (SELECT sig, min(label) AS label, count(*) AS support FROM g GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT label) = 1 AND bool_and(proof)) SELECT sig, label, support FROM tp""")
def proved_templates(x):
    seq = F.array_sort(F.collect_list(F.struct("o1", "o2", "o3", "o4", "flag")))
    g = x.tx.groupBy("match_id", "t").agg(F.array_join(F.transform(seq, lambda v: v["flag"]), ">").alias("sig"), F.min("entity").alias("lo"), F.max("entity").alias("hi"), (F.max("tax") <= 7).alias("proof"))
    g = g.withColumn("label", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("FO"))
    tp = g.groupBy("sig").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.count("*").alias("support"), F.bool_and("proof").alias("proof"))
    return tp.filter("support >= 2 AND label = other AND proof").select("sig", "label", "support")


@query("J47_template_scores", """WITH g AS (SELECT match_id, t, string_agg(flag || CAST(item_id AS VARCHAR), '>' ORDER BY o1, o2, o3, o4) AS sig, CASE WHEN min(entity) = max(entity) THEN min(entity) ELSE 'FO' END AS label, max(tax) <= 7 AS proof, count(*) AS n FROM {tx} GROUP BY 1, 2),
tp AS (SELECT sig, min(label) AS pl FROM g WHERE match_id < MATCH_CUT GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT label) = 1 AND bool_and(proof)), seen AS (SELECT DISTINCT sig, true AS known FROM g WHERE match_id < MATCH_CUT)
SELECT CASE WHEN match_id < MATCH_CUT THEN 'discovery' ELSE 'holdout' END AS part, label, count(*) FILTER (pl = label) AS group_tp, count(*) FILTER (pl <> label) AS group_fp, count(*) FILTER (pl IS NULL) AS group_fn, CAST(coalesce(sum(n) FILTER (pl = label), 0) AS BIGINT) AS row_tp, CAST(coalesce(sum(n) FILTER (pl <> label), 0) AS BIGINT) AS row_fp, CAST(coalesce(sum(n) FILTER (pl IS NULL), 0) AS BIGINT) AS row_fn, count(*) FILTER (known IS NULL) AS unseen FROM g LEFT JOIN tp USING (sig) LEFT JOIN seen USING (sig) GROUP BY 1, 2""".replace("MATCH_CUT", MATCH_CUT))
def template_scores(x):
    """Proved discovery templates on both partitions: group and row outcomes, unseen signatures."""
    seq = F.array_sort(F.collect_list(F.struct("o1", "o2", "o3", "o4", "flag", "item_id")))  # one same-time transaction
    sig = F.array_join(F.transform(seq, lambda v: F.concat(v["flag"], v["item_id"].cast("string"))), ">")
    g = x.tx.groupBy("match_id", "t").agg(sig.alias("sig"), F.min("entity").alias("lo"), F.max("entity").alias("hi"), (F.max("tax") <= 7).alias("proof"), F.count("*").alias("n"))
    g = g.withColumn("label", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("FO"))
    g = with_part(g, x.tx, "match_id")
    tp = g.filter("early").groupBy("sig").agg(F.min("label").alias("pl"), F.max("label").alias("other"), F.count("*").alias("support"), F.bool_and("proof").alias("ok"))
    fit = tp.withColumn("pl", F.when((F.col("support") >= 2) & (F.col("pl") == F.col("other")) & F.col("ok"), F.col("pl"))).select("sig", "pl", F.lit(True).alias("known"))
    out = g.join(fit, "sig", "left")
    hit, miss, none = F.col("pl") == F.col("label"), F.col("pl") != F.col("label"), F.col("pl").isNull()
    part = F.when(F.col("early"), "discovery").otherwise("holdout")
    zero = F.lit(0)
    return out.groupBy(part.alias("part"), "label").agg(
        *[F.count_if(c).alias(f"group_{k}") for k, c in (("tp", hit), ("fp", miss), ("fn", none))],
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), zero).alias(f"row_{k}") for k, c in (("tp", hit), ("fp", miss), ("fn", none))],
        F.count_if(F.col("known").isNull()).alias("unseen"),
    )


@query("J48_payload_linkage", """WITH r AS (SELECT family, rec_id, arr, lead(arr) OVER (PARTITION BY family ORDER BY rec_id) AS nx FROM {rec}), v AS (SELECT i, j, arr[i + 1] // 64 AS a, nx[j + 1] // 64 AS b FROM r, (SELECT unnest([0, 16, 32, 48]) AS i), (SELECT unnest(range(64)) AS j) WHERE nx IS NOT NULL),
n AS (SELECT i, j, a, b, count(*) AS n FROM v GROUP BY 1, 2, 3, 4), f AS (SELECT i, j, sum(m) AS f, sum(s) AS rows FROM (SELECT i, j, a, max(n) AS m, sum(n) AS s FROM n GROUP BY 1, 2, 3) GROUP BY 1, 2), b AS (SELECT i, j, sum(m) AS r FROM (SELECT i, j, b, max(n) AS m FROM n GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT i, j, CAST(rows AS BIGINT) AS rows, CAST(least(f, r) AS BIGINT) AS support, R6(least(f, r) / rows) AS rate FROM f JOIN b USING (i, j)""")
def payload_linkage(x):
    """Majority mapping between four key fields of a record and every field of its successor."""
    r = o.scan(x.rec, ["family"], ["rec_id"], o.time_block("rec_id", 1 << 14), {"nx": o.following("arr")}).filter("nx IS NOT NULL")
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.floor(F.element_at("arr", i + 1) / 64).alias("a")) for i in (0, 16, 32, 48)])
    v = r.select("nx", F.explode(keys).alias("k")).select("k.i", "k.a", F.posexplode("nx").alias("j", "b"))
    v = v.select("i", "a", F.col("j").cast("long").alias("j"), F.floor(F.col("b") / 64).alias("b"))
    return sr.bidirectional_support(v, ["i", "j"], "a", "b").drop("left_values", "right_values")


@query("C20_field_pair_join", """WITH r AS (SELECT family, a, b, count(*) AS n, corr(arr[a + 1]::DOUBLE, arr[b + 1]::DOUBLE) AS r FROM {rec}, (SELECT unnest(range(64)) AS a), (SELECT unnest(range(64)) AS b) WHERE a < b GROUP BY 1, 2, 3) SELECT family, a, b, n, R6(r) AS correlation FROM r""")
def field_pair_join(x):
    return sw.pair_moments(x.rec, ["family"], "arr")
