"""Scalar functions and projections over the stand-in views."""

from pyspark.sql import functions as F

from eventloom.functions import binary as bn
from eventloom.functions import labels as lb
from eventloom.functions import stats as s
from eventloom.operators import ordered as o
from eventloom.operators import rollups as r
from eventloom.plans.registry import query
from eventloom.plans.standins import DAY_MS


def hx(off, width, little=True):
    """SQL for an unsigned read from the hex text of a payload."""
    parts = [f"substr(hx, {2 * (off + i) + 1}, 2)" for i in range(width)]
    return "CAST('0x' || " + " || ".join(reversed(parts) if little else parts) + " AS BIGINT)"


P = ["match_id", "block_index"]


@query("H1_integer_reads", f"""SELECT match_id, block_index, {hx(0, 1)} AS u8, {hx(2, 2)} AS u16le, {hx(2, 2, False)} AS u16be, {hx(1, 3)} AS u24le, {hx(4, 4)} AS u32le, CASE WHEN {hx(5, 2)} >= 32768 THEN {hx(5, 2)} - 65536 ELSE {hx(5, 2)} END AS i16le,
 {hx(0, 1)} + 256 * {hx(2, 1)} + 65536 * {hx(4, 1)} AS strided FROM {{pk}}""")
def integer_reads(x):
    p = "payload"
    return x.pk.select(
        *P, bn.u8(p, 0).alias("u8"), bn.read_uint(p, 2, 2).alias("u16le"), bn.read_uint(p, 2, 2, little=False).alias("u16be"), bn.read_uint(p, 1, 3).alias("u24le"),
        bn.read_uint(p, 4, 4).alias("u32le"), bn.read_int(p, 5, 2).alias("i16le"), bn.read_uint(p, 0, 3, stride=2).alias("strided"),
    )


@query("H2_float32_reinterpret", f"""WITH r AS (SELECT match_id, block_index, {hx(0, 4)} AS raw FROM {{pk}}), d AS (SELECT *, CASE WHEN raw >= 2147483648 THEN -1 ELSE 1 END AS sg, (raw >> 23) & 255 AS ex, raw & 8388607 AS mt FROM r)
SELECT match_id, block_index, R6(CASE WHEN ex = 0 THEN sg * power(2.0, -149) * mt ELSE sg * power(2.0, ex - 150) * (8388608 + mt) END / power(2.0, 100)) AS scaled FROM d WHERE ex < 255""")
def float32_reinterpret(x):
    raw = bn.read_uint("payload", 0, 4)
    out = x.pk.select(*P, raw.alias("raw"), bn.float32_from_bits(raw).alias("f"))
    return out.filter(F.shiftright("raw", 23).bitwiseAND(F.lit(255)) < 255).select(*P, (F.col("f") / 2.0**100).alias("scaled"))


@query("H3_lane_decodes", f"""WITH r AS (SELECT match_id, block_index, {hx(4, 4)} AS raw FROM {{pk}}) SELECT match_id, block_index, decode, R6(CASE WHEN decode <> 'f32' OR abs(decoded) < 1e9 THEN decoded END) AS decoded,
R6(CASE WHEN decode = 'f32' AND decoded <> 0 AND abs(decoded) < 1e39 THEN log2(abs(decoded)) END) AS magnitude FROM (SELECT match_id, block_index, {bn.lane_decodes_sql("raw")} FROM r)""")
def lane_decodes(x):
    """Every reading of a lane; six digits cannot show a float of 1e9 and more, so floats come with their binary logarithm too."""
    d = x.pk.select(*P, F.explode(bn.lane_decodes(bn.read_uint("payload", 4, 4))).alias("d")).select(*P, "d.*")
    real, size = F.col("decode") == "f32", F.abs("decoded")
    return d.select(
        *P, "decode", F.when(~real | (size < 1e9), F.col("decoded")).alias("decoded"), F.when(real & (F.col("decoded") != 0) & (size < 1e39), F.log2(size)).alias("magnitude")
    )


@query("H4_bit_slices", f"""SELECT match_id, block_index, ({hx(0, 2)} >> 3) & 1023 AS little10, ({hx(0, 2, False)} >> 3) & 1023 AS big10, xor({hx(0, 1)}, 90) AS xored, bit_count({hx(0, 1)} & 27) % 2 AS parity,
 (({hx(0, 1)} & 1) << 7) | (({hx(0, 1)} & 2) << 5) | (({hx(0, 1)} & 4) << 3) | (({hx(0, 1)} & 8) << 1) | (({hx(0, 1)} & 16) >> 1) | (({hx(0, 1)} & 32) >> 3) | (({hx(0, 1)} & 64) >> 5) | (({hx(0, 1)} & 128) >> 7) AS reversed FROM {{pk}}""")
def bit_slices(x):
    p, b = "payload", bn.u8("payload", 0)
    return x.pk.select(
        *P, bn.payload_bits(p, 3, 10).alias("little10"), bn.payload_bits(p, 3, 10, little=False).alias("big10"), b.bitwiseXOR(F.lit(90)).alias("xored"),
        bn.parity(b, 27).alias("parity"), bn.reverse_bits(b, 8).alias("reversed"),
    )


@query("H5_token_windows", f"""WITH r AS (SELECT match_id, block_index, {hx(0, 4)} AS raw FROM {{pk}}), w AS (SELECT match_id, block_index, raw, unnest([0, 8, 16, 24, 0, 16, 0, 4, 8, 12, 16, 20]) AS "start", unnest([8, 8, 8, 8, 16, 16, 12, 12, 12, 12, 12, 12]) AS bits FROM r)
SELECT "start", bits, (raw >> "start") & ((1 << bits) - 1) AS slice, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def token_windows(x):
    w = x.pk.select(F.explode(bn.token_windows(bn.read_uint("payload", 0, 4))).alias("w")).select("w.*")
    return w.groupBy("start", "bits", "slice").agg(F.count("*").alias("n"))


@query("H6_token_class", """SELECT CASE WHEN b = 0 THEN 'zero' WHEN b IN (100, 200) THEN 'team' WHEN b <= 10 THEN 'ordinal' WHEN b < 110 THEN 'row_index' WHEN b <= 1000 THEN 'medium' ELSE 'high' END AS class, count(*) AS n FROM {cell} GROUP BY 1""")
def token_class(x):
    from eventloom.operators.payload import classify_token

    return x.cell.groupBy(classify_token("b", F.lit(110)).alias("class")).agg(F.count("*").alias("n"))


@query("H6_handle_score", """WITH k AS (SELECT b, count(*) AS n, count(DISTINCT rec_id) AS mt, count(DISTINCT family) AS fm, count(DISTINCT pos // 8) AS rw FROM {cell} GROUP BY 1) SELECT b, R6(CASE WHEN b <= 10 OR mt < 2 OR fm < 2 OR fm > 10 OR rw > 400 OR n > 2000 THEN 0 ELSE mt * 10 + fm * 5 + least(rw, 100) * 0.25 + 15 + CASE WHEN b < 110 THEN 6 ELSE 0 END - CASE WHEN b IN (100, 200) THEN 20 ELSE 0 END END) AS score FROM k""")
def handle_score(x):
    from eventloom.operators.payload import handle_score as score

    k = x.cell.groupBy("b").agg(
        F.count("*").alias("n"), F.count_distinct("rec_id").alias("mt"), F.count_distinct("family").alias("fm"), F.count_distinct(F.floor(F.col("pos") / 8)).alias("rw")
    )
    k = k.withColumns({"kind": F.lit("u32"), "hi": F.lit(0), "row": (F.col("b") < 110).cast("int"), "team": F.col("b").isin(100, 200).cast("int"), "ord": F.lit(0)})
    return k.select("b", score("mt", "fm", "rw", "n", "b", "kind", "hi", "row", "team", "ord").alias("score"))


DIST = """WITH r AS (SELECT family, rec_id, arr, lead(arr) OVER (PARTITION BY family ORDER BY rec_id) AS nx FROM {rec}), e AS (SELECT rec_id, unnest(range(64)) AS p, unnest(arr) AS a, unnest(nx) AS b FROM r WHERE nx IS NOT NULL)"""


def _pairs(x):
    return o.scan(x.rec, ["family"], ["rec_id"], o.time_block("rec_id", 1 << 14), {"nx": o.following("arr")}).filter("nx IS NOT NULL")


@query("H7_byte_distances", DIST + " SELECT rec_id, count(*) FILTER (a <> b) AS hamming, CAST(sum(abs(a - b)) AS BIGINT) AS l1, count(*) FILTER (a <> b) AS changed FROM e GROUP BY 1")
def byte_distances(x):
    return _pairs(x).select("rec_id", bn.hamming("arr", "nx").alias("hamming"), bn.l1_distance("arr", "nx").alias("l1"), bn.changed_bytes("arr", "nx").alias("changed"))


@query("H8_change_mask", DIST + " SELECT rec_id, CAST(sum(CASE WHEN a // 16 <> b // 16 AND p // 4 = 3 THEN 1 << (p % 4) ELSE 0 END) AS BIGINT) AS mask FROM e GROUP BY 1")
def change_mask(x):
    coarse = {c: F.transform(c, lambda v: F.floor(v / 16)) for c in ("arr", "nx")}
    return _pairs(x).withColumns(coarse).select("rec_id", bn.change_mask("arr", "nx", 3).alias("mask"))


@query("H9_normalisers", """WITH c AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey // 100 AS VARCHAR) || '.7' AS version, CASE c_mktsegment WHEN 'BUILDING' THEN ' support' WHEN 'MACHINERY' THEN 'Mid' WHEN 'FURNITURE' THEN 'jg ' WHEN 'HOUSEHOLD' THEN '' ELSE c_mktsegment END AS ps, CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS ms, c_name FROM customer)
SELECT id, CAST(split_part(version, '.', 1) AS VARCHAR) || '.' || split_part(version, '.', 2) AS version_group, CASE WHEN ps = ' support' THEN 'UTILITY' WHEN ps = 'Mid' THEN 'MIDDLE' WHEN ps = 'jg ' THEN 'JUNGLE' WHEN ps = '' THEN 'UNKNOWN' ELSE ps END AS position,
 CASE WHEN ps = 'jg ' THEN 1 WHEN ps = 'Mid' THEN 2 WHEN ps = ' support' THEN 4 ELSE 5 END AS role_rank, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS game_id, CAST(ms // 60000 AS VARCHAR) || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') AS clock FROM c""")
def normalisers(x):
    seg = F.col("c_mktsegment")
    c = x.customer.select(
        F.col("c_custkey").alias("id"), F.concat_ws(".", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 100).cast("string"), F.lit("7")).alias("version"),
        F.when(seg == "BUILDING", " support").when(seg == "MACHINERY", "Mid").when(seg == "FURNITURE", "jg ").when(seg == "HOUSEHOLD", "").otherwise(seg).alias("ps"),
        F.floor(F.abs("c_acctbal") * 100).alias("ms"), "c_name",
    )
    pos = lb.team_position("ps")
    return c.select("id", lb.version_group("version").alias("version_group"), pos.alias("position"), lb.role_rank(pos).alias("role_rank"), lb.trailing_id("c_name").alias("game_id"), lb.clock("ms").alias("clock"))


XP = (0, 280, 660, 1140, 1720, 2400, 3180, 4060, 5040, 6120)  # fixed values: thresholds


@query("H10_level_from_xp", "SELECT o_orderkey, CAST(least((CASE WHEN x >= 0 THEN 1 ELSE 0 END + CASE WHEN x >= 280 THEN 1 ELSE 0 END + CASE WHEN x >= 660 THEN 1 ELSE 0 END + CASE WHEN x >= 1140 THEN 1 ELSE 0 END + CASE WHEN x >= 1720 THEN 1 ELSE 0 END + CASE WHEN x >= 2400 THEN 1 ELSE 0 END + CASE WHEN x >= 3180 THEN 1 ELSE 0 END + CASE WHEN x >= 4060 THEN 1 ELSE 0 END + CASE WHEN x >= 5040 THEN 1 ELSE 0 END + CASE WHEN x >= 6120 THEN 1 ELSE 0 END), 8) AS BIGINT) AS level FROM (SELECT o_orderkey, o_totalprice / 60 AS x FROM orders)")
def level_from_xp(x):
    return x.orders.select("o_orderkey", lb.level_from_thresholds(F.col("o_totalprice") / 60, XP, 8).alias("level"))


@query("H11_projection", "SELECT event_id, CAST(floor(value + 0.25) AS BIGINT) AS projected, CASE WHEN entity = 'error' THEN CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END ELSE CAST(floor(value + 0.25) AS BIGINT) END AS integer_field FROM {ev}")
def projection(x):
    return x.ev.select("event_id", lb.projected("value", 0.25).alias("projected"), lb.projected("value", 0.25, F.col("entity") == "error").alias("integer_field"))


@query("H12_geometry", "SELECT event_id, R6(1.5 * x + 20) AS ax, R6(CASE WHEN k >= 50 THEN 15000 - x ELSE x END) AS mx, R6(1 / (1 + sqrt(power(x - 7500, 2) + power(y - 7500, 2)) / 8000)) AS closeness, R6(least(5000, greatest(1000, x))) AS clamped FROM (SELECT t.*, e.k FROM {tgt} t JOIN {ev} e USING (event_id))")
def geometry(x):
    from eventloom.operators.assign import closeness, distance, mirrored

    g = x.tgt.join(x.ev.select("event_id", "k"), "event_id")
    mid = F.lit(7500.0)
    return g.select(
        "event_id", (1.5 * F.col("x") + 20).alias("ax"), mirrored(F.col("x"), F.col("k") >= 50).alias("mx"),
        closeness(distance(F.col("x"), F.col("y"), mid, mid), 8000.0).alias("closeness"), s.clamp("x", 1000, 5000).alias("clamped"),
    )


@query("H13_fingerprints", "SELECT match_id, block_index, substr(sha256(text), 1, 16) AS fingerprint FROM {pk}")
def fingerprints(x):
    return x.pk.select(*P, bn.fingerprint("payload").alias("fingerprint"))


@query("H13_fnv1a64", """SELECT n_nationkey, lpad(lower(hex(list_reduce([14695981039346656037::HUGEINT] || list_transform(range(1, length(n_name) + 1), lambda i: ascii(n_name[i])::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS fnv FROM nation""")
def fnv(x):
    return x.nation.select("n_nationkey", lb.fnv1a64("n_name").alias("fnv"))


@query("H14_fixed_hex", "SELECT p_partkey, '0x' || lpad(lower(hex(p_partkey)), 8, '0') AS hex FROM part")
def fixed_hex(x):
    return x.part.select("p_partkey", bn.fixed_hex("p_partkey", 8).alias("hex"))


@query("H15_item_class", "SELECT CASE WHEN p_partkey IS NULL THEN 'catalog-missing' WHEN p_size <= 5 THEN 'map-invalid' WHEN p_type = 'PROMO' THEN 'non-purchasable' WHEN p_retailprice <= 905 THEN 'system' ELSE 'real' END AS class, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 45) ON p_partkey = l_partkey GROUP BY 1")
def item_class(x):
    cat = x.part.filter("p_size < 45")
    j = x.lineitem.select("l_partkey").join(cat, F.col("l_partkey") == F.col("p_partkey"), "left")
    cls = lb.item_class(F.col("p_partkey").isNotNull(), F.col("p_size") > 5, F.col("p_type") != "PROMO", F.col("p_retailprice") - 905)
    return j.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query("H16_bucketers", "SELECT CASE WHEN overlap <= 5 THEN 'tiny' WHEN overlap <= 20 THEN 'short' WHEN overlap <= 40 THEN 'medium' ELSE 'long' END AS bucket, CAST(slot_index // 5 * 5 AS VARCHAR) || '-' || CAST(slot_index // 5 * 5 + 4 AS VARCHAR) AS band, count(*) AS n FROM {cm} GROUP BY 1, 2")
def bucketers(x):
    b = lb.steps("overlap", [(5, "tiny"), (20, "short"), (40, "medium")], "long")
    return x.cm.groupBy(b.alias("bucket"), lb.slot_band("slot_index").alias("band")).agg(F.count("*").alias("n"))


@query("H17_entity_key_split", "SELECT DISTINCT family_key, slot_index, participant_id AS x_offset, overlap AS y_offset, 'normal' AS mapping FROM {cm}")
def entity_key_split(x):
    key = F.concat_ws("|", "family_key", "slot_index", "participant_id", "overlap", F.lit("normal"))
    return x.cm.select(lb.entity_key_parts(key).alias("p")).select("p.*").distinct()


@query("H18_metric_fit", "SELECT entity, count(*) AS n, R6(avg(greatest(0, 1 - abs(value - k) / greatest(rel * k, low)))) AS fit FROM (SELECT *, CASE entity WHEN 'click' THEN 0.0 WHEN 'view' THEN 0.3 ELSE 0.35 END AS rel, CASE entity WHEN 'click' THEN 2 WHEN 'view' THEN 25 ELSE 100 END AS low FROM {ev}) GROUP BY 1")
def metric_fit(x):
    metric = F.when(F.col("entity") == "click", "level").when(F.col("entity") == "view", "minionsKilled").otherwise("other")
    return x.ev.groupBy("entity").agg(F.count("*").alias("n"), F.avg(lb.metric_fit(metric, "k", "value")).alias("fit"))


@query("B1_select_by_type", "SELECT packet_type, match_id, block_index, count(*) OVER (PARTITION BY packet_type) AS matching FROM {pk} WHERE packet_type IN ('user', 'system') QUALIFY row_number() OVER (PARTITION BY packet_type ORDER BY match_id, block_index) <= 20")
def select_by_type(x):
    """Selected types with the emission cap per type that the report asks for, and the full match count."""
    d = x.pk.filter(F.col("packet_type").isin("user", "system")).select("packet_type", "match_id", "block_index")
    n = d.groupBy("packet_type").agg(F.count("*").alias("matching"))
    return o.top_k(d, ["packet_type"], [F.asc("match_id"), F.asc("block_index")], 20).join(F.broadcast(n), "packet_type")


@query("B2_window_filter", f"SELECT event_id, match_id FROM {{ev}} WHERE t BETWEEN {5 * DAY_MS} AND {9 * DAY_MS} AND entity IN ('click', 'error') AND k >= 20")
def window_filter(x):
    from eventloom.operators.packets import window_filter as wf

    return wf(x.ev, "t", 5 * DAY_MS, 9 * DAY_MS, F.col("entity").isin("click", "error"), F.col("k") >= 20).select("event_id", "match_id")


@query("B3_family_keys", f"""SELECT match_id, block_index, CAST(len AS VARCHAR) || '-0x' || substr(hx, 1, 2) AS family_key, len AS parsed_length, {hx(0, 1)} AS parsed_byte FROM {{pk}}""")
def family_keys(x):
    k = x.pk.select(*P, lb.family_key("len", bn.u8("payload", 0)).alias("family_key"))
    p = lb.parse_family_key("family_key")
    return k.select(*P, "family_key", p["length"].alias("parsed_length"), p["first_byte"].alias("parsed_byte"))


@query("B4_length_constraint", "SELECT packet_type, count(*) AS n FROM {pk} WHERE CASE packet_type WHEN 'user' THEN len IN (100, 150, 200, 250) OR len BETWEEN 300 AND 9999 ELSE len BETWEEN 200 AND 1000 END GROUP BY 1")
def length_constraint(x):
    from eventloom.operators.packets import length_allowed

    user = F.col("packet_type") == "user"
    exact = F.when(user, F.array(*[F.lit(v) for v in (100, 150, 200, 250)])).otherwise(F.array().cast("array<int>"))
    ok = length_allowed("len", exact, F.when(user, 300).otherwise(200), F.when(user, 9999).otherwise(1000))
    return x.pk.filter(ok).groupBy("packet_type").agg(F.count("*").alias("n"))


GATE = "concat_ws(',', CASE WHEN overlap < 6 THEN 'insufficient-compared-points' END, CASE WHEN nrmse > 0.9 THEN 'normalized-rmse-above-useful-threshold' END, CASE WHEN correlation < 0.2 THEN 'correlation-below-useful-threshold' END)"


@query("B5_quality_gate", f"SELECT {GATE} AS reasons, count(*) AS n, {GATE} = '' AS ok FROM {{cm}} GROUP BY 1, 3")
def quality_gate(x):
    why = r.reasons(
        insufficient_compared_points=F.col("overlap") < 6, normalized_rmse_above_useful_threshold=F.col("nrmse") > 0.9, correlation_below_useful_threshold=F.col("correlation") < 0.2
    )
    d = x.cm.select(F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("ok"))
    return d.groupBy("reasons", "ok").agg(F.count("*").alias("n"))


@query("B6_pattern_qualification", "SELECT version_group, count(*) FILTER (participants >= 6 AND round(correlation, 9) >= 0.5 AND round(nrmse, 9) <= 1.0 AND round(validator, 9) >= 0.6) AS qualified, count(*) AS entries FROM {pe} GROUP BY 1")
def pattern_qualification(x):
    e = x.cm.groupBy("match_id", "version_group", "family_key", "metric").agg(
        F.count_distinct("participant_id").alias("p"), F.avg("correlation").alias("c"), F.avg("nrmse").alias("n"), (F.avg("score") + 0.1).alias("v")
    )
    return e.groupBy("version_group").agg(F.count_if(r.qualifies("p", "c", "n", "v")).alias("qualified"), F.count("*").alias("entries"))


@query("B7_bounds_filter", "SELECT event_id FROM {tgt} WHERE x BETWEEN 0 AND 15000 AND y BETWEEN 0 AND 12000")
def bounds_filter(x):
    ok = F.col("x").between(0, 15000) & F.col("y").between(0, 12000) & ~F.isnan("x") & ~F.isnan("y")
    return x.tgt.filter(ok).select("event_id")


STATS = {"ORDERS": "orders", "TOTAL": "total", "URGENT": "urgent", "NOTE": "note"}


@query("B8_wide_stats", """SELECT o_custkey AS id, count(*) AS orders, CAST(floor(sum(o_totalprice)) AS BIGINT) AS total, nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) AS urgent, CAST(NULL AS BIGINT) AS note FROM orders GROUP BY 1""")
def wide_stats(x):
    """Stat map of strings to typed, renamed columns; text that is not a number becomes null."""
    from eventloom.sources.bundles import wide_projection

    u = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    m = x.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.create_map(
            F.lit("ORDERS"), F.count("*").cast("string"), F.lit("TOTAL"), F.floor(F.sum("o_totalprice")).cast("string"),
            F.lit("URGENT"), F.when(u > 0, u.cast("string")), F.lit("NOTE"), F.lit("n/a"),
        ).alias("stats")
    )
    return wide_projection(m, ["id"], "stats", {k: (v, "long") for k, v in STATS.items()})


@query("B9_code_labels", "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1")
def code_labels(x):
    return x.orders.groupBy(lb.lookup({"F": "finished", "O": "open"}, "o_orderstatus", "other").alias("label")).agg(F.count("*").alias("n"))


@query("B10_normalisation", "SELECT CASE WHEN l_returnflag = 'A' THEN true WHEN l_returnflag = 'N' THEN false END AS win, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def normalisation(x):
    """'Win'/'1' to true, 'Fail'/'0' to false, empty to null; numeric text to numbers."""
    from eventloom.sources.bundles import as_number, as_win

    f = F.col("l_returnflag")
    raw = F.when(f == "A", "Win").when(f == "N", "0").otherwise("")
    d = x.lineitem.select(as_win(raw).alias("win"), as_number(F.col("l_linenumber").cast("string")).alias("v"))
    return d.groupBy("win").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"))


@query("B11_complete_stats", "SELECT o_custkey AS id, bool_and(regexp_full_match(CASE WHEN o_totalprice > 480000 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END, '-?[0-9]+')) AS complete FROM orders GROUP BY 1")
def complete_stats(x):
    v = F.when(F.col("o_totalprice") > 480000, "x").otherwise(F.col("o_orderkey").cast("string"))
    return x.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.bool_and(v.rlike("^-?[0-9]+$")).alias("complete"))


@query("B12_leaf_paths", """SELECT unnest(['$.a.value', '$.a.k', '$.tags[]', '$.by{}.n']) AS path, unnest([count(*), count(*), count(*) * 2, count(*)]) AS n, unnest(['metric', 'metric', 'tag', 'keyed']) AS category FROM events""")
def leaf_paths(x):
    """Leaf paths of JSON documents: array indexes fold to [], numeric keys to {}."""
    from eventloom.sources.bundles import leaf_paths as paths

    by = F.concat(F.lit('{"'), F.col("user_id").cast("string"), F.lit('":{"n":1}}'))
    doc = F.concat(
        F.lit('{"a":{"value":'), F.col("value").cast("string"), F.lit(',"k":1},"tags":["x","y"],"by":'), by, F.lit("}")
    )
    p = paths(x.events.select(doc.alias("doc")), "doc", 3)
    cat = F.when(F.col("path").contains("[]"), "tag").when(F.col("path").contains("{}"), "keyed").otherwise("metric")
    return p.groupBy("path").agg(F.count("*").alias("n")).withColumn("category", cat)


@query("B13_segment_search", "SELECT seg_id, match_id FROM {seg} WHERE seg_type = 'chunk' AND contains(lower(seg_type || ' ' || codec || ' ' || CAST(seg_id AS VARCHAR)), 'urgent')")
def segment_search(x):
    text = F.lower(F.concat_ws(" ", "seg_type", "codec", F.col("seg_id").cast("string")))
    return x.seg.filter((F.col("seg_type") == "chunk") & text.contains("urgent")).select("seg_id", "match_id")


@query("B14_important_events", """WITH a AS (SELECT *, (entity = 'error' AND value > 100) AS imp FROM {ev}), b AS (SELECT *, count(*) FILTER (imp) OVER (PARTITION BY match_id) AS n FROM a) SELECT match_id, event_id FROM b WHERE CASE WHEN n > 0 THEN imp ELSE entity <> 'purchase' END QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY t, event_id) <= 50""")
def important_events(x):
    from eventloom.operators.packets import important

    imp = (F.col("entity") == "error") & (F.col("value") > 100)
    return important(x.ev, ["match_id"], imp, F.col("entity") != "purchase", ["t", "event_id"], 50).select("match_id", "event_id")


@query("B15_inclusion_class", "SELECT CASE WHEN correlation >= 0.7 AND nrmse <= 0.4 THEN 'passing' WHEN correlation >= 0.5 AND nrmse <= 0.7 THEN 'near_passing' END AS label, count(*) AS n FROM {cm} GROUP BY 1")
def inclusion_class(x):
    c, n = F.col("correlation"), F.col("nrmse")
    cls = F.when((c >= 0.7) & (n <= 0.4), "passing").when((c >= 0.5) & (n <= 0.7), "near_passing")
    return x.cm.groupBy(cls.alias("label")).agg(F.count("*").alias("n"))


@query("B16_policy_gates", """WITH p AS (SELECT * FROM (VALUES ('A', 10, 0.5, NULL, 0.8), ('N', NULL, 0.3, 0.2, NULL)) v(family_key, mo, ms, mc, mn)) SELECT c.family_key, count(*) AS rows, count(*) FILTER (p.family_key IS NOT NULL AND coalesce(overlap >= mo, true) AND coalesce(score >= ms, true) AND coalesce(correlation >= mc, true) AND coalesce(nrmse <= mn, true)) AS passes FROM {cm} c LEFT JOIN p USING (family_key) GROUP BY 1""")
def policy_gates(x):
    """Per-family policy with open limits: a missing limit passes, a missing policy fails."""
    pol = x.spark.createDataFrame([("A", 10, 0.5, None, 0.8), ("N", None, 0.3, 0.2, None)], "family_key string, mo int, ms double, mc double, mn double")
    c, yes = F.col, F.lit(True)
    ok = (
        c("ms").isNotNull() & F.coalesce(c("overlap") >= c("mo"), yes) & F.coalesce(c("score") >= c("ms"), yes) & F.coalesce(c("correlation") >= c("mc"), yes) & F.coalesce(c("nrmse") <= c("mn"), yes)
    )
    return x.cm.join(F.broadcast(pol), "family_key", "left").groupBy("family_key").agg(F.count("*").alias("rows"), F.count_if(ok).alias("passes"))
