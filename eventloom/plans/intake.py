"""Bundles, framing, catalogs, profiles and artifacts over data Spark derives from the tables."""

from pyspark.sql import functions as F

from eventloom.plans.registry import query
from eventloom.plans.standins import EPOCH_MS
from eventloom.sources import artifacts as ar
from eventloom.sources import bundles as bd
from eventloom.sources import framing as fr


def _le(value, width):
    """Little-endian hex of an unsigned number."""
    big = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.concat(*[F.substring(big, 2 * (width - i) - 1, 2) for i in range(width)])


def _segments(x):
    """One framed segment per conversation; short payloads use the short length form.

    A segment whose last block claims one byte too many stands for a truncated file.
    """
    p = x.pk.select("match_id", "block_index", "len", F.hex("payload").alias("hx"))
    last = x.pk.groupBy("match_id").agg(F.max("block_index").alias("last"), F.count("*").alias("n"))
    p = p.join(last, "match_id")
    broken = (F.col("n") == 8) & (F.col("block_index") == F.col("last"))
    short = (F.col("len") < 200) & ~broken
    marker = F.when(short, 0x90 + 1).otherwise(0x80 + 1)
    claimed = F.col("len") + F.when(broken, 1).otherwise(0)
    block = F.concat(
        _le(marker, 1), _le(F.col("block_index") + 5, 1), F.when(short, _le(F.col("len"), 1)).otherwise(_le(claimed, 4)),
        _le(F.col("block_index") + 300, 2), _le(F.col("match_id") + 0x40000000, 4), F.col("hx"),
    )
    seq = F.array_sort(F.collect_list(F.struct("block_index", block.alias("b"))))  # the blocks of one segment file
    return p.groupBy("match_id").agg(F.unhex(F.array_join(F.transform(seq, lambda v: v["b"]), "")).alias("content"))


@query("A2_framed_ingestion", """WITH n AS (SELECT match_id, count(*) AS n, max(block_index) AS last FROM {pk} GROUP BY 1) SELECT p.match_id, p.block_index, 1 AS channel, len AS content_length, p.block_index + 300 AS packet_type, p.match_id + 1073741824 AS block_param,
 R6(sum(p.block_index + 5) OVER (PARTITION BY p.match_id ORDER BY p.block_index) / 1000.0) AS ts_seconds, substr(sha256(text), 1, 8) AS digest FROM {pk} p JOIN n USING (match_id) WHERE NOT (n = 8 AND p.block_index = last)""")
def framed_ingestion(x):
    """Binary segments to packets: time deltas, inherited state and payloads come back exactly."""
    p = fr.packets(fr.parse_packets(_segments(x), ["match_id"], "content"))
    return p.select("match_id", "block_index", "channel", "content_length", "packet_type", "block_param", "ts_seconds", F.substring(F.sha2("payload", 256), 1, 8).alias("digest"))


@query("A2_framing_errors", """SELECT match_id, 'truncated-payload' AS code, 7 AS block_index, max(len) FILTER (block_index = 7) + 1 AS declared_content_length FROM {pk} GROUP BY 1 HAVING count(*) = 8""")
def framing_errors(x):
    e = fr.packet_errors(fr.parse_packets(_segments(x), ["match_id"], "content"), ["match_id"])
    return e.select("match_id", "code", "block_index", "declared_content_length")


@query("A3_framing_report", """WITH s AS (SELECT match_id, count(*) AS n, sum(len + CASE WHEN len < 200 AND NOT (block_index = 7) THEN 9 ELSE 12 END) AS bytes FROM {pk} GROUP BY 1)
SELECT match_id // 25 AS version, count(*) AS segments, CAST(sum(n - CASE WHEN n = 8 THEN 1 ELSE 0 END) AS BIGINT) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (n = 8) AS errors, count(*) FILTER (n <> 8) AS exactly_consumed FROM s GROUP BY 1""")
def framing_report(x):
    seg = _segments(x)
    sizes = seg.select("match_id", F.octet_length("content").cast("long").alias("bytes"), F.floor(F.col("match_id") / 25).alias("version"))
    return fr.framing_report(fr.parse_packets(seg, ["match_id"], "content"), sizes, ["match_id"], ["version"])


def _timeline_text(x):
    """A timeline document per match built by Spark from its events.

    One document per match is the grain of the source format; real documents arrive as files.
    """
    day = F.floor(F.col("t") / 86_400_000)
    ev = x.ev.withColumn("frame", day)
    e = F.array_sort(F.collect_list(F.struct(F.col("t").alias("timestamp"), F.col("event_id").alias("itemId"), F.col("entity").alias("type"), F.col("k").alias("participantId"))))
    frames = ev.groupBy("match_id", "frame").agg(e.alias("events"), F.max("t").alias("timestamp"), F.max("k").alias("mk"), F.max("value").alias("mv"))
    pf = F.map_from_arrays(
        F.array(F.lit("1"), F.lit("2")),
        F.array(
            F.struct(F.size("events").alias("level"), F.col("mk").cast("int").alias("xp"), F.struct(F.col("mv").alias("x"), F.col("mk").cast("double").alias("y")).alias("position")),
            F.struct(F.lit(1).alias("level"), F.lit(2).alias("xp"), F.struct(F.lit(None).cast("double").alias("x"), F.lit(1.0).alias("y")).alias("position")),
        ),
    )
    frames = frames.withColumn("f", F.struct("frame", "timestamp", pf.alias("participantFrames"), "events"))
    doc = frames.groupBy("match_id").agg(F.array_sort(F.collect_list("f"), lambda a, b: (a["frame"] - b["frame"]).cast("int")).alias("frames"))
    text = F.to_json(F.struct(F.struct(F.col("match_id").cast("string").alias("matchId")).alias("metadata"), F.struct("frames").alias("info")))
    return doc.select("match_id", text.alias("doc"))


def _timeline(x):
    schema = f"struct<metadata:struct<matchId:string>, info:struct<frames:array<{bd.FRAME}>>>"
    parsed = bd.parse_json(_timeline_text(x), "doc", schema, "d")
    return parsed.select(F.col("d.metadata.matchId").alias("match"), F.col("d.info.frames").alias("frames"))


@query("A1_bundle_pairs", """WITH m AS (SELECT DISTINCT c_custkey AS id, c_nationkey AS v FROM customer WHERE c_acctbal > 0), t AS (SELECT DISTINCT user_id AS id FROM events) SELECT CAST(id AS VARCHAR) AS match, CAST(v AS VARCHAR) || '.' || CAST(id // 10 AS VARCHAR) AS version FROM m JOIN t USING (id)""")
def bundle_pairs(x):
    """Match and timeline documents paired by id; matches without a timeline drop out."""
    version = F.concat_ws(".", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 10).cast("string"))
    doc = F.to_json(F.struct(F.struct(F.col("c_custkey").cast("string").alias("matchId")).alias("metadata"), F.struct(version.alias("gameVersion")).alias("info")))
    m = x.customer.filter("c_acctbal > 0").select(doc.alias("doc"))
    m = bd.parse_json(m, "doc", "struct<metadata:struct<matchId:string>, info:struct<gameVersion:string>>", "d")
    m = m.select(F.col("d.metadata.matchId").alias("match"), F.col("d.info.gameVersion").alias("version"))
    return bd.pair_bundles(m, _timeline(x).select("match"), "match", "version").select("match", "version")


@query("A4_roster", """SELECT n_nationkey AS nation, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS roster_index, c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS gold FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def roster(x):
    """Stat list nested as JSON text inside a summary document → participant rows."""
    stat = F.create_map(F.lit("NAME"), F.col("c_name"), F.lit("GOLD"), F.floor("c_acctbal").cast("string"))
    lists = x.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.map_entries(stat).alias("e")))).alias("l"))
    doc = lists.select("nation", F.to_json(F.struct(F.to_json(F.transform("l", lambda v: F.map_from_entries(v["e"]))).alias("statsJson"))).alias("doc"))
    inner = F.get_json_object("doc", "$.statsJson")
    r = bd.roster(doc.withColumn("s", inner), ["nation"], "s")
    return bd.wide_projection(r, ["nation", "roster_index"], "stats", {"NAME": ("name", "string"), "GOLD": ("gold", "long")})


@query("A5_catalog_resolution", """SELECT p_brand AS brand, p_partkey IS NOT NULL AS known, count(*) AS n, CAST(sum(CAST(floor(p_retailprice) AS BIGINT)) AS BIGINT) AS cost FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 45) ON p_partkey = l_partkey GROUP BY 1, 2""")
def catalog_resolution(x):
    """Catalog document exploded to a dimension; ids it lacks stay, marked unknown."""
    item = F.struct(F.col("p_brand").alias("brand"), F.floor("p_retailprice").alias("cost"))
    docs = x.part.filter("p_size < 45").groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), item))).alias("items"))
    dim = bd.catalog(docs, "items")
    out = bd.resolve_items(x.lineitem.select(F.col("l_partkey").alias("item_id")), dim, "item_id")
    return out.groupBy("brand", "known").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


def _profiles(x):
    g = F.concat_ws(".", F.lit("16"), F.floor(F.col("s_suppkey") / 2 + F.when(F.col("s_suppkey") < 90, F.col("s_suppkey") / 2).otherwise(0)).cast("string"))
    ver = F.when(F.col("s_acctbal") < 500, F.lit("15.1.0")).otherwise(F.concat(g, F.lit(".7")))
    lens = F.when(F.col("s_nationkey") == 3, F.sequence(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(4), F.lit(8)))
    doc = F.to_json(F.struct(g.alias("group"), F.array(ver).alias("accepted"), lens.alias("lengths"), (F.col("s_nationkey") * 200).alias("offset")))
    extra = F.when(F.col("s_nationkey") == 5, F.regexp_replace(doc, "\\}$", ',"note":1}')).otherwise(doc)
    return x.supplier.select(extra.alias("doc"))


PROF = """WITH p AS (SELECT '16.' || CAST(CAST(floor(s_suppkey / 2 + CASE WHEN s_suppkey < 90 THEN s_suppkey / 2 ELSE 0 END) AS BIGINT) AS VARCHAR) AS "group", s_acctbal < 500 AS badv, s_nationkey FROM supplier), d AS (SELECT "group", count(*) > 1 AS dup FROM p GROUP BY 1),
v AS (SELECT p."group", unnest([CASE WHEN s_nationkey = 5 THEN 'unknown-key' END, CASE WHEN dup THEN 'duplicate-group' END, CASE WHEN s_nationkey = 3 THEN 'too-many-lengths' END, CASE WHEN s_nationkey * 200 > 4096 THEN 'offset-out-of-range' END, CASE WHEN badv THEN 'version-outside-group' END]) AS violation FROM p JOIN d USING ("group"))"""


@query("A6_profile_violations", PROF + ' SELECT "group", violation FROM v WHERE violation IS NOT NULL')
def profile_violations(x):
    return bd.validate_profiles(_profiles(x), "doc")[1]


@query("A6_profile_lookup", """SELECT c_nationkey AS nation, CASE WHEN c_nationkey IN (SELECT CAST(floor(s_suppkey) AS INT) FROM supplier WHERE s_suppkey < 25 AND s_nationkey NOT IN (3, 5) AND s_nationkey * 200 <= 4096 AND s_acctbal >= 500) THEN true ELSE false END AS supported, count(*) AS rows FROM customer GROUP BY 1, 2""")
def profile_lookup(x):
    """Rows whose version group has no valid profile come out as unsupported."""
    good, _ = bd.validate_profiles(_profiles(x), "doc")
    rows = x.customer.select(F.col("c_nationkey").alias("nation"), F.concat_ws(".", F.lit("16"), F.col("c_nationkey").cast("string")).alias("version_group"))
    return bd.with_profile(rows, good, "version_group").groupBy("nation", "supported").agg(F.count("*").alias("rows"))


@query("A7_timeline_metrics", """WITH f AS (SELECT match_id, t // 86400000 AS day, max(t) AS t, count(*) AS level, max(k) AS xp FROM {ev} GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY day) - 1 AS frame FROM f)
SELECT CAST(match_id AS VARCHAR) AS match, frame, t, unnest(['1', '1', '2', '2']) AS participant_id, unnest(['level', 'xp', 'level', 'xp']) AS metric, R6(unnest([level, xp, 1, 2])) AS value FROM n""")
def timeline_metrics(x):
    m = bd.timeline_metrics(_timeline(x), ["match"], "frames", ["level", "xp"])
    return m


@query("A7_timeline_events", """WITH f AS (SELECT *, dense_rank() OVER (PARTITION BY match_id ORDER BY t // 86400000) - 1 AS frame FROM {ev}) SELECT CAST(match_id AS VARCHAR) AS match, frame, row_number() OVER (PARTITION BY match_id, frame ORDER BY t, event_id) - 1 AS event_index, entity AS type, t AS timestamp, k AS participantid, event_id AS itemid FROM f""")
def timeline_events(x):
    e = bd.timeline_events(_timeline(x), ["match"], "frames")
    return e.withColumnsRenamed({"participantId": "participantid", "itemId": "itemid"})


@query("A8_timeline_positions", "SELECT CAST(match_id AS VARCHAR) AS match, '1' AS participant_id, max(t) AS t, R6(max(value)) AS x, R6(max(k)) AS y FROM {ev} GROUP BY match_id, t // 86400000")
def timeline_positions(x):
    return bd.timeline_positions(_timeline(x), ["match"], "frames")


@query("A9_stored_assignments", """SELECT doc_id, quality, toxic, quality IS NOT NULL AS stored FROM documents LEFT JOIN labels USING (doc_id)""")
def stored_assignments(x):
    """Stored validation results joined back; a match without one keeps nulls."""
    doc = F.to_json(F.struct("doc_id", "quality", "toxic"))
    stored = bd.parse_json(x.labels.select(doc.alias("doc")), "doc", "struct<doc_id:bigint, quality:int, toxic:int>", "d").select("d.*")
    return x.documents.select("doc_id").join(stored, "doc_id", "left").withColumn("stored", F.col("quality").isNotNull())


PRINT = """SELECT {key}, count(*) AS rows, bit_xor(d) AS digest_xor, CAST(sum(d) AS BIGINT) AS digest_sum FROM (SELECT {key}, CAST('0x' || substr(sha256(CAST(l_linenumber AS VARCHAR) || '|' || l_linestatus || '|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || l_returnflag), 1, 8) AS BIGINT) AS d FROM lineitem{where}) GROUP BY 1"""
COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey", "l_partkey", "l_tax"]


@query("A10_content_fingerprint", PRINT.format(key="l_returnflag", where=""))
def content_fingerprint(x):
    return ar.fingerprint(x.lineitem.select(*COLS), ["l_returnflag"], volatile=["l_tax"])


@query("A11_stale_partitions", """WITH a AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_linenumber, count(*) AS n FROM lineitem WHERE NOT (l_linenumber = 3 AND l_quantity > 49) AND l_linenumber <> 6 GROUP BY 1) SELECT l_linenumber FROM a WHERE (l_linenumber, n) NOT IN (SELECT (l_linenumber, n) FROM b)""")
def stale_partitions(x):
    """Partitions to rebuild: an earlier run lacked one and saw fewer rows in another."""
    li = x.lineitem.select(*COLS, "l_quantity")
    before = li.filter("NOT (l_linenumber = 3 AND l_quantity > 49) AND l_linenumber <> 6")
    return ar.stale_partitions(ar.fingerprint(li, ["l_linenumber"]), ar.fingerprint(before, ["l_linenumber"]), ["l_linenumber"])
