"""Match-analytics views over the supplied tables.

The corpus tables of a match tool are not part of the test data, so each view maps a
supplied table to the shape an operator expects. ``VIEWS`` holds the same views as SQL.

* ``ev``      events: match = user, entity = event type, t = ms since 2024-01-01
* ``tgt``/``pair`` oracle positions, and candidate samples with the position interpolated at their time
* ``dec``/``orc`` decoded stream and an independent, slightly shifted stream
* ``tx``      item operations: match = supplier, entity = line status, item = line number
* ``cm``      candidate matches from lineitem
* ``pe``      pattern entries: ``cm`` per match, version, family and metric
* ``pk``      packets from conversations: match = conversation, block = turn
* ``rec``/``cell`` fixed-size byte records quantised from embeddings, and their bytes in rows
* ``seg``     container segments from orders
* ``roster``  participants from customer/nation/region
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MS = 1704067200000  # 2024-01-01T00:00:00Z
DAY_MS = 86_400_000
TX_BLOCK_MS = 365 * DAY_MS
#: Discovery takes the records below this share of the identifiers; the rest is held out.
DISCOVERY = 0.7
REC_CUT = f"(SELECT {DISCOVERY} * (max(rec_id) + 1) FROM {{rec}})"
MATCH_CUT = f"(SELECT {DISCOVERY} * (max(match_id) + 1) FROM {{tx}})"


def with_part(df, source, id_col: str):
    """``df`` with ``early``: whether a row's identifier lies in the discovery share of ``source``."""
    cut = source.agg((F.lit(DISCOVERY) * (F.max(id_col) + 1)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("early", F.col(id_col) < F.col("_cut")).drop("_cut")  # one-row side


VIEWS: dict[str, str] = {
    "ev": f"""SELECT event_id, user_id AS match_id, event_type AS entity,
        CAST(epoch_us(ts) // 1000 - {EPOCH_MS} AS BIGINT) AS t, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "tgt": """SELECT match_id, event_id, t + 1000 AS t, 100 * value + k AS x, CAST(150 * k AS DOUBLE) + value AS y FROM {ev}""",
    "pair": """SELECT b.event_id, b.match_id, b.entity, b.t, b.rx, b.ry,
        CASE WHEN b.bx IS NULL THEN f.x WHEN f.x IS NULL THEN b.bx WHEN b.t = b.bt THEN b.bx
         ELSE b.bx + (f.x - b.bx) * ((b.t - b.bt)::DOUBLE / (f.t - b.bt)) END AS tx,
        CASE WHEN b.bx IS NULL THEN f.y WHEN f.x IS NULL THEN b.byy WHEN b.t = b.bt THEN b.byy
         ELSE b.byy + (f.y - b.byy) * ((b.t - b.bt)::DOUBLE / (f.t - b.bt)) END AS ty
        FROM (SELECT e.event_id, e.match_id, e.entity, e.t, e.value AS rx, CAST(e.k AS DOUBLE) AS ry, p.t AS bt, p.x AS bx, p.y AS byy
          FROM {ev} e ASOF LEFT JOIN {tgt} p ON e.match_id = p.match_id AND e.t >= p.t) b
        ASOF LEFT JOIN {tgt} f ON b.match_id = f.match_id AND b.t < f.t""",
    "dec": "SELECT match_id, entity, event_id AS id, t, k FROM {ev}",
    "orc": """SELECT match_id, CASE WHEN value > 200 THEN 'other' ELSE entity END AS entity, event_id AS id,
        t + CASE WHEN k < 60 THEN 0 WHEN k < 80 THEN 1 WHEN k < 95 THEN -1 ELSE 5000 END AS t, k FROM {ev}""",
    "tx": """SELECT l_suppkey AS match_id, l_linestatus AS entity,
        CASE WHEN l_returnflag = 'R' THEN 'REMOVE' ELSE 'ADD' END AS op, l_returnflag AS flag,
        CAST(l_linenumber AS BIGINT) AS item_id, CAST(epoch_ms(l_shipdate) AS BIGINT) AS t,
        l_orderkey AS o1, CAST(l_linenumber AS BIGINT) AS o2, l_partkey AS o3, l_extendedprice AS o4,
        l_quantity AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax
        FROM lineitem""",
    "cm": """SELECT l_suppkey AS match_id, l_linestatus AS version_group, l_returnflag AS family_key,
        CAST(l_linenumber AS BIGINT) AS slot_index, CAST(round(l_discount * 100) AS BIGINT) AS participant_id,
        'm' || CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) AS metric,
        l_quantity / 50 AS score, l_extendedprice / 105000 AS correlation, (l_partkey + 1) / 2048.0 AS nrmse,
        CAST(l_quantity AS BIGINT) AS overlap, l_quantity - 25 AS slope, l_extendedprice / 100 AS intercept,
        l_orderkey AS o1, l_partkey AS o3, l_extendedprice AS o4 FROM lineitem""",
    "pe": """SELECT match_id, version_group, family_key, metric, family_key || ':' || metric AS pattern_key,
        count(DISTINCT participant_id) AS participants, avg(correlation) AS correlation, avg(nrmse) AS nrmse,
        avg(score) + 0.1 AS validator, avg(score * correlation) AS effective, max(score) AS confidence,
        min(slot_index) AS row_start, max(slot_index) AS row_end, median(slope) AS slope, median(intercept) AS intercept,
        count(*) AS samples, max(score) > 0.95 AS promoted,
        CASE WHEN avg(correlation) > 0.5 THEN 'dynamic' ELSE 'static' END AS archetype
        FROM {cm} GROUP BY 1, 2, 3, 4""",
    "pk": """SELECT conv_id AS match_id, turn AS block_index, role AS packet_type, text,
        hex(encode(text)) AS hx, CAST(octet_length(encode(text)) AS BIGINT) AS len FROM conversations""",
    "byt": """SELECT match_id, block_index, packet_type, len, pos - 1 AS pos,
        CAST('0x' || substr(hx, CAST(2 * pos - 1 AS BIGINT), 2) AS BIGINT) AS b
        FROM (SELECT *, unnest(range(1, len + 1)) AS pos FROM {pk})""",
    "rec": """SELECT CAST(label AS BIGINT) AS family, vec_id AS rec_id,
        list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS BIGINT)) AS arr FROM embeddings""",
    "cell": """SELECT family, rec_id, unnest(range(len(arr))) AS pos, unnest(arr) AS b FROM {rec}""",
    "seg": """SELECT o_custkey AS match_id, o_orderkey AS seg_id,
        CASE o_orderstatus WHEN 'P' THEN 'startup' WHEN 'F' THEN 'keyframe' ELSE 'chunk' END AS seg_type,
        o_orderpriority AS codec, CAST(floor(o_totalprice) AS BIGINT) AS len,
        CAST(epoch_ms(o_orderdate) AS BIGINT) AS t FROM orders""",
    "roster": """SELECT c_custkey AS match_id, c_custkey AS roster_index, c_name AS champion,
        CAST(n_regionkey AS BIGINT) AS team, c_mktsegment AS team_position, c_acctbal AS gold
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}


class Tables:
    """The supplied parquet tables and the stand-in views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @staticmethod
    def millis(c: str):
        return F.unix_millis(F.col(c).cast("timestamp"))

    @cached_property
    def ev(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.col("user_id").alias("match_id"),
            F.col("event_type").alias("entity"),
            (self.millis("ts") - EPOCH_MS).alias("t"),
            "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @cached_property
    def tgt(self) -> DataFrame:
        c = F.col
        return self.ev.select(
            "match_id", "event_id", (c("t") + 1000).alias("t"),
            (100 * c("value") + c("k")).alias("x"), (150 * c("k") + c("value")).alias("y"),
        )

    @cached_property
    def pair(self) -> DataFrame:
        from eventloom.operators.timejoin import interpolate

        left = self.ev.select(
            "event_id", "match_id", "entity", "t", F.col("value").alias("rx"), F.col("k").cast("double").alias("ry")
        )
        out = interpolate(left, self.tgt, ["match_id"], "t", "event_id", DAY_MS, ["x", "y"])
        return out.withColumnsRenamed({"at_x": "tx", "at_y": "ty"})

    @cached_property
    def dec(self) -> DataFrame:
        return self.ev.select("match_id", "entity", F.col("event_id").alias("id"), "t", "k")

    @cached_property
    def orc(self) -> DataFrame:
        k = F.col("k")
        shift = F.when(k < 60, 0).when(k < 80, 1).when(k < 95, -1).otherwise(5000)
        entity = F.when(F.col("value") > 200, "other").otherwise(F.col("entity"))
        return self.ev.select(
            "match_id", entity.alias("entity"), F.col("event_id").alias("id"), (F.col("t") + shift).alias("t"), "k"
        )

    @cached_property
    def tx(self) -> DataFrame:
        c = F.col
        return self.lineitem.select(
            c("l_suppkey").alias("match_id"),
            c("l_linestatus").alias("entity"),
            F.when(c("l_returnflag") == "R", "REMOVE").otherwise("ADD").alias("op"),
            c("l_returnflag").alias("flag"),
            c("l_linenumber").cast("long").alias("item_id"),
            self.millis("l_shipdate").alias("t"),
            c("l_orderkey").alias("o1"),
            c("l_linenumber").cast("long").alias("o2"),
            c("l_partkey").alias("o3"),
            c("l_extendedprice").alias("o4"),
            c("l_quantity").alias("qty"),
            F.round(c("l_discount") * 100).cast("long").alias("disc"),
            F.round(c("l_tax") * 100).cast("long").alias("tax"),
        )

    @cached_property
    def cm(self) -> DataFrame:
        c = F.col
        return self.lineitem.select(
            c("l_suppkey").alias("match_id"),
            c("l_linestatus").alias("version_group"),
            c("l_returnflag").alias("family_key"),
            c("l_linenumber").cast("long").alias("slot_index"),
            F.round(c("l_discount") * 100).cast("long").alias("participant_id"),
            F.concat(F.lit("m"), F.round(c("l_tax") * 100).cast("long").cast("string")).alias("metric"),
            (c("l_quantity") / 50).alias("score"),
            (c("l_extendedprice") / 105000).alias("correlation"),
            ((c("l_partkey") + 1) / 2048.0).alias("nrmse"),
            c("l_quantity").cast("long").alias("overlap"),
            (c("l_quantity") - 25).alias("slope"),
            (c("l_extendedprice") / 100).alias("intercept"),
            c("l_orderkey").alias("o1"),
            c("l_partkey").alias("o3"),
            c("l_extendedprice").alias("o4"),
        )

    @cached_property
    def pe(self) -> DataFrame:
        from eventloom.operators.quantiles import medians
        from eventloom.session import cut_lineage

        keys = ["match_id", "version_group", "family_key", "metric"]
        c = F.col
        agg = self.cm.groupBy(*keys).agg(
            F.count_distinct("participant_id").alias("participants"),
            F.avg("correlation").alias("correlation"), F.avg("nrmse").alias("nrmse"),
            (F.avg("score") + 0.1).alias("validator"), F.avg(c("score") * c("correlation")).alias("effective"),
            F.max("score").alias("confidence"), F.min("slot_index").alias("row_start"),
            F.max("slot_index").alias("row_end"), F.count("*").alias("samples"),
        )
        med = medians(self.cm, keys, ["slope", "intercept"], "")
        # a rollup reads the entries several times; a checkpoint computes them once
        return cut_lineage(agg.join(med, keys).withColumns(
            {
                "pattern_key": F.concat_ws(":", "family_key", "metric"),
                "promoted": c("confidence") > 0.95,
                "archetype": F.when(c("correlation") > 0.5, "dynamic").otherwise("static"),
            }
        ))

    @cached_property
    def pk(self) -> DataFrame:
        payload = F.encode("text", "UTF-8")
        return self.conversations.select(
            F.col("conv_id").alias("match_id"),
            F.col("turn").alias("block_index"),
            F.col("role").alias("packet_type"),
            "text",
            payload.alias("payload"),
            F.octet_length(payload).cast("long").alias("len"),
        )

    @cached_property
    def byt(self) -> DataFrame:
        from eventloom.operators.payload import explode_bytes

        return explode_bytes(self.pk.drop("text"), "payload")

    @cached_property
    def rec(self) -> DataFrame:
        quantised = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("long"))
        return self.embeddings.select(F.col("label").cast("long").alias("family"), F.col("vec_id").alias("rec_id"), quantised.alias("arr"))

    @cached_property
    def cell(self) -> DataFrame:
        return self.rec.select("family", "rec_id", F.posexplode("arr").alias("pos", "b")).withColumn("pos", F.col("pos").cast("long"))

    @cached_property
    def seg(self) -> DataFrame:
        c = F.col
        kind = F.when(c("o_orderstatus") == "P", "startup").when(c("o_orderstatus") == "F", "keyframe")
        return self.orders.select(
            c("o_custkey").alias("match_id"),
            c("o_orderkey").alias("seg_id"),
            kind.otherwise("chunk").alias("seg_type"),
            c("o_orderpriority").alias("codec"),
            F.floor("o_totalprice").cast("long").alias("len"),
            self.millis("o_orderdate").alias("t"),
        )

    @cached_property
    def roster(self) -> DataFrame:
        c = F.col
        return self.customer.join(self.nation, c("c_nationkey") == c("n_nationkey")).select(
            c("c_custkey").alias("match_id"),
            c("c_custkey").alias("roster_index"),
            c("c_name").alias("champion"),
            c("n_regionkey").cast("long").alias("team"),
            c("c_mktsegment").alias("team_position"),
            c("c_acctbal").alias("gold"),
        )


TX_ORDER = ["t", "o1", "o2", "o3", "o4"]
