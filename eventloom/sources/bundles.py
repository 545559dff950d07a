"""Match bundles, rosters, timelines, catalogs, profiles and stored fixtures as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME = (
    "struct<timestamp:bigint, participantFrames:map<string, struct<level:int, xp:int, totalGold:int, position:struct<x:double,y:double>>>,"
    " events:array<struct<type:string, timestamp:bigint, participantId:bigint, itemId:bigint>>>"
)
MATCH_SCHEMA = "metadata struct<matchId:string>, info struct<gameVersion:string, gameDuration:bigint>"
TIMELINE_SCHEMA = f"metadata struct<matchId:string>, info struct<frames:array<{FRAME}>>"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON documents with a declared schema and their file path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def pair_bundles(matches: DataFrame, timelines: DataFrame, ident: str, version: str) -> DataFrame:
    """Match and timeline documents of the same id; incomplete pairs drop out.

    Ordered by numeric version parts, then id.
    """
    parts = F.transform(F.split(version, "\\."), lambda p: p.try_cast("int"))
    return matches.join(timelines, ident).withColumn("version_order", parts).orderBy("version_order", ident)


def parse_json(df: DataFrame, text: str, schema: str, name: str) -> DataFrame:
    return df.withColumn(name, F.from_json(text, schema))


def roster(df: DataFrame, keys: Sequence[str], stats_json: str) -> DataFrame:
    """JSON list of stat maps inside a JSON document → one row per roster index."""
    stats = F.from_json(stats_json, "array<map<string,string>>")
    out = df.select(*keys, F.posexplode(stats).alias("roster_index", "stats"))
    return out.withColumn("participant_id", F.col("roster_index") + 1)


def wide_projection(df: DataFrame, keys: Sequence[str], stats: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Typed, renamed columns from a string map; what does not parse is null."""
    return df.select(*keys, *[F.col(stats)[k].try_cast(kind).alias(name) for k, (name, kind) in fields.items()])


def as_win(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("win", "1", "true"), True).when(v.isin("fail", "0", "false"), False)


def as_number(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit("")).try_cast("double")


def timeline_metrics(df: DataFrame, keys: Sequence[str], frames: str, metrics: Sequence[str]) -> DataFrame:
    """Frames × participants × metrics as long rows."""
    f = df.select(*keys, F.posexplode(frames).alias("frame", "f"))
    p = f.select(*keys, "frame", F.col("f.timestamp").alias("t"), F.explode("f.participantFrames").alias("participant_id", "s"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("s")[m].cast("double").alias("value")) for m in metrics])
    return p.select(*keys, "frame", "t", "participant_id", F.explode(cells).alias("c")).select(
        *keys, "frame", "t", "participant_id", "c.*"
    )


def timeline_events(df: DataFrame, keys: Sequence[str], frames: str) -> DataFrame:
    f = df.select(*keys, F.posexplode(frames).alias("frame", "f"))
    return f.select(*keys, "frame", F.posexplode("f.events").alias("event_index", "e")).select(*keys, "frame", "event_index", "e.*")


def timeline_positions(df: DataFrame, keys: Sequence[str], frames: str) -> DataFrame:
    """Finite positions only."""
    f = df.select(*keys, F.explode(frames).alias("f"))
    p = f.select(*keys, F.col("f.timestamp").alias("t"), F.explode("f.participantFrames").alias("participant_id", "s"))
    p = p.select(*keys, "participant_id", "t", F.col("s.position.x").alias("x"), F.col("s.position.y").alias("y"))
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    return p.filter(ok[0] & ok[1])


def catalog(df: DataFrame, items: str) -> DataFrame:
    """Catalog document (id → item struct) as a dimension."""
    return df.select(F.explode(items).alias("item_id", "item")).select(F.col("item_id").cast("long").alias("item_id"), "item.*")


def resolve_items(df: DataFrame, dim: DataFrame, item: str) -> DataFrame:
    """Left join on the catalog; unknown ids stay with ``known`` false."""
    return df.join(dim.withColumn("known", F.lit(True)), item, "left").withColumn("known", F.coalesce("known", F.lit(False)))


PROFILE_KEYS = ("group", "accepted", "lengths", "offset")


def validate_profiles(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Parsed profiles that obey every rule, and one row per broken rule.

    Rules: known keys only, unique group, at most eight lengths, offset within 0..4096 and every
    accepted version inside the group.
    """
    known = F.array(*[F.lit(k) for k in PROFILE_KEYS])
    keys = F.json_object_keys(text)
    p = df.withColumn("p", F.from_json(text, "group string, accepted array<string>, lengths array<int>, offset int"))
    p = p.withColumn("keys", keys).select("*", "p.group", "p.accepted", "p.lengths", "p.offset")
    repeated = p.groupBy("group").agg((F.count("*") > 1).alias("repeated"))
    p = p.join(repeated, "group", "left")
    broken = F.filter(
        F.array(
            F.when(F.size(F.array_except("keys", known)) > 0, "unknown-key"),
            F.when(F.coalesce("repeated", F.lit(True)), "duplicate-group"),
            F.when(F.size("lengths") > 8, "too-many-lengths"),
            F.when(~F.coalesce(F.col("offset").between(0, 4096), F.lit(False)), "offset-out-of-range"),
            F.when(F.exists("accepted", lambda v: ~v.startswith(F.concat(F.col("group"), F.lit(".")))), "version-outside-group"),
        ),
        lambda r: r.isNotNull(),
    )
    p = p.withColumn("broken", broken)
    good = p.filter(F.size("broken") == 0).select("group", "accepted", "lengths", "offset")
    return good, p.select("group", F.explode("broken").alias("violation"))


def with_profile(df: DataFrame, profiles: DataFrame, version_group: str) -> DataFrame:
    """Profile of each row's version group; rows without one are marked unsupported, never guessed."""
    dim = profiles.withColumnRenamed("group", version_group).withColumn("supported", F.lit(True))
    return df.join(dim, version_group, "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def leaf_paths(df: DataFrame, text: str, depth: int) -> DataFrame:
    """Leaf paths of JSON documents down to ``depth`` levels, one variant explosion per level."""
    level = df.select(F.lit("$").alias("path"), F.parse_json(text).alias("v"))
    out = None
    for i in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = level.filter(~nested).select("path")
        out = leaves if out is None else out.unionByName(leaves)
        if i == depth:
            break
        inner = df.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", F.col("value").alias("child"))
        step = level.filter(nested).lateralJoin(inner).select("path", "key", F.col("child").alias("v"))
        name = (
            F.when(F.col("key").isNull(), F.concat("path", F.lit("[]")))
            .when(F.col("key").rlike("^[0-9]+$"), F.concat("path", F.lit("{}")))
            .otherwise(F.concat_ws(".", "path", "key"))
        )
        level = step.select(name.alias("path"), "v")
    return out
