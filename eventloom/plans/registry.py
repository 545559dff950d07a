"""Registered queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.session import ship_library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# pushes exact decimal ties to one side, so sums added in another order round alike
NUDGE = 3.3e-8


def tidy(df: DataFrame) -> DataFrame:
    """Stable output types: long integers, doubles rounded to six digits."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0)
        out.append(c.alias(field.name))
    return df.select(*out)


def expand(sql: str) -> str:
    """Spell ``R6(x)`` (round to six digits, no negative zero) in plain SQL."""
    while (at := sql.find("R6(")) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(round(CAST({sql[at + 3:end - 1]} AS DOUBLE) + {NUDGE}, {DIGITS}) + 0.0){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from eventloom.plans.standins import Tables

            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_library(spark)
            return tidy(fn(Tables(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = expand(with_views(sql))
        return fn

    return wrap


def with_views(sql: str) -> str:
    """Prefix the stand-in views that the statement mentions."""
    from eventloom.plans.standins import VIEWS

    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in needed and f"{{{view}}}" in text:
                visit(VIEWS[view])
                needed.append(view)

    visit(sql)
    body = sql
    for view in VIEWS:
        body = body.replace(f"{{{view}}}", view)
    if not needed:
        return body.strip()
    ctes = []
    for view in needed:
        text = VIEWS[view]
        for other in VIEWS:
            text = text.replace(f"{{{other}}}", other)
        ctes.append(f"{view} AS ({text.strip()})")
    body = body.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH "):
        rest = body[len("WITH RECURSIVE "):] if recursive else body[len("WITH "):]
        return f"WITH {recursive}" + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body
