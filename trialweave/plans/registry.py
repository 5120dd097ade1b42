"""Registered queries and helpers that make results comparable across engines."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(run, sql)
        return fn

    return add


def comparable(df: DataFrame) -> DataFrame:
    """Timestamps as text and doubles to 6 places, so that both engines print the same."""
    def shown(f: T.StructField):
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return (F.round(f.name, 6) + F.lit(0.0)).alias(f.name)
        return F.col(f.name)

    return df.select(*[shown(f) for f in df.schema.fields])


# --- SQL side -------------------------------------------------------------------------------

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """Declare a named subquery that oracle texts can refer to."""
    CTES[name] = body.strip()


def _mentioned(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", text))
    return [n for n in CTES if n in words]


def oracle(body: str, ts: Sequence[str] = (), num: Sequence[str] = (), plain: Sequence[str] = ()) -> str:
    """A full SQL text: the declared subqueries that ``body`` needs, then the output columns."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in _mentioned(text):
            if n not in needed:
                visit(CTES[n])
                if n not in needed:
                    needed.append(n)

    visit(body)
    columns = [
        *plain,
        *[f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in ts],
        *[f"round(CAST({c} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {c}" for c in num],
    ]
    shared = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    with_ = f"WITH {shared}\n" if shared else ""
    return f"{with_}SELECT {', '.join(columns)} FROM ({body.strip()}) AS result"
