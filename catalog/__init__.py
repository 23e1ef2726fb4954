"""Registry of runnable queries: each name has a Spark job and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """One integer type, one float type with 6 decimals, booleans as 0/1: comparable across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
            c = c.cast("int").cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, d: tidy(fn(spark, d))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    from importlib import import_module
    from pkgutil import iter_modules

    for m in iter_modules(__path__):
        if m.name.startswith("q_"):
            import_module(f"{__name__}.{m.name}")
