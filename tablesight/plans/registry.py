"""Query registry behind ``__spark_entry__.queries()`` / ``oracle_sql()``, and
the KPI pack registry (U1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an
    optional DuckDB twin."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named double columns (both sides of the oracle check round
    the same way, so summation order does not show)."""
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c)
                       for c in df.columns])


# ---------------------------------------------------------------------------
# KPI pack registry
# ---------------------------------------------------------------------------

PACKS: dict[str, Callable] = {}


def register_pack(name: str):
    def deco(fn):
        PACKS[name] = fn
        return fn
    return deco


def get_pack(name: str | None):
    """Pack by name in any case; unknown or missing names give 'universal'."""
    return PACKS.get((name or "").lower()) or PACKS["universal"]
