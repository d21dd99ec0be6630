"""Sinks (K1, K2); reports and run listing (K3, K4) live in
``tablesight.plans.runs``."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Header row; quotes inside a field are doubled, as CSV readers expect.
CSV = {"header": "true", "quote": '"', "escape": '"'}


def write_cleaned(df: DataFrame, path: str) -> str:
    """K1: CSV with a header row (a folder of part files, written in
    parallel)."""
    df.write.mode("overwrite").options(**CSV).csv(path)
    return path


def write_preview(df: DataFrame, path: str, order: list[str], n: int = 1000) -> str:
    """K2: the first n rows in ``order`` as CSV (a per-task top-k, then one
    small write)."""
    df.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").options(**CSV).csv(path)
    return path
