"""Sorts, limits, samples and set operations.

Every sort that feeds a limit carries a key tie-breaker, so results do not
depend on partitioning; ``orderBy(...).limit(k)`` plans as a per-task top-k
(TakeOrderedAndProject), never a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: str, k: int, tiebreak: list[str], ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) ``by``."""
    first = F.asc(by) if ascending else F.desc(by)
    return df.orderBy(first, *[F.asc(c) for c in tiebreak]).limit(k)


def sort_by_time(df: DataFrame, order: list[str]) -> DataFrame:
    """T4: a global sort (range exchange + local sort)."""
    return df.orderBy(*order)


def key_hash(key: list[str], seed: int = 42) -> Column:
    """32-bit hash of the key columns: the first eight hexadecimal digits of the
    MD5 of seed and keys as text, joined by ':'.  The same on any partitioning,
    after any retry and in any engine with MD5.  NULL keys count as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_sample(df: DataFrame, fraction: float, key: list[str], seed: int = 42) -> DataFrame:
    """T5: a repeatable sample of about ``fraction`` of the rows."""
    return df.filter(key_hash(key, seed) < F.lit(int(fraction * (1 << 32))))


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by hash order (a top-k, no full
    sort)."""
    return df.withColumn("__h", key_hash(key, seed)).orderBy("__h", *key).limit(n).drop("__h")


def union_all(*dfs: DataFrame) -> DataFrame:
    """Stack inputs by column name (missing columns NULL)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``.  A grouped ``min_by`` on a
    struct: partial aggregation keeps a key repeated by a third of the rows to
    one row per map task."""
    rest = [c for c in df.columns if c not in key]
    o = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), o).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct rows (NULLs equal)."""
    return df.dropDuplicates()
