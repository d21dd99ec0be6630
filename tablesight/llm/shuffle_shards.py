"""Sharding by a Feistel permutation over global row numbers (operator 3).

Rows get a global number in the order of their key columns.  A Feistel network
over the grid ``a x b`` (the smallest near-square grid with at least N cells)
permutes cell numbers; a result outside 0..N-1 is permuted again until it falls
inside (cycle walking), which makes a permutation of exactly the N rows.  The
permuted number p gives shard ``p mod shards`` and slot ``p div shards``: counts
differ by one at most (law ``rows``), slots have no gaps, and ``place`` computes
both for any row number without the table.

Everything is DataFrame functions.  Numbering sorts once by key (a range
exchange of the numbered columns), takes each row's index in its range and adds
the count of the ranges before it: one row per range reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.llm.common import passed_columns, unused
from tablesight.session import scratch_table

ROUNDS = 6
PRIME = 2_147_483_647  # squares of residues stay below 2^62
#: Walks tried.  With N cells wanted, fewer than sqrt(N)+1 cells lie outside, so
#: up to 64 such cells can never outlast it, and beyond that the chance for any
#: row is below N * N^-32; the query raises rather than misplace a row.
WALKS = 64


def grid(n_rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n_rows, 1) - 1) + 1)
    return a, max(1, -(-n_rows // a))


def round_keys(seed: int) -> list[tuple[int, int]]:
    """(offset, factor) of each round, from the seed."""
    x, out = seed % PRIME, []
    for i in range(ROUNDS):
        pair = []
        for j in range(2):
            x = (x * 48271 + 11 + 2 * i + j) % PRIME
            pair.append(x)
        out.append(tuple(pair))
    return out


def mix(x, offset, factor):
    """Round function; works on ints and on columns."""
    t = (x + offset) % PRIME
    y = (t * t + t * factor) % PRIME
    return y // 128 if isinstance(y, int) else F.floor(y / 128).cast("long")


def permute(x: int, n_rows: int, seed: int) -> int:
    """Plain-integer form of the permutation."""
    a, b = grid(n_rows)
    while True:
        left, right = divmod(x, b)
        for i, (offset, factor) in enumerate(round_keys(seed)):
            if i % 2 == 0:
                left = (left + mix(right, offset, factor)) % a
            else:
                right = (right + mix(left, offset, factor)) % b
        x = left * b + right
        if x < n_rows:
            return x


def place(row: int, n_rows: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = permute(row, n_rows, seed)
    return p % shards, p // shards


def permuted(row: Column, n_rows: int, seed: int) -> Column:
    """Column form of ``permute``."""
    a, b = grid(n_rows)
    keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("on_left"), F.lit(o).cast("long").alias("o"),
                              F.lit(f).cast("long").alias("f"))
                     for i, (o, f) in enumerate(round_keys(seed))])

    def one_round(state: Column, key: Column) -> Column:
        left, right = state["l"], state["r"]
        step = mix(F.when(key["on_left"], right).otherwise(left), key["o"], key["f"])
        return F.struct(F.when(key["on_left"], (left + step) % a).otherwise(left).alias("l"),
                        F.when(key["on_left"], right).otherwise((right + step) % b).alias("r"))

    def network(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(keys, start, one_round, lambda s: s["l"] * b + s["r"])

    outside = F.lit(n_rows).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), network(row),
        lambda x, _: F.when(x < outside, x).otherwise(network(x)))
    return F.when(walked < outside, walked).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(df: DataFrame, order: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers from 0 in the order of ``order`` (nulls first), and
    their count.  Rows equal in all of ``order`` are told apart by where they
    stand in the input, so one value may hold any share of the rows."""
    kept = passed_columns(df, [out])
    place_col, tie, part_col, start_col = (unused([*kept, out], n) for n in ("__at", "__tie", "__part", "__start"))
    dealt = (df.select(*[df[c] for c in kept], F.monotonically_increasing_id().alias(tie))
             .repartitionByRange(*[F.col(c) for c in order], F.col(tie))
             .sortWithinPartitions(*order, tie)
             .drop(tie)
             .withColumn(place_col, F.monotonically_increasing_id()))
    dealt = scratch_table(dealt, "rows")
    part = F.shiftrightunsigned(F.col(place_col), 33)
    counts = dealt.groupBy(part.alias("p")).count().collect()
    starts, total = {}, 0
    for r in sorted(counts, key=lambda r: r["p"]):
        starts[r["p"]] = total
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(
        [(int(p), int(n)) for p, n in starts.items()], f"{part_col} long, {start_col} long")
    numbered = (dealt.withColumn(part_col, part)
                .join(F.broadcast(offsets), part_col)  # one row per range partition
                .withColumn(out, F.col(start_col) + F.col(place_col).bitwiseAND((1 << 33) - 1)))
    return numbered.select(*kept, out), total


def assign_shards(df: DataFrame, order: list[str], shards: int = 8, seed: int = 20240229) -> DataFrame:
    """Add ``row_number``, ``law`` ("rows"), ``shard``, ``slot`` and
    ``grown_shard`` (null: under this law another shard moves rows anywhere).

    Null keys sort first; equal rows each get a place of their own; an empty
    table gives an empty result.
    """
    numbered, total = number_rows(
        df.select(*passed_columns(df, ["row_number", "law", "shard", "slot", "grown_shard"])), order)
    at = unused(numbered.columns, "__permuted")
    return (numbered.withColumn(at, permuted(F.col("row_number"), max(total, 1), seed))
            .withColumn("law", F.lit("rows"))
            .withColumn("shard", (F.col(at) % shards).cast("int"))
            .withColumn("slot", F.floor(F.col(at) / shards).cast("long"))
            .withColumn("grown_shard", F.lit(None).cast(T.IntegerType()))
            .drop(at))


def document_shards(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """Shards of documents in doc_id order (then checksum, then size).  Size is
    the text's UTF-8 bytes plus 1, the checksum CRC-32; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(slim, ["doc_id", "text_crc32", "size"], shards, seed)
