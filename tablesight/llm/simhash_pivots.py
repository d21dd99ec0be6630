"""SimHash near-duplicates by pivot distance tables (operator 8).

Fingerprint: XXH64 (seed 42) of every shingle of 3 words, repeats included; a
bit is set if it is set in over half of the hashes.  Two fingerprints link at
BITS or fewer differing bits; the classes are the connected components.

Search, over distinct fingerprints only (copies are counted once):

1. Dealing out.  Cut in six blocks, two linked fingerprints agree on at least
   three, so each is sent to the 20 groups of its block triples (about 32 bits).
2. Pivot table.  A task holds each group's Hamming distances to PIVOTS
   reference fingerprints.  Sorted by the first distance, only neighbours whose
   first coordinates differ by at most BITS are paired; a pair is discarded if
   any coordinate differs by more than BITS (the triangle inequality).
3. Survivors are verified by their differing bits.  A group hands on the links
   of a spanning forest, never all its pairs.

A group over GROUP rows is dealt again by block triples of the bits still free,
which fixes 48 bits: no such group can exceed 65,536 fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.llm.common import map_texts, packed
from tablesight.llm.components import components
from tablesight.session import scratch_table

SHINGLE, BITS, SEED = 3, 3, 42
CUTS = (0, 11, 22, 33, 44, 54, 64)
PIVOTS = 16
#: Largest group of distinct fingerprints searched before it is dealt again.
GROUP = 2048
#: Candidate pairs held at once.
PAIRS = 1 << 20


def text_fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of one text (no words: 0)."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = ([b" ".join(words)] if len(words) < SHINGLE
                else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    h = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint",
                     keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint as a signed long of the same bits."""
    def make():
        return lambda texts: [np.array([text_fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(df, text_col, T.StructType([T.StructField(out, T.LongType())]), make,
                     df.columns if keep is None else keep)


def pivots() -> np.ndarray:
    """The reference fingerprints: fixed 64-bit values from a multiplicative sequence."""
    return np.array([(i * 0x9E3779B97F4A7C15 ^ (i << 29)) % (1 << 64) for i in range(1, PIVOTS + 1)], np.uint64)


def block_masks(cuts=CUTS) -> list[int]:
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def triple_masks() -> list[int]:
    """Bits compared for each way to choose three of the six blocks."""
    return [sum(c) for c in combinations(block_masks(), 3)]


def finer_masks(mask: int) -> list[int]:
    """``mask`` plus each triple of six blocks of the bits it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [sum(1 << int(b) for b in p) for p in np.array_split(free, 6)]
    return [mask | sum(c) for c in combinations(parts, 3)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def dealt(rows: DataFrame, masks: Column) -> DataFrame:
    """One row per fingerprint and mask: (mask, key, fp)."""
    return (rows.select("fp", F.explode(masks).alias("mask"))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"))


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def linked_pairs(fps: np.ndarray, group: np.ndarray):
    """Index pairs (i, j) of verified links inside groups; rows sorted by group."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], group))
    fps, table = fps[order], table[order]
    rank = group[order].astype(np.int64) * 128 + table[:, 0]
    last = np.searchsorted(rank, rank + BITS, "right")  # stays inside the group: distances are at most 64
    width = last - np.arange(len(fps)) - 1
    begin = 0
    while begin < len(fps):
        total = np.cumsum(width[begin:])
        stop = begin + max(1, int(np.searchsorted(total, PAIRS, "right")))
        w = width[begin:stop]
        i = np.repeat(np.arange(begin, stop), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        near = np.ones(len(i), bool)
        for p in range(1, PIVOTS):
            near &= np.abs(table[i, p] - table[j, p]) <= BITS
        i, j = i[near], j[near]
        true = np.bitwise_count(fps[i] ^ fps[j]) <= BITS
        yield order[i[true]], order[j[true]]
        begin = stop


def spanning_links(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    forest, a, b = Forest(len(fps)), [], []
    for i, j in linked_pairs(fps, group):
        for x, y in zip(i.tolist(), j.tolist()):
            if forest.join(x, y):
                a.append(x)
                b.append(y)
    return fps[a], fps[b]


def search_groups(rows: DataFrame, limit: int | None) -> DataFrame:
    """Links (a, b) of the groups of ``dealt`` rows.  With a limit, the rows of a
    larger group come back unsearched, as (fp, null, mask)."""
    sorted_rows = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    schema = "a long, b long, mask long"

    def out(a, b, mask=None):
        nulls = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), nulls if b is None else pa.array(b.view(np.int64)),
             nulls if mask is None else pa.array(mask)], names=["a", "b", "mask"])

    def run(batches):
        mask, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fps = np.zeros(0, np.uint64)
        over = None  # (mask, key) of a group found too large, still arriving

        def search(n):  # the first n rows are whole groups
            new = np.append(True, (mask[1:n] != mask[:n - 1]) | (key[1:n] != key[:n - 1]))
            group = np.cumsum(new) - 1
            size = np.bincount(group)
            large = (size > limit)[group] if limit else np.zeros(n, bool)
            if large.any():
                yield out(fps[:n][large], None, mask[:n][large])
            some = (size > 1)[group] & ~large
            if some.any():
                yield out(*spanning_links(fps[:n][some], group[some]))

        for batch in batches:
            m, k, f = (np.asarray(batch.column(c)) for c in ("mask", "key", "fp"))
            f = f.view(np.uint64)
            if over is not None:  # rows of the large group go straight on
                n = int(np.argmin(np.append((m == over[0]) & (k == over[1]), False)))
                if n:
                    yield out(f[:n], None, m[:n])
                    m, k, f = m[n:], k[n:], f[n:]
                if not len(m):
                    continue
                over = None
            mask, key, fps = np.append(mask, m), np.append(key, k), np.append(fps, f)
            if not len(mask):
                continue
            same = (mask == mask[-1]) & (key == key[-1])
            done = int(np.argmax(same))  # rows before the last, perhaps unfinished, group
            if done:
                yield from search(done)
                mask, key, fps = mask[done:], key[done:], fps[done:]
            if limit and len(mask) > limit:
                yield out(fps, None, mask)
                over = (mask[0], key[0])
                mask, key, fps = mask[:0], key[:0], fps[:0]
        if len(mask):
            yield from search(len(mask))

    return sorted_rows.mapInArrow(run, schema)


def links(fingerprints: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (column fp): enough of them that the
    components are those of all pairs at BITS or fewer differing bits."""
    triples = triple_masks()
    first = scratch_table(search_groups(
        dealt(fingerprints, F.array(*[F.lit(signed(m)).cast("long") for m in triples])), GROUP), "pairs")
    finer = F.array()
    for m in triples:
        finer = F.when(F.col("mask") == signed(m), F.array(
            *[F.lit(signed(x)).cast("long") for x in finer_masks(m)])).otherwise(finer)
    deferred = first.filter("b is null").select(F.col("a").alias("fp"), finer.alias("masks")).distinct()
    second = search_groups(dealt(deferred, F.col("masks")), None)
    return first.filter("b is not null").select("a", "b").union(second.select("a", "b"))


def classes(fingerprinted: DataFrame, fp_col: str = "fp") -> DataFrame:
    """(fp, root) for every distinct fingerprint; root names its class."""
    distinct = fingerprinted.select(F.col(fp_col).alias("fp")).distinct()
    roots = components(links(distinct))
    return (distinct.join(roots, distinct["fp"] == roots["node"], "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, the
    least doc_id of its class (null only if every doc_id there is null).

    Null and empty texts have fingerprint zero and link like any other; repeated
    rows come back repeated; an empty table gives an empty result.
    """
    slim = scratch_table(with_fingerprint(docs.select("doc_id", "text"), out="fp", keep=["doc_id"]), "fingerprints")
    least = slim.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = classes(slim).join(least, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # one row per class on this side; a hot fingerprint's documents may be split by the planner
    by_fp = scratch_table(named.join(ids, "root").select("fp", "component_id"), "classes")
    return slim.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents, one of each class: that of the least id (nulls last), then
    of the least row hash; of rows alike in every column, one."""
    row = F.xxhash64(*[docs[c] for c in docs.columns])
    keyed = docs.select(docs[id_col].alias("__id"), row.alias("__row"), docs[text_col].alias("__body"))
    slim = scratch_table(with_fingerprint(keyed, "__body", "fp", ["__id", "__row"]), "fingerprints")
    rows = slim.groupBy("fp", "__id", "__row").agg(F.count(F.lit(1)).alias("__n"))
    first = F.min(F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__row", "__n"))
    by_fp = rows.groupBy("fp").agg(first.alias("w"))
    best = (by_fp.join(classes(slim), "fp").groupBy("root")
            .agg(F.min("w").alias("w")).select("w.__id", "w.__row", "w.__n"))
    best = scratch_table(best.withColumnsRenamed({"__id": "__best", "__row": "__best_row"}), "kept")
    whole = packed(docs).withColumns({"__id": F.col("__doc").getField(id_col), "__row": F.xxhash64(
        *[F.col("__doc").getField(c) for c in docs.columns])})
    both = whole.join(best, F.col("__row").eqNullSafe(F.col("__best_row")) & F.col("__id").eqNullSafe(F.col("__best")))
    single = both.filter("__n = 1")
    repeated = both.filter("__n > 1").dropDuplicates(["__best", "__best_row"])
    return single.union(repeated).select("__doc.*")
