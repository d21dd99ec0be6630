"""Benchmark decontamination by q-gram lemma filtering (operator 10).

Benchmark items are cut into overlapping segments of SEGMENT characters.  A
document leaks an item if some region of it is within ``len // EDIT_SHARE``
edits of a segment.  Such a region shares at least
``len - Q + 1 - Q * edits`` of the segment's character q-grams, all of them on
diagonals (document offset minus segment offset) at most ``edits`` apart.  So:

1. every character q-gram of the documents is looked up among the segments';
2. stretches with fewer hits than any segment needs are passed over;
3. the other hits are counted in diagonal bands of width 2*BAND, one starting
   every BAND diagonals, so that any such set of diagonals lies in one band;
4. bands with enough distinct segment offsets are verified by a banded
   alignment, free to start and end anywhere in the region;
5. where no segment of a longer item is found, the same bound and alignment are
   put to every window of SEGMENT characters of the item, at any offset, so
   that a passage between segment starts is found as well;
6. a passage too short for that counts if PASSAGE characters of it are verbatim:
   the bound of no edits, all their q-grams in a row on one diagonal.

Items under MIN_ITEM characters have an index of their own, as their bounds are
low: the edits of such an item are as above where its bound is positive, else
none.  An item of fewer than Q characters leaks only where it is the whole text.

Texts are compared in lower case with white space runs as one space.  The
documents are scanned where they lie, with no shuffle.  The benchmark is a
stated query set: it is read in blocks of BLOCK_CHARS characters, each shipped
with one pass over the documents, so a task holds one block at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.llm.common import map_texts, passed_columns, unused

Q, SEGMENT, EDIT_SHARE = 8, 96, 12
BAND = 16  # over the largest edit budget, SEGMENT // EDIT_SHARE
#: Least verbatim passage of a longer item that is a leak, in normalised characters.
PASSAGE = 40
#: Items shorter than this (after normalising) are searched by an index of their own.
MIN_ITEM = 32
BLOCK_CHARS = 1 << 20
FILTER_BITS = 22

HIT = T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("segments", T.IntegerType()),
    T.StructField("item_segments", T.IntegerType()), T.StructField("edits", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def normalized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of code points, with more separators between two
    than any edit budget; each character's offset in its own text; and where
    each text begins."""
    folded = []
    for t in texts:
        low = t.lower()
        if len(low) != len(t):  # a few letters grow when lowered
            low = "".join(c.lower()[0] for c in t)
        folded.append(low.replace("\0", " "))
    gap = "\0" * BAND
    points = np.frombuffer((gap + gap.join(folded) + gap).encode("utf-32-le"), np.uint32).copy()
    white = ((points <= 32) | (points == 0x85) | (points == 0xA0)) & (points != 0)
    points[white] = 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    lengths = np.array([len(t) for t in folded], np.int64)
    raw_starts = BAND + np.concatenate([[0], np.cumsum(lengths + BAND)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    at = np.flatnonzero(keep)
    return points[keep], at, raw_starts.astype(np.int64)


def qgram_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the Q = 8 characters from each position."""
    h = points.astype(np.uint64)
    factor = 0x9E3779B97F4A7C15
    for width in (1, 2, 4):
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
    return h


def filter_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FILTER_BITS)


class SegmentIndex:
    """Sorted q-gram hashes of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        by_text: dict[bytes, list] = {}
        for item_id, text in items:
            points, _, _ = normalized([text.strip()])
            body = points[BAND:len(points) - BAND]
            if len(body):
                by_text.setdefault(body.tobytes(), []).append(item_id)
        self.ids, self.segments, self.owner, self.count, self.bodies = [], [], [], [], []
        self.whole: dict[bytes, list] = {}  # items without a q-gram
        for body, ids in by_text.items():
            points = np.frombuffer(body, np.uint32)
            if len(points) < Q:
                self.whole[body] = ids
                continue
            last = max(0, len(points) - SEGMENT)
            starts = sorted({*range(0, last + 1, SEGMENT // 2), last})
            self.ids.append(ids)
            self.bodies.append(points)
            self.count.append(len(starts))
            for s in starts:
                self.segments.append(points[s:s + SEGMENT])
                self.owner.append(len(self.ids) - 1)
        self.length = np.array([len(s) for s in self.segments], np.int64)
        self.budget = self.length // EDIT_SHARE
        self.budget[self.length - Q + 1 <= Q * self.budget] = 0
        self.needed = self.length - Q + 1 - Q * self.budget
        grams = [qgram_hashes(s) for s in self.segments]
        if not grams:
            return
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.segment_of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset_of = np.concatenate([np.arange(len(g)) for g in grams])[order]
        # the q-grams of longer items at their offsets in the item; segments cover an item, so keys hold them all
        longer = [i for i, body in enumerate(self.bodies) if len(body) > PASSAGE]
        grams = [qgram_hashes(self.bodies[i]) for i in longer]
        slots = np.searchsorted(self.keys, np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        order = np.argsort(slots, kind="stable")
        self.item_first = np.searchsorted(slots[order], np.arange(len(self.keys) + 1))
        self.item_of = np.repeat(np.array(longer, np.int64), [len(g) for g in grams])[order]
        self.item_offset_of = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[filter_slot(self.keys)] = True

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index in keys) of the q-grams that lie in dense stretches."""
        none = (np.zeros(0, np.int64),) * 2
        hashes = qgram_hashes(points)
        at = np.flatnonzero(self.seen[filter_slot(hashes)])
        if not len(at):
            return none
        slot = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        real = self.keys[slot] == hashes[at]
        at, slot = at[real], slot[real]
        least = int(self.needed.min())
        span = int((self.length + self.budget).max())
        if len(at) < least:
            return none
        # a hit counts if it lies in some run of `least` hits no longer than a region
        tight = at[least - 1:] - at[:len(at) - least + 1] <= span
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, np.flatnonzero(tight), 1)
        np.add.at(edge, np.flatnonzero(tight) + least, -1)
        dense = np.cumsum(edge[:-1]) > 0
        return at[dense], slot[dense]

    @staticmethod
    def postings(at: np.ndarray, slot: np.ndarray, first: np.ndarray, of: np.ndarray, offset_of: np.ndarray) -> tuple:
        """(owner, offset in the owner, position) of every pair of a hit and an equal q-gram."""
        copies = first[slot + 1] - first[slot]
        where = np.repeat(at, copies)
        entry = np.repeat(first[slot], copies) + np.arange(len(where)) - np.repeat(np.cumsum(copies) - copies, copies)
        return of[entry], offset_of[entry], where

    @classmethod
    def banded(cls, *hits: np.ndarray) -> tuple:
        """The hits' postings in both their bands, by owner, band, offset and
        position, with marks where a band and where an offset begins."""
        owner, offset, where = cls.postings(*hits)
        band = (where - offset) // BAND
        owner, offset, where = np.tile(owner, 2), np.tile(offset, 2), np.tile(where, 2)
        band = np.concatenate([band, band - 1])
        order = np.lexsort((where, offset, band, owner))
        owner, offset, where, band = owner[order], offset[order], where[order], band[order]
        new_band = np.append(True, (owner[1:] != owner[:-1]) | (band[1:] != band[:-1]))
        new_offset = new_band | np.append(True, offset[1:] != offset[:-1])
        return owner, offset, where, band, new_band, new_offset

    def candidates(self, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(segment, first diagonal of the band, first and last hit) of each
        band that reaches its segment's bound."""
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        segment, offset, where, band, new_band, new_offset = self.banded(at, slot, self.first, self.segment_of, self.offset_of)
        start = np.flatnonzero(new_band)
        shared = np.add.reduceat(new_offset.astype(np.int64), start)
        lo, hi = np.minimum.reduceat(where, start), np.maximum.reduceat(where, start) + Q
        enough = shared >= self.needed[segment[start]]
        start = start[enough]
        return segment[start], band[start] * BAND, lo[enough], hi[enough]

    def windows(self, at: np.ndarray, slot: np.ndarray, known) -> tuple[np.ndarray, ...]:
        """(item, offset in the item, first diagonal of the band, first and last
        hit) of each window of SEGMENT characters whose hits in a band reach the
        bound; ``known(position, item)`` tells bands to leave out."""
        none = (np.zeros(0, np.int64),) * 5
        some = self.item_first[slot + 1] > self.item_first[slot]
        at, slot = at[some], slot[some]
        if not len(at):
            return none
        item, offset, where, band, new_band, new_offset = self.banded(at, slot, self.item_first, self.item_of, self.item_offset_of)
        needed = SEGMENT - Q + 1 - Q * (SEGMENT // EDIT_SHARE)
        group = np.cumsum(new_band) - 1
        first = np.flatnonzero(new_offset)  # one row per distinct offset of a band
        if len(first) < needed:
            return none
        item, offset, band, group_of = item[first], offset[first], band[first], group[first]
        last = np.append(first[1:], len(where)) - 1
        i = np.arange(len(first) - needed + 1)
        j = i + needed - 1
        i = i[(group_of[i] == group_of[j]) & (offset[j] - offset[i] <= SEGMENT - Q)]
        size = np.array([len(b) for b in self.bodies], np.int64)
        i = i[size[item[i]] > SEGMENT]
        i = i[~known(where[first[i]], item[i])]
        if not len(i):
            return none
        size = size[item[i]]
        low = np.maximum(offset[i + needed - 1] - (SEGMENT - Q), 0)
        high = np.minimum(offset[i], size - SEGMENT)
        low = np.minimum(low, high)
        ranges = high - low + 1
        row = np.repeat(i, ranges)
        begin = np.repeat(low, ranges) + np.arange(len(row)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
        _, keep = np.unique(group_of[row] * (1 + int(size.max())) + begin, return_index=True)
        row, begin = row[keep], begin[keep]
        return item[row], begin, band[row] * BAND, where[first[row]], where[last[row + needed - 1]] + Q

    def verbatim(self, points: np.ndarray, at: np.ndarray, slot: np.ndarray):
        """(item, first and last position) of each stretch of PASSAGE characters
        or more that equals a part of a longer item."""
        item, offset, where = self.postings(at, slot, self.item_first, self.item_of, self.item_offset_of)
        if not len(where):
            return
        order = np.lexsort((where, where - offset, item))
        item, offset, where = item[order], offset[order], where[order]
        begins = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (np.diff(where) != 1) | (np.diff(offset) != 1)))
        size = np.diff(np.append(begins, len(where))) + Q - 1
        for b, n in zip(begins[size >= PASSAGE].tolist(), size[size >= PASSAGE].tolist()):
            if np.array_equal(points[where[b]:where[b] + n], self.bodies[item[b]][offset[b]:offset[b] + n]):
                yield int(item[b]), int(where[b]), int(where[b]) + n

    def edits(self, points: np.ndarray, segment: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Edit distance of each segment to the nearest region in its band."""
        return self.distances(points, self.length[segment], lambda rows: np.stack([self.segments[s] for s in segment[rows]]), diagonal)

    @staticmethod
    def distances(points: np.ndarray, lengths: np.ndarray, patterns, diagonal: np.ndarray) -> np.ndarray:
        slack = BAND
        width = 2 * BAND + 2 * slack
        padded = np.concatenate([np.zeros(width, points.dtype), points, np.zeros(width + SEGMENT, points.dtype)])
        out = np.empty(len(lengths), np.int64)
        columns = np.arange(width)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for i in range(0, len(rows), 4096):
                part = rows[i:i + 4096]
                pattern = patterns(part)
                first = diagonal[part] - slack + width  # document position under column 0, row 0
                cost = np.zeros((len(part), width), np.int32)
                for r in range(length):
                    here = padded[(first + r)[:, None] + columns]
                    step = cost + (here != pattern[:, r:r + 1])
                    step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                    cost = np.minimum.accumulate(step - columns, axis=1) + columns
                out[part] = cost.min(axis=1)
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its leaks: one tuple (fields of HIT) per item."""
        result: list[list[tuple]] = [[] for _ in texts]
        if self.whole:
            for found, t in zip(result, texts):
                points, at, _ = normalized([(t or "").strip()])
                for item_id in self.whole.get(points[BAND:len(points) - BAND].tobytes(), []):
                    begin = len(t) - len(t.lstrip())
                    found.append((item_id, 1, 1, 0, begin, begin + len(t.strip())))
        if not self.segments:
            return result
        points, at, starts = normalized([t or "" for t in texts])
        near = self.hits(points)
        segment, diagonal, lo, hi = self.candidates(*near)
        edits = self.edits(points, segment, diagonal)
        good = np.flatnonzero(edits <= self.budget[segment])

        def text_of(position: np.ndarray) -> np.ndarray:
            return np.searchsorted(starts, at[position], "right") - 1

        text = text_of(lo)
        found: dict[tuple, list] = {}
        for g in good.tolist():
            found.setdefault((int(text[g]), self.owner[segment[g]]), []).append(
                (int(segment[g]), int(edits[g]), int(lo[g]), int(hi[g])))
        pairs = np.array(sorted(t * len(self.ids) + i for t, i in found), np.int64)
        item, begin, diagonal, lo, hi = self.windows(*near, lambda position, i: np.isin(
            text_of(position) * len(self.ids) + i, pairs))
        if len(item):
            edits = self.distances(points, np.full(len(item), SEGMENT), lambda rows: np.stack(
                [self.bodies[i][b:b + SEGMENT] for i, b in zip(item[rows], begin[rows])]), diagonal + begin)
            text = text_of(lo)
            for g in np.flatnonzero(edits <= SEGMENT // EDIT_SHARE).tolist():
                found.setdefault((int(text[g]), int(item[g])), []).append((None, int(edits[g]), int(lo[g]), int(hi[g])))
        known = {divmod(p, len(self.ids)) for p in pairs.tolist()}
        for i, lo, hi in self.verbatim(points, *near):
            t = int(text_of(np.array(lo)))
            if (t, i) not in known:
                found.setdefault((t, i), []).append((None, 0, lo, hi))
        for (t, i), leaks in sorted(found.items()):
            begins = int(at[min(x[2] for x in leaks)] - starts[t])
            ends = int(at[max(x[3] for x in leaks) - 1] - starts[t]) + 1
            matched = len({x[0] for x in leaks} - {None})
            for item_id in self.ids[i]:
                result[t].append((item_id, matched, self.count[i], min(x[1] for x in leaks), begins, ends))
        return result


def searcher(items: list[tuple[int | None, str]]):
    """``find`` over short and other items, each with their own index."""
    parts: tuple[list, list] = [], []
    for item_id, text in items:
        parts[len(" ".join(text.split())) < MIN_ITEM].append((item_id, text))
    indexes = [SegmentIndex(part) for part in parts if part]
    return lambda texts: [sum(hits, []) for hits in zip(*(index.find(texts) for index in indexes))]


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items of the query set, a block at a time."""
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull())
    block, held = [], 0
    for item_id, text in rows.toLocalIterator():
        if block and held + len(text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += len(text)
    if block:
        yield block


def with_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id",
               item_text_col: str = "text", out: str = "leaks", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``: an array with one entry per benchmark item the text leaks.

    Null and empty texts leak nothing; null items are no items; equal items are
    each reported; rows pass through, so repeated rows repeat and an empty table
    (or an empty benchmark) gives no leaks.
    """
    kept = passed_columns(df.select(*keep) if keep is not None else df, [out])
    more = unused([*df.columns, out], "__more")
    result = df.select(*dict.fromkeys([*kept, text_col])).withColumn(out, F.array().cast(T.ArrayType(HIT)))
    for block in blocks(benchmark, id_col, item_text_col):
        def make(block=block):
            find = searcher(block)
            return lambda texts: [find(texts)]

        field = T.StructType([T.StructField(more, T.ArrayType(HIT))])
        result = map_texts(result, text_col, field, make, result.columns)
        result = result.withColumn(out, F.concat(out, more)).drop(more)
    return result.select(*kept, out)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it leaks: the item's matched and total
    segments (0 matched: a passage between segment starts or shorter than one), the fewest edits, and
    the region as code points of the text."""
    leaks = with_leaks(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return leaks.select("doc_id", F.inline("leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with their columns as they came."""
    out = unused(docs.columns, "__leaks")
    leaks = with_leaks(docs, benchmark, out=out)
    return leaks.filter(F.size(out) == 0).select(*docs.columns)
