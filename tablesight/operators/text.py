"""Text statistics, keywords and extractive summaries.

A document is one row and one unit of work: what concerns a single document
(its sentences, its own term weights) is computed inside its row in Arrow
batches, without a shuffle; only corpus counts are grouped.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.functions.scalars import line_count
from tablesight.functions.stop_words import ENGLISH
from tablesight.operators.skew import hot_split_join
from tablesight.session import scratch_table

WORD_RE = r"[\p{L}\p{N}_]+"
# Fixed value: a token is a run of two or more word characters (letters, digits,
# underscore), lower-cased first.
PY_TOKEN = r"\w{2,}"


def text_stats(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Characters, ``\\w+`` words and lines (as ``str.splitlines``) per row."""
    t = F.col(text)
    return df.select(*(keys or []),
                     F.length(t).alias("chars"),
                     F.regexp_count(t, F.lit(WORD_RE)).alias("words"),
                     line_count(t).alias("lines"))


def _idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


#: Characters of text that a task takes apart at once.
SLICE_CHARS = 8 << 20
#: Terms whose weights every task is given, and their greatest length: some twenty
#: megabytes, and never more than a hundred.
KNOWN_TERMS, KNOWN_CHARS = 1 << 20, 64
#: Counts in one packed word: a term number times COUNTS, plus a count below it; a
#: larger count takes several words.  KNOWN_TERMS numbers fill 31 bits.
COUNTS = 1 << 11
# Fixed value: what separates tokens.
SEPARATOR_RE = r"[^\p{L}\p{N}_]+"


def _slices(batches):
    """Record batches cut to about SLICE_CHARS of their last column (one row at least)."""
    for batch in batches:
        upto = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(-1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            limit = (upto[start - 1] if start else 0) + SLICE_CHARS
            stop = max(start + 1, int(np.searchsorted(upto, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _terms_of(texts: pa.Array, stop: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, and for each row and term of it: row, term number, count)
    of lower-case texts, stop words and single characters left out."""
    tokens = pa.compute.split_pattern_regex(pa.compute.fill_null(texts, ""), SEPARATOR_RE)
    coded = pa.compute.list_flatten(tokens).dictionary_encode()
    terms = coded.dictionary
    wanted = pa.compute.and_(pa.compute.greater(pa.compute.utf8_length(terms), 1),
                             pa.compute.invert(pa.compute.is_in(terms, stop))).to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy().astype(np.int64)
    row = pa.compute.list_parent_indices(tokens).to_numpy().astype(np.int64)
    kept = wanted[code]
    at, count = np.unique(row[kept] * max(1, len(terms)) + code[kept], return_counts=True)
    return terms, at // max(1, len(terms)), at % max(1, len(terms)), count


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(term, total, df): occurrences and rows of every non-stop-word term, and a
    row with a null term: how many rows have text.  Tasks count slices of rows; what
    is shuffled is a record per slice and term."""
    def run(batches):
        stop = pa.array(ENGLISH)
        for part in _slices(batches):
            terms, _, code, count = _terms_of(part.column(0), stop)
            rows = np.bincount(code, minlength=len(terms))
            total = np.bincount(code, weights=count, minlength=len(terms)).astype(np.int64)
            there = rows > 0
            texts = pa.compute.sum(pa.compute.greater(pa.compute.binary_length(part.column(0)), 0)).as_py() or 0
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([terms.filter(pa.array(there)), pa.nulls(1, pa.string())]),
                 pa.array(np.append(total[there], 0)), pa.array(np.append(rows[there], texts))], names=["term", "total", "df"])

    parts = df.select(F.lower(F.col(text)).alias("t")).mapInArrow(run, "term string, total long, df long")
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def _packed(number: np.ndarray, count: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, their rows) of term numbers and counts."""
    words = -(-count // (COUNTS - 1))
    each = np.repeat(np.arange(len(count)), words)
    last = np.cumsum(words) - 1
    part = np.full(len(each), COUNTS - 1)
    part[last] = count - (words - 1) * (COUNTS - 1)
    return (number[each] * COUNTS + part).astype(np.int32), row[each]


class Weights:
    """Terms with their weights, found by hash and then compared."""

    def __init__(self, terms: pa.Array, weight: np.ndarray):
        hashes = hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.terms, self.weight = hashes[order], terms.take(pa.array(order)), weight[order]

    def of(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(weight, number of the term), NaN and -1 for those without one."""
        if not len(self.hashes) or not len(terms):
            return np.full(len(terms), np.nan), np.full(len(terms), -1)
        hashes = hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)
        at = np.searchsorted(self.hashes, hashes)
        number = np.full(len(terms), -1)
        while True:   # terms of one hash lie side by side
            at = np.minimum(at, len(self.hashes) - 1)
            same = pa.compute.equal(self.terms.take(pa.array(at)), terms).to_numpy(zero_copy_only=False)
            number = np.where(same & (number < 0), at, number)
            again = (number < 0) & (self.hashes[at] == hashes) & (at + 1 < len(self.hashes))
            if not again.any():
                return np.where(number < 0, np.nan, self.weight[number]), number
            at = at + again


def _weighed(df: DataFrame, text: str, known, others: bool) -> DataFrame:
    """Rows weighed where they lie, as three kinds of records:

    * (term, value): the scores' parts of rows whose terms all have a weight,
      added up by slice;
    * (row, value, words): the counts of each other row's terms with a weight, four
      bytes each (see ``_packed``), and the sum of their weights' squares;
    * (row, term, tf): that row's terms without a weight.

    ``known`` is a broadcast of the Weights.  With ``others`` false, terms without a
    weight do not count, and all rows are of the first kind."""
    source = df.select(F.monotonically_increasing_id().alias("row"), F.lower(F.col(text)).alias("t"))
    form = pa.schema([("row", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("value", pa.float64()),
                      ("words", pa.list_(pa.int32()))])

    def record(n, **columns):
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in form], schema=form)

    def run(batches):
        stop = pa.array(ENGLISH)
        for part in _slices(batches):
            terms, row, code, count = _terms_of(part.column(1), stop)
            each, number = known.value.of(terms)
            w = each[code] * count
            new = np.isnan(w)
            if not others:
                row, code, count, w, new = (x[~new] for x in (row, code, count, w, new))
            square = np.bincount(row, weights=np.where(new, 0.0, w) ** 2, minlength=part.num_rows)
            still = (np.bincount(row, weights=new, minlength=part.num_rows) > 0)[row]
            done = ~still
            there = np.bincount(code[done], minlength=len(terms)) > 0
            score = np.bincount(code[done], weights=w[done] / np.sqrt(square[row[done]]), minlength=len(terms))
            yield record(int(there.sum()), term=terms.filter(pa.array(there)), value=pa.array(score[there]))
            if still.any():
                ids = part.column(0)
                rare, held = still & new, still & ~new
                yield record(int(rare.sum()), row=ids.take(pa.array(row[rare])), term=terms.take(pa.array(code[rare])),
                             tf=pa.array(count[rare]))
                rows = np.unique(row[still])
                words, of = _packed(number[code[held]], count[held], row[held])
                ends = np.concatenate([[0], np.searchsorted(of, rows, side="right")]).astype(np.int32)
                yield record(len(rows), row=ids.take(pa.array(rows)), value=pa.array(square[rows]),
                             words=pa.ListArray.from_arrays(ends, pa.array(words)))

    return source.mapInArrow(run, "row long, term string, tf long, value double, words array<int>")


def _finished(rows: DataFrame, known) -> DataFrame:
    """(term, value): the scores' parts of rows with ``square`` and ``words`` (see
    ``_weighed``), and ``rare``: terms that are not ``known``, with their weights."""
    def run(batches):
        weight = known.value.weight
        total = np.zeros(len(weight))   # bounded as the weights are
        for batch in batches:
            rare, words = batch.column("rare"), batch.column("words")
            row, pairs = pa.compute.list_parent_indices(rare).to_numpy(), pa.compute.list_flatten(rare)
            term, w = pairs.field("term"), pairs.field("w").to_numpy()
            square = batch.column("square").to_numpy() + np.bincount(row, w * w, batch.num_rows)
            norm = np.sqrt(square)
            yield pa.RecordBatch.from_arrays([term, pa.array(w / norm[row])], names=["term", "value"])
            of, word = pa.compute.list_parent_indices(words).to_numpy(), pa.compute.list_flatten(words).to_numpy()
            number = word // COUNTS
            total += np.bincount(number, weight[number] * (word % COUNTS) / norm[of], len(weight))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([known.value.terms.take(pa.array(there)), pa.array(total[there])], names=["term", "value"])

    return rows.select("square", "words", "rare").mapInArrow(run, "term string, value double")


def _best(parts: DataFrame, k: int) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("value").alias("score")).orderBy(F.desc("score"), "term").limit(k)


def top_keywords(df: DataFrame, text: str = "text", max_features: int | None = None, k: int = 25) -> DataFrame:
    """The k terms with the largest summed TF-IDF over all rows.

    Weight: raw count x (ln((1+N)/(1+df)) + 1), each row L2 normalised; summed
    per term.  Stop words and rows with empty text do not count.  By default
    every term is scored.  The terms' row counts are partial sums.  The weights of
    the KNOWN_TERMS most frequent terms go to every task, which finishes the rows
    that have no others.  Of the remaining rows the rarer terms travel one by one, to
    meet their row counts in a split join, and back to their rows; the others of a
    row travel once, packed to four bytes a term, to be added up where the row's norm
    is known.  No term is one task's.  With ``max_features`` the vocabulary is that
    many terms of largest total count (ties by term), and all rows are finished where
    they lie.
    """
    counted = scratch_table(vocabulary(df, text), "vocabulary")
    texts = counted.filter("term is null").select("df").first()
    n = texts[0] if texts else 0
    counted = counted.filter("term is not null")
    if max_features is not None:
        most = counted.orderBy(F.desc("total"), "term").limit(max_features)
    else:
        most = counted.filter(F.length("term") <= KNOWN_CHARS).orderBy(F.desc("df"), "term").limit(KNOWN_TERMS)
    found = most.select("term", "df").toArrow().combine_chunks()
    rows = found.column("df").to_numpy()
    weights = Weights(pa.array(found.column("term").to_pylist(), pa.string()), np.log((1.0 + n) / (1 + rows)) + 1)
    known = df.sparkSession.sparkContext.broadcast(weights)   # bounded by KNOWN_TERMS, or by what was asked for
    if max_features is not None or len(rows) == counted.count():   # no row has an unknown term that counts
        return _best(_weighed(df, text, known, others=False).select("term", "value"), k)
    parts = scratch_table(_weighed(df, text, known, others=True), "weighed")
    done = parts.filter("row is null").select("term", "value")
    rare = hot_split_join(parts.filter("tf is not null").select("row", "term", "tf"), counted.select("term", "df"), ["term"], "df")
    weight = F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("rare"))   # a row's own terms
    opened = parts.filter("words is not null").select("row", F.col("value").alias("square"), "words").join(rare, "row")
    return _best(done.unionByName(_finished(opened, known)), k)


def split_sentences(text: str) -> list[str]:
    """Pieces after . ! ? and blanks, trimmed, empties dropped (F8)."""
    return [p for p in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text.strip())) if p]


def summarize(text: str, stop: frozenset, max_sentences: int = 8, max_features: int | None = None,
              short_chars: int | None = None) -> str:
    """The best sentences of one text in their order (see extractive_summary)."""
    parts = split_sentences(text)
    if len(parts) <= 3:
        return text if short_chars is None else text[:short_chars]
    counts = []
    for p in parts:
        toks = [t for t in re.findall(PY_TOKEN, p.lower()) if t not in stop]
        counts.append(Counter(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]))
    df = Counter(t for c in counts for t in c)
    if max_features is not None:
        total: Counter = Counter()
        for c in counts:
            total.update(c)
        kept = set(sorted(total, key=lambda t: (-total[t], t))[:max_features])
        counts = [Counter({t: n for t, n in c.items() if t in kept}) for c in counts]
    idf = {t: _idf(len(parts), n) for t, n in df.items()}
    scores = []
    for c in counts:
        w = [n * idf[t] for t, n in c.items()]
        square = math.sqrt(math.fsum(x * x for x in w))
        # compared at 1e-9, so summation order cannot reorder equal sentences
        scores.append(round(math.fsum(w) / square, 9) if square else 0.0)
    best = sorted(sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:max_sentences])
    return " ".join(parts[i] for i in best)


def extractive_summary(df: DataFrame, text: str = "text", keys: list[str] | None = None,
                       max_sentences: int = 8, max_features: int | None = None,
                       short_chars: int | None = None) -> DataFrame:
    """Per document, sentences are scored by the sum of their
    L2-normalised TF-IDF (unigrams and bigrams after stop words, idf over the
    document's sentences); the best ``max_sentences`` are joined in their
    original order.  Documents with three sentences or fewer come back whole.
    ``max_features`` keeps only that many of a document's most frequent terms,
    ``short_chars`` cuts short documents; neither does by default.

    Each document is summarised inside its own row, so there is no shuffle and
    the rows' ``keys`` need not be unique.  Null text gives null.
    """
    keys = keys or []
    stop = frozenset(ENGLISH)
    source = df.select(*keys, F.col(text).alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keys], T.StructField("summary", T.StringType())])

    def run(batches):
        for batch in batches:
            out = [None if t is None else summarize(t, stop, max_sentences, max_features, short_chars)
                   for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(out, pa.string())],
                                             names=[*keys, "summary"])

    return source.mapInArrow(run, schema)
