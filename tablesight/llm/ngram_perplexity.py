"""Quality rules with n-gram perplexity bands (operator 6).

A 5-gram modified Kneser-Ney model over bytes (case, signs and parts of
multi-byte characters as they are) is counted by Spark for each language over all
documents.  An n-gram's key is its five bytes in one long, a hash without
collisions; tasks count slices, and partial sums are shuffled.

The model stays in tables of the shared folder.  A language's n-grams are cut
into parts of about ``PART_KEYS`` by the two bytes before the last, on which every
context of three or more symbols ends, so that a part is a model of its own for
its keys: sorted key arrays with probabilities and sorted contexts with back-off
weights, found by bisection.  (Contexts of one byte and none have at most 65,792
n-grams a language and are repeated in each part.)  Spark builds each part in a
task of its own; a scoring task reads the parts that its texts ask for and keeps
``CACHE_BYTES`` of them.  Nothing of the model passes through the driver.

A document's perplexity is 2 to its mean bits per byte under its language's
model.  The first model is fitted to all documents; the second one only to those
within ``TRIM`` robust standard deviations (1.4826 times the median absolute
deviation) of the median, both under the first model and under the language's
plain byte frequencies, so that junk does not teach the model to expect junk (a
5-gram model soon expects a style that even few documents have; the frequencies of
bytes give it away).  The bands come from the second model's values of all documents of
a language, apart by length (powers of two words), since the spread falls with
it: the median less and plus WIDTH robust deviations.  Equal values count once,
so that copies make no band narrow.  Documents outside are rejected, as are those
that fail the base rules.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.llm.common import passed_columns, shared_uri, slices, unused
from tablesight.session import own_scratch, scratch_table

ORDER, SYMBOLS = 5, 256
TRIM, WIDTH = 2.0, 8.0
LEAST_DISCOUNT = 0.1
#: Half-width of a band, in bits per byte, where all values are alike.
LEAST_WIDTH = 0.25
#: Documents that a length class needs for a band of its own; smaller ones join the
#: next shorter one that has them.
MIN_CLASS = 50
PART_KEYS = 1 << 20
#: Bytes of model parts that a Python worker keeps, beyond the one in use.
CACHE_BYTES = 128 << 20
WINDOW, MIN_WORDS = 8, 20
#: Text bytes counted or scored at once; distinct n-grams are looked up once each.
AT_ONCE = 2 << 20
SPACE = b" \t\n\r\x0b\x0c"
SIGNS = b"#*$%&|<>"

BASE = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def keys_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram key at every byte of the texts, each begun by white space, and
    the texts' lengths."""
    pad = b" " * (ORDER - 1)
    s = np.frombuffer(b"".join(pad + b for b in raw), np.uint8).astype(np.int64)
    lengths = np.array([len(b) for b in raw], np.int64)
    key = s.copy()
    for i in range(1, ORDER):
        key[ORDER - 1:] |= s[ORDER - 1 - i:len(s) - i] << (8 * i)
    real = np.ones(len(s), bool)
    starts = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    for i in range(ORDER - 1):
        real[starts + i] = False
    return key[real], lengths


def part_of(key, parts: int):
    """The part that holds a key; works on arrays and on columns."""
    if isinstance(key, Column):
        return F.pmod(F.shiftright(F.shiftright(key, 8).bitwiseAND(0xFFFF) * 40503, 4), F.lit(parts)).cast("int")
    return (((key >> 8 & 0xFFFF) * 40503 >> 4) % parts).astype(np.int32)


def length_class(n_words: int) -> int:
    return int(math.log2(max(n_words, 1)))


def by_language(part: pa.RecordBatch, lang_col: str, text_col: str) -> dict[str, tuple[list[int], list[bytes]]]:
    """Row numbers and texts of the rows that have any text."""
    out: dict[str, tuple[list[int], list[bytes]]] = {}
    for i, (lang, text) in enumerate(zip(part.column(lang_col).to_pylist(), part.column(text_col).to_pylist())):
        if text:
            rows, raw = out.setdefault(lang, ([], []))
            rows.append(i)
            raw.append(text.encode())
    return out


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", within=None) -> DataFrame:
    """(lang, key, n) over all documents, or over those ``within`` (a ``Trim``)
    their bands; a null language counts as ''."""
    source = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        for part in slices(batches, "text", AT_ONCE):
            for lang, (_, raw) in by_language(part, "lang", "text").items():
                keys, lengths = keys_of(raw)
                if within is not None:
                    kept = within.kept(lang, raw, keys, lengths)
                    keys = keys[np.repeat(kept, lengths)]
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))],
                    names=["lang", "key", "n"])

    counted = source.mapInArrow(run, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def discounts(counts_of: dict[int, int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from how many n-grams occur
    once, twice, three and four times."""
    n1, n2, n3, n4 = (counts_of.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    # never none, or a context would leave nothing for what it has not seen
    return np.clip(d, [0, LEAST_DISCOUNT, LEAST_DISCOUNT, LEAST_DISCOUNT], [0, 1, 2, 3])


class KneserNey:
    """An interpolated model, lowest order first: for each order sorted n-gram keys
    with probabilities and sorted contexts with back-off weights.  ``grams`` has
    (keys, counts) of each order, ``discount`` its discounts; of the higher orders
    both may be those of one part."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], discount: list[np.ndarray]):
        self.levels: list[tuple] = []
        for (key, count), by_count in zip(grams, discount):
            if not len(key):   # a part without n-grams of this order
                self.levels.append((key, np.zeros(0), key, np.zeros(0)))
                continue
            order = np.argsort(key)
            key, count = key[order], count[order].astype(np.float64)
            d = by_count[np.minimum(count, 3).astype(int)]
            context, first = np.unique(key >> 8, return_index=True)
            total = np.add.reduceat(count, first)
            weight = np.add.reduceat(d, first) / total
            owner = np.searchsorted(context, key >> 8)
            p = np.maximum(count - d, 0) / total[owner] + weight[owner] * self.lower(key)
            self.levels.append((key, p, context, weight))

    @classmethod
    def load(cls, blob: bytes) -> "KneserNey":
        model = object.__new__(cls)
        arrays = np.load(io.BytesIO(blob))
        model.levels = [tuple(arrays[f"{name}{i}"] for name in ("key", "p", "context", "weight")) for i in range(ORDER)]
        return model

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"{name}{i}": a for i, level in enumerate(self.levels)
                         for name, a in zip(("key", "p", "context", "weight"), level)})
        return out.getvalue()

    def lower(self, key: np.ndarray) -> np.ndarray:
        """Probability under the orders built so far (none: uniform)."""
        level = len(self.levels)
        return self.probability(key & ((1 << 8 * level) - 1), level - 1)

    def probability(self, key: np.ndarray, level: int = ORDER - 1) -> np.ndarray:
        """P(last symbol | the ones before) of each key of ``level + 1`` symbols."""
        if level < 0:
            return np.full(len(key), 1 / SYMBOLS)
        keys, p, context, weight = self.levels[level]
        if not len(keys):
            return self.probability(key & ((1 << 8 * level) - 1), level - 1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        seen = keys[at] == key
        out = np.where(seen, p[at], 0.0)
        rest = np.flatnonzero(~seen)
        if len(rest):
            before = key[rest] >> 8
            c = np.minimum(np.searchsorted(context, before), len(context) - 1)
            back = np.where(context[c] == before, weight[c], 1.0)
            out[rest] = back * self.probability(key[rest] & ((1 << 8 * level) - 1), level - 1)
        return out


def ngrams_of_all_orders(counts: DataFrame) -> DataFrame:
    """(lang, length, key, n): the counts, and for each lower order its n-grams with
    the number of distinct symbols before them."""
    out = level = counts.select("lang", F.lit(ORDER).alias("length"), "key", "n")
    for length in range(ORDER - 1, 0, -1):
        low = F.col("key").bitwiseAND((1 << 8 * length) - 1).alias("key")
        level = level.groupBy("lang", low).agg(F.count(F.lit(1)).alias("n")).select("lang", F.lit(length).alias("length"), "key", "n")
        out = out.unionByName(level)
    return out


class Models:
    """The models of all languages as a written table (lang, part, blob)."""

    def __init__(self, uri: str, parts: int):
        self.uri, self.parts = uri, parts
        self.held: dict[tuple[str, int], KneserNey | None] = {}
        self.size: dict[tuple[str, int], int] = {}

    def part(self, lang: str, part: int) -> KneserNey | None:
        """Read by the task that asks; the parts asked for last are kept."""
        if (lang, part) in self.held:
            self.held[lang, part] = model = self.held.pop((lang, part))
            return model
        while self.held and sum(self.size.values()) > CACHE_BYTES:
            oldest = next(iter(self.held))
            del self.held[oldest], self.size[oldest]
        rows = read_rows(self.uri, ["blob"], lang=lang, part=part)
        blob = rows.column(0)[0].as_py() if rows.num_rows else None
        self.held[lang, part] = KneserNey.load(blob) if blob else None
        self.size[lang, part] = len(blob or b"")
        return self.held[lang, part]

    def bits(self, lang: str, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean bits per byte of texts from the keys of all their bytes."""
        distinct, where = np.unique(keys, return_inverse=True)
        bits = np.full(len(distinct), math.log2(SYMBOLS))
        own = part_of(distinct, self.parts)
        for part in np.unique(own):
            model = self.part(lang, int(part))
            if model is not None:
                mine = own == part
                bits[mine] = -np.log2(model.probability(distinct[mine]))
        starts = np.cumsum(lengths) - lengths
        return np.add.reduceat(bits[where], starts) / lengths


def read_rows(uri: str, columns: list[str], **equal) -> pa.Table:
    """Columns of the rows of a Parquet folder that have the given values."""
    from pyarrow import dataset, fs
    files, path = fs.FileSystem.from_uri(uri)
    wanted = None
    for name, value in equal.items():
        test = dataset.field(name) == value
        wanted = test if wanted is None else wanted & test
    return dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=columns, filter=wanted)


def written(df: DataFrame, label: str) -> str:
    """URI of a folder of the shared store that ``df`` was written to."""
    uri = f"{shared_uri(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    own_scratch(uri)
    df.write.parquet(uri)
    return uri


def build_models(counts: DataFrame, part_keys: int = PART_KEYS) -> Models:
    """Models from (lang, key, n).  A part takes a task; its n-grams, and 65,792 of
    the two lowest orders at most, are its rows."""
    counts = scratch_table(counts, "counts")   # each lower order comes from the one above: count once
    grams = scratch_table(ngrams_of_all_orders(counts), "ngrams")
    most = (grams.filter(F.col("length") == ORDER).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.max("n")).first()[0])
    parts = max(1, -(-(most or 0) // part_keys))
    low = F.col("length") <= 2
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    rows = grams.select("lang", F.explode(F.when(low, every).otherwise(F.array(part_of(F.col("key"), parts)))).alias("part"),
                        "length", "key", "n")
    # counts of counts of the whole language, which the discounts follow from, as rows of lengths -1 to -5
    spread = (grams.filter("n <= 4").groupBy("lang", "length", "n").agg(F.count(F.lit(1)).alias("m"))
              .select("lang", F.explode(every).alias("part"), (-F.col("length")).alias("length"), F.col("n").alias("key"),
                      F.col("m").alias("n")))

    def build(key, table):
        lang, part = (k.as_py() for k in key)
        length, gram, n = (table.column(c).to_numpy() for c in ("length", "key", "n"))
        found, discount = [], []
        for order in range(1, ORDER + 1):
            mine, about = length == order, length == -order
            found.append((gram[mine], n[mine]))
            discount.append(discounts(dict(zip(gram[about].tolist(), n[about].tolist()))))
        blob = KneserNey(found, discount).dump()
        return pa.table({"lang": pa.array([lang], pa.string()), "part": pa.array([part], pa.int32()),
                         "blob": pa.array([blob], pa.binary())})

    models = rows.unionByName(spread).groupBy("lang", "part").applyInArrow(build, "lang string, part int, blob binary")
    return Models(written(models, "models"), parts)


class ByteBits:
    """Bits of every byte by its frequency in a language: a written table (lang,
    byte, n) of at most 256 rows a language."""

    def __init__(self, counts: DataFrame):
        self.uri = written(counts.groupBy("lang", F.col("key").bitwiseAND(255).alias("byte")).agg(F.sum("n").alias("n")), "bytes")
        self.held: dict[str, np.ndarray] = {}

    def bits(self, lang: str, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if lang not in self.held:
            n = np.ones(SYMBOLS)
            rows = read_rows(self.uri, ["byte", "n"], lang=lang)
            n[rows.column(0).to_numpy()] += rows.column(1).to_numpy()
            self.held[lang] = -np.log2(n / n.sum())
        return np.add.reduceat(self.held[lang][keys & 255], np.cumsum(lengths) - lengths) / lengths


class Trim:
    """The documents within the bands of both of their values."""

    def __init__(self, values: dict, uris: dict[str, str]):
        self.values, self.uris = values, uris
        self.held: dict[tuple[str, str], dict[int, tuple[float, float]]] = {}

    def kept(self, lang: str, raw: list[bytes], keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        sizes = [length_class(len(x.split())) for x in raw]
        kept = np.ones(len(raw), bool)
        for name, model in self.values.items():
            if (name, lang) not in self.held:   # a few rows a language
                rows = read_rows(self.uris[name], ["length_class", "low", "high"], band_lang=lang)
                self.held[name, lang] = {c: (a, b) for c, a, b in zip(*(x.to_pylist() for x in rows.columns))}
            low, high = np.array([self.held[name, lang][c] for c in sizes]).T
            bits = model.bits(lang, keys, lengths)
            kept &= (low <= bits) & (bits <= high)
        return kept


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) == n:
        return 0
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        x = (ids[i:n - WINDOW + 1 + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64))
        h = (h ^ x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h, kind="stable")
    equal = np.flatnonzero(h[order][1:] == h[order][:-1])
    if not len(equal):
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    a, b = order[equal], order[equal + 1]
    same = (windows[a] == windows[b]).all(axis=1)
    edge = np.zeros(n + 1, np.int64)
    starts = np.unique(np.concatenate([a[same], b[same]]))
    edge[starts] += 1
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACE))
    return (len(words), len(text or "") - spaces, len(raw) - len(raw.translate(None, SIGNS)),
            len(lines) - len(set(lines)), repeated_words(words))


def score_documents(docs: DataFrame, models: dict, text_col: str = "text", lang_col: str = "lang",
                    keep: list[str] | None = None, rules: bool = True) -> DataFrame:
    """Add, under the name of each of ``models``, the mean bits per byte under the
    language's model (null for an empty text), ``length_class``, and, with
    ``rules``, the base counts."""
    fields = T.StructType([*(BASE.fields if rules else []), *[T.StructField(n, T.DoubleType()) for n in models],
                           T.StructField("length_class", T.IntegerType())])
    kept = passed_columns(docs if keep is None else docs.select(*keep), fields.names)
    lang_held, text_held = (unused(kept, n) for n in ("__lang_of_row", "__text_of_row"))
    body = docs.select(*[docs[c] for c in kept], F.coalesce(docs[lang_col], F.lit("")).alias(lang_held),
                       docs[text_col].alias(text_held))
    schema = T.StructType([body.schema[c] for c in kept] + fields.fields)

    def run(batches):
        for part in slices(batches, text_held, AT_ONCE):
            bits: dict[str, list[float | None]] = {n: [None] * part.num_rows for n in models}
            for lang, (rows, raw) in by_language(part, lang_held, text_held).items():
                keys, lengths = keys_of(raw)
                for name, model in models.items():
                    for i, value in zip(rows, model.bits(lang, keys, lengths).tolist()):
                        bits[name][i] = value
            texts = part.column(text_held).to_pylist()
            if rules:
                columns = [list(c) for c in zip(*(base_counts(t) for t in texts))]
                sizes = columns[0]
            else:
                columns, sizes = [], [len((t or "").encode().split()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in kept] + [pa.array(c, pa.int64()) for c in columns]
                + [*[pa.array(b, pa.float64()) for b in bits.values()], pa.array([length_class(n) for n in sizes], pa.int32())],
                names=[*kept, *fields.names])

    return body.mapInArrow(run, schema)


def bands(scored: DataFrame, width: float, value: str = "bits", lang_col: str = "lang") -> DataFrame:
    """(band_lang, length_class, low, high): a row per language and length class
    that occurs, from all its documents' distinct values."""
    rows = (scored.select(F.coalesce(F.col(lang_col), F.lit("")).alias("band_lang"), "length_class", F.col(value).alias("bits"))
            .filter("bits is not null").distinct())
    counts = rows.groupBy("band_lang", "length_class").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("band_lang").orderBy("length_class")   # some thirty classes a language
    enough = F.when(F.col("n") >= MIN_CLASS, F.col("length_class"))
    shorter = F.last(enough, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    longer = F.first(enough, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    homes = scratch_table(counts.select("band_lang", "length_class", F.coalesce(shorter, longer, F.lit(-1)).alias("home")), "classes")
    placed = rows.join(homes, ["band_lang", "length_class"]).select("band_lang", "home", "bits")
    middle = placed.groupBy("band_lang", "home").agg(F.percentile_approx("bits", 0.5, 10000).alias("mid"))
    spread = (placed.join(middle, ["band_lang", "home"]).groupBy("band_lang", "home", "mid")
              .agg(F.percentile_approx(F.abs(F.col("bits") - F.col("mid")), 0.5, 10000).alias("mad")))
    half = F.when(F.col("mad") > 0, F.lit(width * 1.4826) * F.col("mad")).otherwise(F.lit(LEAST_WIDTH))
    return homes.join(spread, ["band_lang", "home"]).select(
        "band_lang", "length_class", (F.col("mid") - half).alias("low"), (F.col("mid") + half).alias("high"))


def fitted_models(docs: DataFrame) -> Models:
    """The second models: those of the documents that the first ones find ordinary."""
    counts = scratch_table(count_ngrams(docs), "counts")
    values = {"bits": build_models(counts), "byte_bits": ByteBits(counts)}
    scored = scratch_table(score_documents(docs, values, keep=["lang"], rules=False), "first_bits")
    within = Trim(values, {name: written(bands(scored, TRIM, name), "trim") for name in values})
    return build_models(count_ngrams(docs, within=within))


def quality(docs: DataFrame) -> DataFrame:
    """Per document the base counts, ``base_failed``, ``perplexity``, its
    language's and length's ``low_perplexity`` and ``high_perplexity``, and ``kept``.

    Null or empty text has no words, so it fails the base rules and has a null
    perplexity.  Null languages form one group of their own.  Repeated rows count
    in the model as often as they occur, in the bands once; ties with a band's edge
    are inside.  Texts of any length are read whole, in slices of whole texts.  Other
    columns are not read; an empty table gives an empty result.
    """
    source = docs.select("doc_id", "text", "lang")
    scored = scratch_table(score_documents(source, {"bits": fitted_models(source)}, keep=["doc_id", "lang"]), "perplexity")
    limits = bands(scored, WIDTH).withColumnRenamed("length_class", "band_class")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    mine = (F.coalesce(F.col("lang"), F.lit("")) == F.col("band_lang")) & (F.col("length_class") == F.col("band_class"))
    return (scored.join(F.broadcast(limits), mine, "left")   # some thirty rows a language
            .select("doc_id", *BASE.names, failed.alias("base_failed"), (~failed & inside).alias("kept"),
                    F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "low").alias("low_perplexity"),
                    F.pow(F.lit(2.0), "high").alias("high_perplexity")))
