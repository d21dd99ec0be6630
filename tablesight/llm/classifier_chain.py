"""Toxicity by a classifier chain (operator 1).

Categories are predicted one after the other by linear (logistic) models over
the words of a text and their first PREFIXES characters; each later model also
reads the log-odds that the earlier ones gave.  In training those come from
models that did not see the row: the sample is cut in FOLDS folds, and every
fold is predicted by models of the same chain position fitted to the others.

The models are fitted to a bounded sample: the SAMPLE labelled documents whose
ids hash lowest.  Spark extracts their features, counts each feature against
each category and keeps the FEATURES that tell most (chi-square); the driver
gets index lists of that vocabulary.  Every document is then scored whole, where
it lies, without a shuffle.

A category is learned from the documents whose own label is known: one with a
null label for an earlier category still has that category's out-of-fold
log-odds, and teaches the later ones.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.llm.common import map_texts
from tablesight.session import scratch_table

#: Labelled documents learned from; features kept of those in MIN_DOCS of them
#: (None: all).
SAMPLE, FEATURES, MIN_DOCS = 8192, 4096, 4
PREFIXES = (4, 5, 6)
FOLDS, STEPS, PENALTY = 4, 200, 2e-4
#: Words whose features a task remembers.
CACHE = 1 << 18


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, and its runs of signs."""
    return set(re.findall(r"[^\W\d_]+|[^\w\s]{2,}|[|]", (text or "").lower()))


def features_of_word(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def features_of(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in features_of_word(w)}


class Sparse:
    """Rows of feature indices (all values 1) and a few dense columns."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.size = size
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.rows = len(rows)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at], minlength=self.rows)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, r[self.owner], minlength=self.size)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> dict:
    """Ridge logistic regression on the rows in ``use`` (0 or 1), by Adam steps
    from the prior log-odds.  With one class only, the prior is the model."""
    n, positive = float(use.sum()), float((y * use).sum())
    w, v = np.zeros(x.size), np.zeros(dense.shape[1])
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    model = {"w": w, "v": v, "bias": bias}
    if positive in (0.0, n):
        return model
    theta = np.concatenate([w, v, [bias]])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, v = theta[:x.size], theta[x.size:-1]
        r = (probability(x.times(w) + dense @ v + theta[-1]) - y) * use / n
        g = np.concatenate([x.transposed(r) + PENALTY * w, dense.T @ r + PENALTY * v, [r.sum()]])
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        rate = 0.1 * (1 - (step - 1) / STEPS)
        theta -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return {"w": theta[:x.size], "v": theta[x.size:-1], "bias": float(theta[-1])}


def log_odds(model: dict, x: Sparse, dense: np.ndarray) -> np.ndarray:
    return np.clip(x.times(model["w"]) + dense @ model["v"] + model["bias"], -30, 30)


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds above which to call a category: highest F1 on out-of-fold
    log-odds, half-way to the next lower one (no positives: zero)."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    if not y.any():
        return 0.0
    hits, called = np.cumsum(y), np.arange(1, len(y) + 1)
    f1 = np.where(np.append(z[1:] < z[:-1], True), 2 * hits / (called + y.sum()), -1)
    i = int(f1.argmax())
    return float((z[i] + (z[i + 1] if i + 1 < len(z) else z[i] - 1)) / 2)


def fit_chain(rows: list[np.ndarray], size: int, labels: np.ndarray, fold: np.ndarray) -> list[dict]:
    """One model per column of ``labels`` (NaN: not known), in order; each reads the
    out-of-fold log-odds of the ones before.  Its threshold comes from its own."""
    x = Sparse(rows, size)
    earlier = np.zeros((len(rows), 0))
    chain = []
    for c in range(labels.shape[1]):
        known = ~np.isnan(labels[:, c].astype(float))
        y = np.where(known, labels[:, c], 0).astype(float)
        chain.append(fit(x, earlier, y, known.astype(float)))
        unseen = np.zeros(len(rows))
        for k in range(FOLDS):
            model = fit(x, earlier, y, ((fold != k) & known).astype(float))
            unseen = np.where(fold == k, log_odds(model, x, earlier), unseen)
        chain[-1]["threshold"] = best_threshold(unseen[known], y[known])
        earlier = np.column_stack([earlier, unseen])
    return chain


def predict_chain(chain: list[dict], rows: list[np.ndarray], size: int) -> np.ndarray:
    """Probabilities [rows, categories]."""
    x = Sparse(rows, size)
    earlier = np.zeros((len(rows), 0))
    for model in chain:
        earlier = np.column_stack([earlier, log_odds(model, x, earlier)])
    return probability(earlier)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column],
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fold, text, one 0/1 column per category, null where not known) of at
    most SAMPLE documents.  Several label rows of one document count as their
    maximum; rows with a null id, or without any label, are left out."""
    rows = labels.select(F.col(id_col).alias("id"), *[c.cast("int").alias(k) for k, c in categories.items()])
    rows = rows.dropna(subset=["id"]).dropna(how="all", subset=list(categories)).groupBy("id").agg(*[F.max(k).alias(k) for k in categories])
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return (texts.join(F.broadcast(picked), "id").dropDuplicates(["id"])  # at most SAMPLE ids
            .withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int")))


def telling_features(sample: DataFrame, categories: list[str]) -> list[str]:
    """The FEATURES of highest chi-square against any category (ties by name)."""
    def make():
        return lambda texts: [[sorted(features_of(t)) for t in texts]]

    field = T.StructType([T.StructField("features", T.ArrayType(T.StringType()))])
    seen = map_texts(sample, "text", field, make, categories).select(*categories, F.explode("features").alias("feature"))
    sums = [x for i, c in enumerate(categories) for x in (F.count(c).alias(f"n{i}"), F.sum(c).alias(f"s{i}"))]
    totals = sample.agg(*sums).first()
    counted = seen.groupBy("feature").agg(F.count(F.lit(1)).alias("df"), *sums)
    gains = [F.lit(0.0)]
    for i in range(len(categories)):
        n, positive = float(totals[f"n{i}"]), float(totals[f"s{i}"] or 0)
        if 0 < positive < n:
            df, hits = F.col(f"n{i}"), F.coalesce(F.col(f"s{i}"), F.lit(0))
            gap = hits * n - df * positive
            gains.append(F.when(df > 0, gap * gap * n / (df * (n - df + 1.0) * positive * (n - positive))).otherwise(0.0))
    best = counted.filter(F.col("df") >= (MIN_DOCS or 1)).withColumn("gain", F.greatest(*gains, F.lit(0.0)))
    best = best.orderBy(F.desc("gain"), "feature")
    return [r["feature"] for r in (best if FEATURES is None else best.limit(FEATURES)).collect()]


def vocabulary_rows(vocabulary: dict[str, int]):
    """A function from texts to arrays of the vocabulary indices they hold."""
    known: dict[str, tuple] = {}

    def rows(texts):
        out = []
        for text in texts:
            found: set[int] = set()
            for word in words_of(text):
                hit = known.get(word)
                if hit is None:
                    hit = tuple(vocabulary[f] for f in features_of_word(word) if f in vocabulary)
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = hit
                if hit:
                    found.update(hit)
            out.append(np.fromiter(sorted(found), np.int64, len(found)))
        return out

    return rows


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]) -> dict:
    """The chain and its vocabulary."""
    names = list(categories)
    sample = scratch_table(labelled_sample(docs, labels, categories), "sample")
    features = telling_features(sample, names)
    vocabulary = {f: i for i, f in enumerate(features)}

    def make():
        rows = vocabulary_rows(vocabulary)
        return lambda texts: [[r.astype(np.int32) for r in rows(texts)]]

    field = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType()))])
    found = map_texts(sample, "text", field, make, ["id", "fold", *names]).collect()  # at most SAMPLE rows
    found.sort(key=lambda r: r["id"])
    chain = fit_chain([np.array(r["at"], np.int64) for r in found], len(vocabulary),
                      np.array([[math.nan if r[c] is None else r[c] for c in names] for r in found]).reshape(len(found), len(names)),
                      np.array([r["fold"] for r in found]))
    return {"categories": names, "vocabulary": vocabulary, "chain": chain}


def with_categories(df: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``p_<category>`` for each category of the chain.

    Null and empty texts have no features and get what the models give those;
    rows pass through.
    """
    names = [f"p_{c}" for c in model["categories"]]

    def make():
        rows = vocabulary_rows(model["vocabulary"])

        def work(texts):
            p = predict_chain(model["chain"], rows(texts), len(model["vocabulary"]))
            return [p[:, i] for i in range(len(names))]
        return work

    fields = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    return map_texts(df, text_col, fields, make, df.columns if keep is None else keep)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the probabilities of the chain junk -> toxic, and ``toxic``:
    whether the latter is over the threshold learned with it.

    Null and empty texts have no features; texts of any length are read whole, for
    their distinct words.  Repeated rows come back repeated; equal gains and
    thresholds are settled by name and by the lower one.  Without labels every
    probability is the prior's; an empty table gives no rows.
    """
    categories = {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    model = train(docs, labels, categories)
    limit = float(probability(np.array(model["chain"][-1]["threshold"])))
    scored = with_categories(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", "p_junk", "p_toxic", (F.col("p_toxic") > limit).alias("toxic"))
