"""Language identification by a bidirectional GRU over bytes (operator 2).

A text's UTF-8 bytes are read in blocks of BLOCK bytes, forwards and backwards,
by two gated recurrent networks whose state starts at zero in every block, as it
did in training.  A softmax over both states labels every position of the whole
text; the probabilities of positions that belong to letters are averaged to the
document's probabilities.

Training is numpy backpropagation through time on a bounded sample: for each
language the PER_LANGUAGE documents whose ids hash lowest in as many hash
buckets, WINDOWS windows of BLOCK characters each at hashed places.  Only rows
whose crc32(id) mod FOLDS is not 0 and whose language is known take part.  The
sample, its order and the start weights depend on ids and texts alone, so the
same table gives the same model however it is partitioned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesight.llm.common import map_texts

FOLDS = 5
PER_LANGUAGE, WINDOWS, BLOCK = 512, 3, 128
HIDDEN, STEPS, BATCH, RATE = 12, 300, 128, 0.01
UNDETERMINED = "und"
#: Blocks that run side by side in one task.
WIDE = 4096

OUTPUTS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def fold(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, window) pairs; at most PER_LANGUAGE * WINDOWS a language."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                       F.xxhash64(id_col).alias("h"), fold(id_col).alias("fold"))
    rows = rows.filter("fold <> 0 and lang is not null and text is not null")
    picked = (rows.groupBy("lang", F.pmod("h", F.lit(PER_LANGUAGE)).alias("bucket"))
              .agg(F.min("h").alias("h")).select("lang", "h"))
    # one row per language and bucket
    texts = rows.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", *[
        F.substring("text", 1 + F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.char_length("text") - BLOCK, F.lit(1))).cast("int"),
                    F.lit(BLOCK)).alias(f"w{k}") for k in range(WINDOWS)])
    texts = texts.groupBy("lang", "h").agg(*[F.min(f"w{k}").alias(f"w{k}") for k in range(WINDOWS)])
    found = sorted((r["lang"], r["h"], r[f"w{k}"]) for r in texts.collect() for k in range(WINDOWS))
    return [(lang, w) for lang, _, w in found if any(map(str.isalpha, w))]


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start_weights(languages: int, rng) -> dict[str, np.ndarray]:
    h = HIDDEN
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {"x0": draw(256, 3 * h, scale=0.3), "x1": draw(256, 3 * h, scale=0.3),
            "u0": draw(h, 3 * h, scale=h ** -0.5), "u1": draw(h, 3 * h, scale=h ** -0.5),
            "out": draw(2 * h, languages, scale=0.3), "bias": np.zeros(languages, np.float32)}


def run_direction(x: np.ndarray, u: np.ndarray, steps: range, tape: list | None = None) -> np.ndarray:
    """States [length, batch, HIDDEN]; ``x`` holds the bytes' gate inputs."""
    h = HIDDEN
    state = np.zeros((x.shape[1], h), np.float32)
    states = np.empty((x.shape[0], x.shape[1], h), np.float32)
    for t in steps:
        hu = state @ u
        gates = sigmoid(x[t, :, :2 * h] + hu[:, :2 * h])
        r, z = gates[:, :h], gates[:, h:]
        n = np.tanh(x[t, :, 2 * h:] + r * hu[:, 2 * h:])
        if tape is not None:
            tape.append((t, state, r, z, n, hu[:, 2 * h:]))
        state = n + z * (state - n)
        states[t] = state
    return states


def direction_gradient(tape: list, d_states: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of ``u``, through time."""
    h = HIDDEN
    d_x = np.empty((*d_states.shape[:2], 3 * h), np.float32)
    d_u = np.zeros_like(u)
    carried = np.zeros(d_states.shape[1:], np.float32)
    for t, before, r, z, n, hu_n in reversed(tape):
        d = carried + d_states[t]
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (before - n) * z * (1 - z)
        d_r = d_n * hu_n * r * (1 - r)
        d_x[t] = np.concatenate([d_r, d_z, d_n], axis=1)
        d_hu = np.concatenate([d_r, d_z, d_n * r], axis=1)
        d_u += before.T @ d_hu
        carried = d * z + d_hu @ u.T
    return d_x, d_u


def gradients(w: dict, data: np.ndarray, used: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean position loss.  ``data`` [length, batch] bytes,
    ``used`` marks real positions, ``label`` [batch]."""
    length, batch = data.shape
    tapes = ([], [])
    states = [run_direction(w[f"x{k}"][data], w[f"u{k}"], range(length) if k == 0 else range(length - 1, -1, -1), tapes[k])
              for k in (0, 1)]
    both = np.concatenate(states, axis=2).reshape(length * batch, -1)
    p = both @ w["out"] + w["bias"]
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(length * batch), np.tile(label, length)] -= 1
    p *= (used.reshape(-1, 1) / max(1, used.sum())).astype(np.float32)
    g = {"out": both.T @ p, "bias": p.sum(axis=0)}
    d_both = (p @ w["out"].T).reshape(length, batch, -1)
    one_hot = np.zeros((length * batch, 256), np.float32)
    one_hot[np.arange(length * batch), data.reshape(-1)] = 1
    for k in (0, 1):
        d_x, g[f"u{k}"] = direction_gradient(tapes[k], d_both[:, :, k * HIDDEN:(k + 1) * HIDDEN], w[f"u{k}"])
        g[f"x{k}"] = one_hot.T @ d_x.reshape(length * batch, -1)
    return g


def train(windows: list[tuple[str, str]], seed: int = 7) -> dict | None:
    """STEPS Adam steps over shuffled windows; None without labelled text."""
    languages = sorted({lang for lang, _ in windows})
    if not languages:
        return None
    raw = [w.encode()[:BLOCK] for _, w in windows]
    data = np.zeros((BLOCK, len(raw)), np.uint8)
    used = np.zeros((BLOCK, len(raw)), np.float32)
    for i, b in enumerate(raw):
        data[:len(b), i] = np.frombuffer(b, np.uint8)
        used[:len(b), i] = 1
    label = np.array([languages.index(lang) for lang, _ in windows])
    rng = np.random.default_rng(seed)
    w = start_weights(len(languages), rng)
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    queue = np.zeros(0, int)
    while step < STEPS:
        while len(queue) < min(BATCH, len(raw)):
            queue = np.append(queue, rng.permutation(len(raw)))
        part, queue = queue[:BATCH], queue[BATCH:]
        step += 1
        rate = RATE * (1 - (step - 1) / STEPS)
        for k, g in gradients(w, data[:, part], used[:, part], label[part]).items():
            g = np.clip(g, -1, 1)
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.001 * (g * g - m2[k])
            w[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return {"languages": languages, **{k: v.astype(np.float32) for k, v in w.items()}}


class Labeller:
    """Position probabilities of many blocks at once, features first."""

    def __init__(self, model: dict):
        h = HIDDEN
        half = np.ones((3 * h, 1), np.float32)
        half[:2 * h] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        self.x = [np.ascontiguousarray(model[f"x{k}"].T * half) for k in (0, 1)]
        self.u = [np.ascontiguousarray(model[f"u{k}"].T * half) for k in (0, 1)]
        self.out = [np.ascontiguousarray(model["out"][k * h:(k + 1) * h].T) for k in (0, 1)]
        self.bias = model["bias"][:, None]
        letters = [c for c in range(256) if c >= 0x80 or chr(c).isalpha()]
        self.letter = np.zeros(256, np.float32)
        self.letter[letters] = 1

    def states(self, data: np.ndarray, k: int):
        """States [HIDDEN, blocks] of one direction, position by position."""
        h, u, x = HIDDEN, self.u[k], self.x[k]
        blocks = data.shape[1]
        state = np.zeros((h, blocks), np.float32)
        a, hu = np.empty((3 * h, blocks), np.float32), np.empty((3 * h, blocks), np.float32)
        for t in range(len(data)) if k == 0 else range(len(data) - 1, -1, -1):
            np.take(x, data[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=hu)
            gates = a[:2 * h]
            gates += hu[:2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            n = hu[2 * h:]
            n *= gates[:h]
            n += a[2 * h:]
            np.tanh(n, out=n)
            state -= n
            state *= gates[h:]
            state += n
            yield t, state

    def block_sums(self, data: np.ndarray) -> np.ndarray:
        """Summed probabilities over letter positions [blocks, languages]."""
        length, blocks = data.shape
        logits = np.empty((length, len(self.bias), blocks), np.float32)
        for t, state in self.states(data, 0):
            np.matmul(self.out[0], state, out=logits[t])
        total = np.zeros((len(self.bias), blocks), np.float32)
        for t, state in self.states(data, 1):
            p = logits[t]
            p += self.out[1] @ state
            p += self.bias
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p *= self.letter[data[t]] / p.sum(axis=0)
            total += p
        return total.T

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """[texts, languages]; rows of zeros where a text has no letter byte."""
        raw = [(t or "").encode() for t in texts]
        counts = np.array([-(-len(b) // BLOCK) for b in raw], np.int64)
        owner = np.repeat(np.arange(len(raw)), counts)
        joined = np.frombuffer(b"".join(b + bytes(-len(b) % BLOCK) for b in raw), np.uint8).reshape(-1, BLOCK)
        sums = np.zeros((len(raw), len(self.bias)))
        for i in range(0, len(joined), WIDE):
            part = np.ascontiguousarray(joined[i:i + WIDE].T)
            np.add.at(sums, owner[i:i + WIDE], self.block_sums(part))
        total = sums.sum(axis=1, keepdims=True)
        return np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)


def with_language(df: DataFrame, model: dict | None, text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the document probability of that language.

    Null text, text without a letter, or no model: ``und`` and 0.0.  Ties go to
    the language first in alphabetical order; rows pass through, whatever their
    id.
    """
    def make():
        labeller = Labeller(model) if model else None

        def work(texts):
            known = [labeller is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            if labeller is None:
                return [[UNDETERMINED] * len(texts), [0.0] * len(texts)]
            p = labeller.probabilities([t if k else None for t, k in zip(texts, known)])
            best = p.argmax(axis=1)
            return [[model["languages"][b] if k else UNDETERMINED for b, k in zip(best.tolist(), known)],
                    [min(1.0, float(p[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best.tolist(), known))]]

        return work

    return map_texts(df, text_col, OUTPUTS, make, df.columns if keep is None else keep)


def languages(docs: DataFrame) -> DataFrame:
    """Train on the rows outside the held-out fold and label every document.
    A null doc_id is never held out and, having no fold, never trained on."""
    model = train(training_windows(docs))
    labelled = with_language(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return labelled.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
