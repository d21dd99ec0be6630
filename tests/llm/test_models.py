"""Language ID (2), n-gram perplexity (6) and the classifier chain (1)."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.llm import byte_gru as G
from tablesight.llm import classifier_chain as C
from tablesight.llm import ngram_perplexity as N
from tablesight.llm import queries as Q


def position_loss(w, data, used, label):
    states = [G.run_direction(w[f"x{k}"][data], w[f"u{k}"], range(len(data)) if k == 0 else range(len(data) - 1, -1, -1))
              for k in (0, 1)]
    z = np.concatenate(states, axis=2) @ w["out"] + w["bias"]
    z = z - np.log(np.exp(z).sum(axis=2, keepdims=True))
    return -(z[:, np.arange(len(label)), label] * used).sum() / used.sum()


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in G.start_weights(3, rng).items()}
    data = rng.integers(97, 103, (7, 5)).astype(np.uint8)
    used = (rng.random((7, 5)) < 0.8).astype(np.float32)
    label = rng.integers(0, 3, 5)
    grads = G.gradients(w, data, used, label)
    for name in w:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            if name in ("x0", "x1"):
                at = (int(data[rng.integers(7), rng.integers(5)]), at[1])
            keep = w[name][at]
            w[name][at] = keep + 1e-2
            up = position_loss(w, data, used, label)
            w[name][at] = keep - 1e-2
            down = position_loss(w, data, used, label)
            w[name][at] = keep
            assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_labeller_agrees_with_training_forward():
    rng = np.random.default_rng(1)
    w = G.start_weights(2, rng)
    text = "abc déf, ghi"
    raw = np.frombuffer(text.encode(), np.uint8)
    padded = np.zeros((G.BLOCK, 1), np.uint8)
    padded[:len(raw), 0] = raw
    states = [G.run_direction(w[f"x{k}"][padded], w[f"u{k}"], range(G.BLOCK) if k == 0 else range(G.BLOCK - 1, -1, -1))
              for k in (0, 1)]
    z = np.exp(np.concatenate(states, axis=2) @ w["out"] + w["bias"])
    p = (z / z.sum(axis=2, keepdims=True))[:len(raw), 0]
    letters = [b >= 0x80 or chr(b).isalpha() for b in raw]
    want = p[letters].mean(axis=0)
    got = G.Labeller({"languages": ["a", "b"], **w}).probabilities([text])[0]
    assert got == pytest.approx(want, abs=1e-4)


def test_language_query_held_out(spark, sf_small, small_docs):
    rows = {r.doc_id: r for r in Q.op2_byte_gru(spark, sf_small).collect()}
    docs = small_docs.collect()
    assert len(rows) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {i for i, r in rows.items() if r.held_out}
    assert np.mean([rows[r.doc_id].lang_pred == r.lang for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edge_rows(edge_docs, no_docs):
    rows = G.languages(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    texts = [r.text for r in edge_docs.collect()]
    blank = sum(t is None or not any(c.isalpha() for c in t) for t in texts)
    und = [r for r in rows if r.lang_pred == "und"]
    assert len(und) == blank and {r.score for r in und} == {0.0}
    assert G.languages(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string")).withColumn("Score", F.lit("clash"))
    assert {r.lang_pred for r in G.languages(unlabelled).collect()} == {"und"}


def test_training_ignores_the_layout_and_the_held_out_fold(small_docs):
    a = G.training_windows(small_docs.repartition(7))
    assert a == G.training_windows(small_docs.coalesce(1))
    changed = small_docs.withColumn("lang", F.when(G.fold("doc_id") == 0, "xx").otherwise(F.col("lang")))
    assert a == G.training_windows(changed)


def plain_kneser_ney(texts):
    """Modified Kneser-Ney by dictionaries: P(last byte | up to four before)."""
    grams = Counter()
    for t in texts:
        s = (32,) * 4 + tuple(t.encode())
        grams.update(s[i - 4:i + 1] for i in range(4, len(s)))
    counts = {5: grams}
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        c = counts[n]
        of = Counter(c.values())
        if of[1] and of[2]:
            y = of[1] / (of[1] + 2 * of[2])
            d = [0, 1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3] if of[3] else 1.5]
            d = [0, *[min(max(x, 0.1), k) for k, x in enumerate(d) if k]]
        else:
            d = [0, 0.5, 0.75, 1.0]
        after = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        back = sum(d[min(v, 3)] for v in after) / sum(after)
        return max(c[gram] - d[min(c[gram], 3)], 0) / sum(after) + back * p(gram[1:])

    return p


@pytest.mark.parametrize("part_keys", [5, N.PART_KEYS])
def test_kneser_ney_against_dictionaries(spark, part_keys):
    texts = ["The cat sat on the mat, the end.", "a cat and a hat", "thé café 12 cats"]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    counts = N.count_ngrams(docs)
    models, p = N.build_models(counts, part_keys), plain_kneser_ney(texts)
    assert (models.parts > 1) == (part_keys == 5)
    asked = np.array([*N.keys_of(["The cafe Hat 9 zq!é".encode()])[0].tolist(), *[r.key for r in counts.collect()]])
    for key, part in zip(asked, N.part_of(asked, models.parts)):
        model = models.part("en", int(part))
        gram = tuple(int(key) >> 8 * i & 255 for i in range(N.ORDER - 1, -1, -1))
        assert model.probability(np.array([key]))[0] == pytest.approx(p(gram))
    whole = models.part("en", int(N.part_of(asked[-1:], models.parts)[0]))
    every = (int(asked[-1]) >> 8 << 8) + np.arange(256)
    assert whole.probability(every).sum() == pytest.approx(1)
    lengths = np.array([len(t.encode()) for t in texts])
    bits = models.bits("en", N.keys_of([t.encode() for t in texts])[0], lengths)
    for t, b in zip(texts, bits):
        grams = N.keys_of([t.encode()])[0]
        mine = [p(tuple(int(k) >> 8 * i & 255 for i in range(N.ORDER - 1, -1, -1))) for k in grams]
        assert b == pytest.approx(-np.log2(mine).mean())


def plain_base(text):
    spaces = " \t\n\r\x0b\x0c"
    words = "".join(" " if c in spaces else c for c in (text or "")).split(" ")
    words = [w for w in words if w]
    lines = [x for x in (text or "").split("\n") if any(c not in spaces for c in x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("text", [None, "", "a b\nc\n\na b\n \x1c", "x " * 30, "a b c d e f g h " * 2 + "z", "é é #|", "q\r\nq\r\n"])
def test_base_counts(text):
    assert N.base_counts(text) == plain_base(text)


def test_perplexity_query(spark, sf_small, small_docs):
    rows = {r.doc_id: r for r in Q.op6_ngram_perplexity(spark, sf_small).collect()}
    docs = small_docs.collect()
    for r in docs:
        got = rows[r.doc_id]
        base = plain_base(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == base
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        assert got.base_failed == failed
        inside = got.low_perplexity <= got.perplexity <= got.high_perplexity
        assert got.kept == (not failed and inside)
    assert sum(r.kept for r in rows.values()) > 0.7 * len(rows)


def plain_bands(values, width):
    """(lang, class) -> (low, high) of (lang, words, bits) rows."""
    classes = {}
    for lang, words, bits in set(values):
        classes.setdefault((lang, N.length_class(words)), set()).add(bits)
    out = {}
    for lang, c in classes:
        mine = sorted(k for lg, k in classes if lg == lang)
        full = [k for k in mine if len(classes[lang, k]) >= N.MIN_CLASS]

        def home(k):
            return max([x for x in full if x <= k], default=min([x for x in full if x >= k], default=-1))

        held = sorted(b for k in mine if home(k) == home(c) for b in classes[lang, k])
        mid = held[(len(held) + 1) // 2 - 1]
        far = sorted(abs(b - mid) for b in held)
        mad = far[(len(far) + 1) // 2 - 1]
        half = width * 1.4826 * mad if mad else N.LEAST_WIDTH
        out[lang, c] = (mid - half, mid + half)
    return out


def test_perplexity_and_bands_by_hand(spark, monkeypatch):
    """Both models, the trimming and the bands again, in plain Python."""
    monkeypatch.setattr(N, "MIN_CLASS", 4)
    rng = np.random.default_rng(2)
    words = "the cat and dog were in a house".split()
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(3, 40)))), "en") for i in range(24)]
    rows += [(24, "ZZ&& QQ$$ " * 3, "en"), (25, rows[0][1], "en"), (26, "le chat", None), (27, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in N.quality(docs).collect()}
    asked = [(i, t, lg or "") for i, t, lg in rows if t]

    def bits_of(kept):
        out = {}
        for lang in {lg for *_, lg in asked}:
            p = plain_kneser_ney([t for i, t, lg in asked if lg == lang and i in kept])
            for i, t, lg in asked:
                if lg == lang:
                    grams = N.keys_of([t.encode()])[0]
                    out[i] = float(-np.log2([p(tuple(int(k) >> 8 * j & 255 for j in range(N.ORDER - 1, -1, -1))) for k in grams]).mean())
        return out

    def limits(bits, width):
        # equal texts have equal values up to rounding
        b = plain_bands([(lg, len(t.split()), round(bits[i], 9)) for i, t, lg in asked], width)
        return {i: b[lg, N.length_class(len(t.split()))] for i, t, lg in asked}

    first = bits_of({i for i, *_ in asked})
    plain = {}
    for i, t, lg in asked:
        n = Counter(b"".join(x.encode() for _, x, y in asked if y == lg))
        total = sum(n.values()) + 256
        plain[i] = float(np.mean([-np.log2((n[b] + 1) / total) for b in t.encode()]))
    kept = set(first)
    for values in (first, plain):
        band = limits(values, N.TRIM)
        kept &= {i for i in first if band[i][0] - 1e-9 <= values[i] <= band[i][1] + 1e-9}
    second = bits_of(kept)
    band = limits(second, N.WIDTH)
    for i, b in second.items():
        assert got[i].perplexity == pytest.approx(2 ** b, rel=1e-6), i
        assert (got[i].low_perplexity, got[i].high_perplexity) == pytest.approx([2 ** x for x in band[i]], rel=1e-6)
    assert got[27].perplexity is None and not got[27].kept and got[24].perplexity > got[24].high_perplexity


def test_junk_that_passes_the_base_rules(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    base = [r.text for r in docs.join(labels, "doc_id").filter("quality = 1 and lang = 'en' and text is not null").orderBy("doc_id")
            .limit(400).collect() if 100 < len(r.text.split()) < 400][:50]
    planted = [(-1 - i, t.upper()) for i, t in enumerate(base)]
    planted += [(-101 - i, " ".join(w + "&&&" if j % 2 else w + "$$$" for j, w in enumerate(t.split()))) for i, t in enumerate(base)]
    rows = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(i, t, "en") for i, t in planted], "doc_id long, text string, lang string"))
    out = N.quality(rows).join(labels, "doc_id", "left").filter("not base_failed").select("doc_id", "kept", "quality").collect()
    junk = [r.kept for r in out if r.quality == 0]
    clean = [r.kept for r in out if r.quality == 1]
    assert junk.count(False) >= 0.5 * len(junk) and clean.count(False) <= 0.01 * len(clean)
    for low, high in ((-100, -1), (-200, -101)):
        mine = [r.kept for r in out if low <= r.doc_id <= high]
        assert len(mine) == 50 and mine.count(False) >= 45


def test_perplexity_edge_rows(edge_docs, no_docs):
    rows = N.quality(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.base_failed and not r.kept and r.perplexity is None for r in rows if not r.n_words)
    assert N.quality(no_docs).count() == 0
    odd = edge_docs.withColumn("bits", F.lit("clash")).withColumn("N_WORDS", F.lit(1))
    assert N.quality(odd).count() == edge_docs.count()


def test_foreign_text_is_out_of_its_band(spark):
    words = "the cat and dog were in house with bird they would not go out that day because rain".split()
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(300)]
    rows.append((999, " ".join("".join(rng.choice(list("qzxjwvkpg"), 6)) for _ in range(60)), "en"))
    got = {r.doc_id: r for r in N.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[999].perplexity > got[999].high_perplexity and not got[999].kept
    assert sum(r.kept for r in got.values()) >= 295


def test_chain_held_out(spark, small_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = G.fold("doc_id") == 0
    scored = C.toxicity(docs, labels.filter(~held))
    rows = scored.join(labels.filter(held).withColumnRenamed("toxic", "y"), "doc_id").collect()
    hit = sum(r.toxic and r.y == 1 for r in rows)
    assert hit >= 0.8 * sum(r.y == 1 for r in rows)
    assert sum(r.toxic and r.y == 0 for r in rows) <= 0.02 * sum(r.y == 0 for r in rows)
    assert scored.count() == docs.count()


def test_later_model_uses_out_of_fold_log_odds():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(30) < 0.2) for _ in range(400)]
    first = np.array([0 in r or 1 in r for r in rows])
    second = first ^ (rng.random(400) < 0.05)
    chain = C.fit_chain(rows, 30, np.column_stack([first, second]), np.arange(400) % C.FOLDS)
    assert chain[0]["v"].shape == (0,) and chain[1]["v"].shape == (1,) and chain[1]["v"][0] > 0
    p = C.predict_chain(chain, rows, 30)
    assert ((p > 0.5)[:, 0] == first).mean() > 0.95


def test_chain_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, None, 1), (None, 1, 1), (7, 0, 0), (7, 0, 1), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    odd = edge_docs.withColumn("p_toxic", F.lit("clash")).withColumn("id", F.lit(1))
    rows = C.toxicity(odd, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.p_toxic <= 1 for r in rows)
    assert C.toxicity(edge_docs, labels.limit(0)).count() == edge_docs.count()
    assert C.toxicity(no_docs, labels).count() == 0


def test_a_null_label_does_not_hide_the_others(spark):
    """Documents with a null quality teach the toxic model, and no others do."""
    words = "plain words about nothing much here today".split()
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words, 12)) + (" vileword" if i % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i % 5 == 0 else 1, int(i % 5 == 0)) for i in range(200)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.toxicity(docs, labels).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(300))
    some = labels.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, F.col("toxic")))
    assert {r.doc_id for r in C.toxicity(docs, some).collect() if r.toxic} == {i for i in range(0, 300, 5)}


def test_chain_scores_by_hand(spark, sf_small, small_docs, monkeypatch):
    """Every document's probabilities from the model's weights, one by one."""
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    categories = {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    model = C.train(small_docs, labels, categories)
    rows = {r.doc_id: r for r in C.with_categories(small_docs, model, keep=["doc_id"]).collect()}
    for d in small_docs.collect():
        at = [model["vocabulary"][f] for f in C.features_of(d.text) if f in model["vocabulary"]]
        odds = []
        for link in model["chain"]:
            z = sum(link["w"][i] for i in at) + sum(v * o for v, o in zip(link["v"], odds)) + link["bias"]
            odds.append(min(max(z, -30), 30))
        want = [1 / (1 + math.exp(-z)) for z in odds]
        assert [rows[d.doc_id].p_junk, rows[d.doc_id].p_toxic] == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(C, "FEATURES", None)
    assert len(C.train(small_docs, labels, categories)["vocabulary"]) >= len(model["vocabulary"])


def test_threshold():
    assert C.best_threshold(np.array([3.0, 1.0, -1.0, -2.0]), np.array([1.0, 1.0, 0.0, 0.0])) == 0.0
    assert C.best_threshold(np.array([1.0, 2.0]), np.zeros(2)) == 0.0
    assert math.isfinite(C.best_threshold(np.array([1.0]), np.array([1.0])))
