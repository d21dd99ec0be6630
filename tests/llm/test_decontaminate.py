"""Q-gram lemma filtering (10) against an alignment of every segment with every text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesight.llm import decontaminate as D
from tablesight.llm import queries as Q

EN = "the cat and the dog were in the house with a bird and they would not go out that day because of rain"

def folded(text):
    return " ".join((text or "").lower().split())


def nearest(pattern, text):
    """Fewest edits between the pattern and any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    letters = np.array([ord(c) for c in text])
    ramp = np.arange(len(text) + 1)
    for i, c in enumerate(pattern):
        step = np.minimum(row + 1, np.append(i + 1, row[:-1] + (letters != ord(c))))
        row = np.minimum.accumulate(step - ramp) + ramp
    return int(row.min())


def segments(item):
    body = folded(item)
    if len(body) < D.Q:
        return []
    last = max(0, len(body) - D.SEGMENT)
    return [body[s:s + D.SEGMENT] for s in sorted({*range(0, last + 1, D.SEGMENT // 2), last})]


def budget(segment):
    edits = len(segment) // D.EDIT_SHARE
    return edits if len(segment) - D.Q + 1 > D.Q * edits else 0


def brute(docs, items):
    out = {}
    for d, text in docs:
        t = folded(text)
        for i, item in items:
            edits = [nearest(s, t) if t else 99 for s in segments(item)]
            body = folded(item)
            if any(e <= budget(s) for e, s in zip(edits, segments(item))):
                out[d, i] = min(edits)
            elif len(body) < D.Q and t == body:
                out[d, i] = 0
            elif len(body) > D.PASSAGE and any(body[s:s + D.PASSAGE] in t for s in range(len(body) - D.PASSAGE + 1)):
                out[d, i] = 0
    return out


def test_query_against_alignment(spark, sf_small, small_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in small_docs.collect()]
    rows = Q.op10_qgram_decontamination(spark, sf_small).collect()
    texts = dict(docs)
    some = [d for d in docs if len(d[1]) < 1500 or d[0] in {r.doc_id for r in rows}][:60]
    chosen = {d for d, _ in some}
    assert {(r.doc_id, r.item_id): r.edits for r in rows if r.doc_id in chosen} == brute(some, items)
    assert rows
    for r in rows:
        if r.edits == 0 and r.segments == r.item_segments:
            assert folded(dict(items)[r.item_id]) in folded(texts[r.doc_id][r.start:r.end])


def test_edits_up_to_the_budget_are_found():
    rng = random.Random(4)
    alphabet = "abcdefgh ijklmnop"
    items = [(i, "".join(rng.choice(alphabet) for _ in range(n)).strip().replace("  ", " x"))
             for i, n in enumerate([40, 60, 96, 97, 200, 400])]
    docs = []
    for k in range(60):
        _, item = items[k % len(items)]
        body = list(segments(item)[0])
        for _ in range(rng.randrange(0, len(body) // D.EDIT_SHARE + 3)):
            body[rng.randrange(len(body))] = rng.choice(["", "Q", "zz"])
        docs.append((k, "some words before " + "".join(body) + " and after"))
    index = D.SegmentIndex(items)
    got = {(d, h[0]): h[3] for (d, _), hits in zip(docs, index.find([t for _, t in docs])) for h in hits}
    assert got == brute(docs, items)


def test_passages_cut_at_every_offset_are_found():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    item = " ".join(word() for _ in range(60))[:300].strip()
    index = D.SegmentIndex([(7, item), (8, "another item of no more than one segment")])
    for edits in (0, 4):
        texts = []
        for at in range(len(item) - D.SEGMENT + 1):
            body = list(item[at:at + D.SEGMENT])
            for _ in range(edits):
                body[rng.randrange(1, len(body) - 1)] = "Q"
            texts.append(f"{word()} before {''.join(body).strip()} and {word()}")
        found = index.find(texts)
        assert all(len(h) == 1 and h[0][0] == 7 and h[0][3] <= 8 for h in found)
        for t, ((_, _, _, _, start, end),) in zip(texts, found):
            assert 0 <= start < end <= len(t) and (edits or folded(t[start:end]) in item)
        assert [index.find([t])[0] for t in texts[::20]] == found[::20]


@pytest.mark.parametrize("length", [40, 45, 50, 60, 70, 80, 90])
def test_short_passages_cut_at_every_offset_are_found(length):
    """Recall 1 over verbatim passages from PASSAGE characters on; none just below it."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    item = " ".join(word() for _ in range(60))[:300].strip()
    index = D.SegmentIndex([(7, item), (8, " ".join(word() for _ in range(12))[:95])])
    for n in (length, D.PASSAGE - 4):
        texts = [f"QQ {item[at:at + n].upper().strip()}  ZZ" for at in range(len(item) - n + 1)]
        found = index.find(texts)
        if n < D.PASSAGE:
            assert not any(found)
            continue
        for t, hits in zip(texts, found):
            (item_id, _, _, edits, start, end), = hits
            assert item_id == 7 and edits <= 8 and 0 <= start < end <= len(t)


def test_short_items_are_found():
    items = [(1, "what is 2+2? answer: 4"), (2, "name the capital"), (3, "yes"), (4, "a longer item of about forty characters"),
             (5, "twelve chars"), (6, ""), (None, "  YES ")]
    texts = ["so WHAT is 2+2?  Answer: 4, he said", "what is 2+3? answer: 4", "name tha capital", "twelve chars!", "twelve-chars",
             " Yes\n", "yes and no", "", None, "nothing of the kind", "a longer item of abaut forty characters"]
    got = {(k, h[0]): h[3] for k, hits in enumerate(D.searcher(items)(texts)) for h in hits}
    want = brute(list(enumerate(texts)), [(i, t) for i, t in items if t])
    assert got == {k: e for k, e in want.items()}
    assert {(0, 1), (1, 1), (2, 2), (3, 5), (5, 3), (5, None), (10, 4)} == set(got)


def test_edge_rows(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, EN), (2, EN), (3, None), (4, ""), (5, "short"), (None, EN.upper())], "item_id long, text string")
    rows = D.benchmark_leaks(edge_docs, bench).collect()
    holding = sum(EN in (r.text or "") for r in edge_docs.collect())
    assert len(rows) == 3 * holding
    kept = D.without_leaks(edge_docs.withColumn("leaks", F.lit(1)), bench)
    assert kept.count() == edge_docs.count() - holding and "leaks" in kept.columns
    assert D.benchmark_leaks(no_docs, bench).count() == 0
    assert D.benchmark_leaks(edge_docs, bench.limit(0)).count() == 0


def test_blocks_do_not_matter(spark, sf_small, monkeypatch):
    whole = sorted(Q.op10_qgram_decontamination(spark, sf_small).collect())
    monkeypatch.setattr(D, "BLOCK_CHARS", 4000)
    assert sorted(Q.op10_qgram_decontamination(spark, sf_small).collect()) == whole


def test_a_region_never_spans_two_texts():
    item = "one two three four five six seven eight nine ten"
    index = D.SegmentIndex([(1, item)])
    assert index.find([item[:24], item[24:], item])[:2] == [[], []]
    assert index.find([item])[0][0][3] == 0


@pytest.mark.parametrize("text", ["İstanbul " * 30, "\0" * 50, "a" * 200])
def test_odd_texts(text):
    D.SegmentIndex([(1, "İstanbul " * 10)]).find([text, "", None])
