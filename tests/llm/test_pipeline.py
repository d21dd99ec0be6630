"""The pipeline against plain versions of its stages, and its registration."""

import hashlib
import re

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F
from tablesight.llm import simhash_pivots as S
from tablesight.llm import byte_gru as G
from tablesight.llm import decontaminate as D
from tablesight.llm import markov_secrets as M


def secrets(text):
    """Outermost base spans by plain regular expressions."""
    found = [m.span() for m in re.finditer(
        r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", text)]
    found += [m.span() for m in re.finditer("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", text)]
    return [(a, 0, b) for a, b in sorted(set(found)) if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in found)]


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, sf_small, small_docs, exact_encoding):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_small).collect()}
    docs = {r.doc_id: r for r in small_docs.collect()}
    model = G.train(G.training_windows(small_docs))
    p = G.Labeller(model).probabilities([d.text for d in docs.values()])
    kept = [i for i, row in zip(docs, p) if row.max() >= corpus_pipeline.MIN_LANGUAGE_SCORE and any(map(str.isalpha, docs[i].text))]
    fps = [S.text_fingerprint(docs[i].text) for i in kept]
    forest = S.Forest(len(kept))
    for a in range(len(kept)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                forest.join(a, b)
    seen = [i for a, i in enumerate(kept) if forest.find(a) == a]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    index = D.SegmentIndex(bench)
    left = [i for i, hits in zip(seen, index.find([docs[i].text for i in seen])) if not hits]
    assert sorted(rows) == sorted(left)
    for i in left:
        text = docs[i].text
        for start, _, end in secrets(text)[::-1]:  # no random runs and no overlaps in these rows
            text = text[:start] + "<SECRET>" + text[end:]
        ids = exact_encoding.encode_ordinary(text)
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_filtering_stages_keep_columns(spark, sf_small, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, sf_small)
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes, name
        assert corpus_pipeline.STAGES[-1][1](spark, out, sf_small).count() <= docs.count()


def test_no_secret_is_left(spark, sf_small, small_docs):
    clean = corpus_pipeline.redact_secrets(spark, small_docs, sf_small)
    assert clean.count() == small_docs.count()
    for r in M.scan(clean).collect():
        assert r.n_assign == r.n_access == r.n_hex == 0
    assert clean.filter("n_chars <> length(text)").count() == 0


def test_clashing_names_pass_through(spark, sf_small, edge_docs):
    """Extra columns named like the operators' outputs and helpers keep their values."""
    extra = ["lang_pred", "score", "fp", "__row", "__doc", "__id", "__best", "spans", "base_spans", "__t", "__leaks", "__more",
             "leaks", "Fingerprint", "__text_of_row"]
    docs = edge_docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
                                  for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows
        for r in rows:
            assert all(r[c] == f"{c}-{'?' if r.doc_id is None else r.doc_id}" for c in extra), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).count() == docs.count()
