"""Registered queries for text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesight.functions.scalars import sentences
from tablesight.functions.stop_words import ENGLISH
from tablesight.operators import text as X
from tablesight.plans import standins as S
from tablesight.plans.registry import query, rounded

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

G20_SQL = rf"""
SELECT doc_id, length(text) AS chars,
       len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS words,
       CASE WHEN length(text) = 0 THEN 0
            ELSE len(regexp_extract_all(text, '{_BREAK}'))
                 + CASE WHEN regexp_matches(text, '({_BREAK})$') THEN 0 ELSE 1 END END AS lines
FROM documents"""


@query("g20_text_stats", G20_SQL)
def g20(spark, d):
    return X.text_stats(S.table(spark, d, "documents"), "text", ["doc_id"])


def _stop_sql() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)


def _keywords_sql(table: str, id_col: str, text_col: str, limit: str = "") -> str:
    return rf"""
WITH docs AS (SELECT {id_col} AS d, {text_col} AS text FROM {table} WHERE length({text_col}) > 0),
n AS (SELECT count(*) AS n FROM docs),
toks AS (SELECT d, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM toks WHERE term NOT IN ({_stop_sql()}) GROUP BY d, term),
tot AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT * FROM tot ORDER BY total DESC, term {limit}),
w AS (SELECT tf.d, tf.term, tf.tf * (ln((1 + n.n) / (1 + vocab.df)) + 1) AS w FROM tf JOIN vocab USING (term), n),
norms AS (SELECT d, sqrt(sum(w * w)) AS norm FROM w GROUP BY d)
SELECT term, round(sum(w / norm), 9) AS score FROM w JOIN norms USING (d)
GROUP BY term ORDER BY sum(w / norm) DESC, term LIMIT 25"""


@query("m11_top_keywords", _keywords_sql("documents", "doc_id", "text"))
def m11(spark, d):
    return rounded(X.top_keywords(S.table(spark, d, "documents"), "text"), {"score": 9})


@query("m11_top_keywords_vocabulary", _keywords_sql("documents", "doc_id", "text", "LIMIT 100"))
def m11v(spark, d):
    """The 100 most frequent terms only: rows are weighed where they lie."""
    return rounded(X.top_keywords(S.table(spark, d, "documents"), "text", max_features=100), {"score": 9})


@query("m11_top_keywords_conversations", _keywords_sql("conversations", "conv_id * 1000 + turn", "text"))
def m11b(spark, d):
    return rounded(X.top_keywords(S.table(spark, d, "conversations"), "text"), {"score": 9})


@query("f8_sentence_split", r"""
SELECT doc_id, count(*) AS sentences FROM (
  SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'),
         '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), '^\s+|\s+$', '', 'g') AS s
  FROM documents) WHERE length(s) > 0 GROUP BY doc_id""")
def f8(spark, d):
    docs = S.table(spark, d, "documents")
    return (docs.select("doc_id", F.size(sentences(F.col("text"))).alias("sentences"))
                .filter(F.col("sentences") > 0))


M12_SQL = rf"""
WITH base AS (SELECT doc_id AS d, text AS t FROM documents),
s1 AS (SELECT d, list_filter(list_transform(
          string_split(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
          lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS sents FROM base),
sents AS (SELECT d, unnest(range(len(sents))) AS sid, unnest(sents) AS sentence FROM s1),
n_sent AS (SELECT d, count(*) AS n FROM sents GROUP BY d),
toks AS (SELECT d, sid, list_filter(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}'),
                                    lambda x: NOT list_contains([{_stop_sql()}], x)) AS tk FROM sents),
terms AS (SELECT d, sid, unnest(list_concat(tk, list_transform(range(greatest(len(tk) - 1, 0)),
                                                               lambda i: tk[i + 1] || ' ' || tk[i + 2]))) AS term FROM toks),
tf AS (SELECT d, sid, term, count(*) AS tf FROM terms GROUP BY ALL),
per_term AS (SELECT d, term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL),
vocab AS (SELECT d, term, df FROM per_term),
w AS (SELECT tf.d, tf.sid, tf.tf * (ln((1 + n) / (1 + df)) + 1) AS w
      FROM tf JOIN vocab USING (d, term) JOIN n_sent USING (d)),
score AS (SELECT d, sid, CASE WHEN sum(w * w) > 0 THEN sum(w) / sqrt(sum(w * w)) END AS score FROM w GROUP BY ALL),
ranked AS (SELECT s.d, s.sid, s.sentence, coalesce(sc.score, 0.0) AS score
           FROM sents s LEFT JOIN score sc USING (d, sid)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY round(score, 9) DESC, sid) AS r FROM ranked)
        WHERE r <= 8),
long_docs AS (SELECT d, string_agg(sentence, ' ' ORDER BY sid) AS summary FROM top GROUP BY d)
SELECT b.d AS doc_id, CASE WHEN coalesce(n, 0) <= 3 THEN t ELSE summary END AS summary
FROM base b LEFT JOIN long_docs USING (d) LEFT JOIN n_sent USING (d)"""


@query("m12_extractive_summary", M12_SQL)
def m12(spark, d):
    return X.extractive_summary(S.table(spark, d, "documents"), "text", ["doc_id"])
