"""DuckDB SQL of the corpus queries that SQL can state, written from their
contracts: plain grouping and brute force, not the operators' methods."""

from __future__ import annotations

from tablesight.llm.va_file import CLUSTERS, DIMENSIONS, ROUNDS, SCALE


def filter_interactions() -> str:
    letters = "ABCDE"
    perms = ", ".join(f"f{i} AS (SELECT x AS x{i} FROM letters)" for i in range(5))
    joins = "f0"
    for i in range(1, 5):
        joins += f" JOIN f{i} ON x{i} NOT IN ({', '.join(f'x{j}' for j in range(i))})"
    mask = " + ".join(f"CASE WHEN contains(before, '{x}') THEN {1 << i} ELSE 0 END" for i, x in enumerate(letters))
    bits = " + ".join(f"CASE WHEN fails_{x} THEN {1 << i} ELSE 0 END" for i, x in enumerate(letters))
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
v AS (
  SELECT doc_id, part, len(words) < 200 AS fails_A,
         100 * len(list_distinct(words)) < 50 * len(words) AS fails_B,
         100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * len(body) AS fails_C,
         regexp_matches(body, '[#$%&*|]') AS fails_D,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS fails_E FROM w),
l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
p AS (
  SELECT part, {bits} AS failing, count(*) AS n, count(*) FILTER (WHERE good) AS good,
         count(*) FILTER (WHERE toxic) AS toxic
  FROM v LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), {perms},
orders AS (SELECT x0 || x1 || x2 || x3 || x4 AS filter_order FROM {joins}),
s AS (
  SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS f,
         substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT filter_order, step, f, {mask} AS prefix, 1 << (ascii(f) - 65) AS own FROM s),
c AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (WHERE failing & (prefix | own) = 0) AS kept,
         sum(n) FILTER (WHERE failing & prefix = 0 AND failing & own <> 0) AS removed,
         sum(n) FILTER (WHERE failing & prefix <> 0 AND failing & own <> 0) AS redundant,
         sum(n) FILTER (WHERE failing = own) AS unique_fails,
         sum(good) FILTER (WHERE failing & prefix = 0 AND failing & own <> 0) AS good_lost,
         sum(toxic) FILTER (WHERE failing & prefix = 0 AND failing & own <> 0) AS toxic_lost
  FROM p, m GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM c"""


def centroid_clusters() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS (
  SELECT v.rid, c.c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)]) AS distance
  FROM v, c{r} c),
a{r} AS (
  SELECT rid, c, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1)""")
        if r < ROUNDS:
            steps.append(f"""e{r} AS (
  SELECT c, i, sum(q[i]) AS s, count(*) AS n
  FROM (SELECT a.c, v.q, unnest(range(1, {DIMENSIONS + 1})) AS i FROM a{r} a JOIN v USING (rid)) GROUP BY c, i),
n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM e{r} GROUP BY c),
c{r + 1} AS (SELECT c.c, coalesce(n.q, c.q) AS q FROM c{r} c LEFT JOIN n{r} n ON c.c = n.c)""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS q
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS}
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), q) - 1 AS c, q FROM v
  ORDER BY c LIMIT {CLUSTERS}),
{", ".join(steps)}
SELECT v.vec_id, a.c::INTEGER AS cluster, a.distance::BIGINT AS distance,
       sum(a.distance) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(a.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (rid) JOIN c{ROUNDS} c ON c.c = a.c"""


def page_records() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (
  SELECT page_id, strlen(html) AS n, sha1(html) AS digest,
         CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS largest FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest = page_id THEN NULL ELSE largest END AS refers_to
FROM g"""
