"""DuckDB SQL for the training-data queries that SQL can express, over whole tables."""

#: The bytes of a SHA-1 digest as 160 bits, five at a time, are its base32 digits.
OP3 = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, sha1(payload) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d GROUP BY digest),
b AS (SELECT digest, first, unhex(digest)::BIT::VARCHAR AS bits FROM f)
SELECT d.page_id, d.payload_bytes::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce([0] || [CASE WHEN substr(b.bits, 5 * k + j, 1) = '1' THEN 1 ELSE 0 END FOR j IN range(1, 6)], lambda x, y: 2 * x + y)::INTEGER, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN d.page_id IS NOT DISTINCT FROM b.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id IS NOT DISTINCT FROM b.first THEN NULL ELSE b.first END AS refers_to,
  d.url
FROM d JOIN b USING (digest)
"""

#: Cosines of all pairs; links are followed from every vector to a fixed point.
OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
),
s AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.95),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, vec_id) AS component_id, coalesce(c.component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

#: Sets of five-word shingles joined by shingle; links are followed from every document to a fixed point.
OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT g.doc_id, g.shingle, n.n FROM g JOIN n USING (doc_id)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS sizes, count(*) AS common FROM k a JOIN k b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
h AS (SELECT a, b FROM i WHERE 100 * common >= 75 * (sizes - common)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, doc_id) AS component_id, coalesce(c.component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL = {"op3_warc": OP3, "op5_multi_index": OP5, "op6_minhash": OP6}
