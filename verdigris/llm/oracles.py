"""DuckDB SQL for the queries of this subpackage that SQL can express.

Without SQL: op2 (mined rules), op4 (sampled fingerprints), op6 (a tokenizer's ids), op7 (offsets of matches), op9 (apportioned blocks in a seeded order) and op10 (a trained model). Tests hold these against brute force, exact round trips or held-out accuracy.
"""

SQL: dict[str, str] = {}

SQL["op1_preference_format"] = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), same AS (
  SELECT c.pair_id, c.i, row_number() OVER (PARTITION BY c.pair_id ORDER BY c.i) AS k
  FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.side = 0 AND r.side = 1 AND c.i = r.i AND c.role = r.role AND c.text = r.text
), p AS (
  SELECT pair_id, CAST(coalesce(max(n), 0) AS INTEGER) AS n_prefix
  FROM (SELECT DISTINCT pair_id FROM t) LEFT JOIN (SELECT pair_id, count(*) AS n FROM same WHERE i = k GROUP BY pair_id) USING (pair_id) GROUP BY pair_id
), r AS (
  SELECT t.*, n_prefix, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN p USING (pair_id)
), s AS (
  SELECT *, sum(length(head) + length(body)) FILTER (WHERE i > n_prefix) OVER (PARTITION BY pair_id, side ORDER BY i) AS stop FROM r
)
SELECT pair_id, any_value(n_prefix) AS n_prefix,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= n_prefix), '') AS prompt,
  CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 0 AND i > n_prefix), '') END AS chosen,
  CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 1 AND i > n_prefix), '') END AS rejected,
  CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY i) FILTER (WHERE side = 0 AND i > n_prefix AND role = 'assistant'), '') END AS chosen_mask,
  CASE WHEN count(*) FILTER (WHERE side = 1) > 0 THEN coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY i) FILTER (WHERE side = 1 AND i > n_prefix AND role = 'assistant'), '') END AS rejected_mask
FROM s GROUP BY pair_id
"""

SQL["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\x0c\r]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, arg_max(doc_id, (n_cp, -doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

SQL["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

SQL["op8_warc_index"] = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM g
"""
