"""DuckDB SQL of the queries of this package that SQL can express."""

OP4 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s
  FROM worded WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id AND 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = d.doc_id), d.doc_id)) AS component_id,
       (SELECT count(*) FROM links l WHERE l.x = d.doc_id)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

OP6 = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), lens AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
item AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM iw WHERE len(w) > 0
), doc AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM dw, lens WHERE len(w) >= k
), q AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id)
SELECT d.doc_id, i.item_id, count(*)::BIGINT AS n_shared, n_item::BIGINT AS n_item, count(*) / n_item AS containment
FROM doc d JOIN item i ON d.s = i.s JOIN q ON q.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n_item
HAVING count(*) >= round(0.8 * n_item, 6)
"""

OP7 = r"""
WITH said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), whole AS (
  SELECT conv_id, count(*) AS n, list(md5(concat(place, chr(1), role, chr(1), text)) ORDER BY place) AS h FROM said GROUP BY conv_id
), firsts AS (
  SELECT min(conv_id) AS conv_id, n, h, count(*) AS n_copies FROM whole GROUP BY n, h
), kept AS (
  SELECT a.* FROM firsts a WHERE NOT EXISTS (SELECT 1 FROM firsts b WHERE b.n > a.n AND b.h[1] = a.h[1] AND b.h[1:a.n] = a.h)
)
SELECT k.conv_id, k.n::BIGINT AS n_turns, k.n_copies::BIGINT AS n_copies,
       string_agg('<|im_start|>' || regexp_replace(s.role, '[\s<|>]+', '_', 'g') || chr(10)
         || replace(replace(s.text, '<|im_start|>', '<|' || chr(8203) || 'im_start|>'), '<|im_end|>', '<|' || chr(8203) || 'im_end|>')
         || '<|im_end|>' || chr(10), '' ORDER BY s.place) AS chat
FROM kept k JOIN said s USING (conv_id) GROUP BY ALL
"""

OP9 = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
