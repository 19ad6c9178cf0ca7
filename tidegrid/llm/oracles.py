"""DuckDB SQL for the corpus queries that SQL can express."""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\2\\\3', 'g') AS safe FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  (3 + sum(19 + length(role) + length(safe)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

UNITS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, md5(text) AS digest, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
cut AS (
  SELECT r, doc_id, digest, i - 1 AS unit, parts[i] AS line, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) AS start
  FROM docs, range(1, len(parts) + 1) AS k(i)),
lines AS (SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')) AS norm FROM cut),
marked AS (SELECT *, sum((norm = '')::INTEGER) OVER (PARTITION BY r ORDER BY unit) AS para FROM lines),
units AS (
  SELECT r, doc_id, digest, unit, unit AS last, start, length(line) AS length, norm FROM lines WHERE norm <> ''
  UNION ALL
  SELECT r, doc_id, digest, min(unit), max(unit), min(start), max(start + length(line)) - min(start), string_agg(norm, ' ' ORDER BY unit)
  FROM marked WHERE norm <> '' GROUP BY r, doc_id, digest, para HAVING count(*) > 1),
ranked AS (
  SELECT *, len(string_split(norm, ' ')) AS n_words, first_value(doc_id) OVER o AS first_doc_id, row_number() OVER o AS k, count(*) OVER (PARTITION BY norm) AS copies
  FROM units WINDOW o AS (PARTITION BY norm ORDER BY doc_id NULLS FIRST, digest, r, start, length)),
late AS (SELECT * FROM ranked WHERE k > 1)"""

SUBSTRING_UNITS = UNITS + """
SELECT doc_id, unit::INTEGER AS unit, last::INTEGER AS last, start::INTEGER AS start, length::INTEGER AS length, n_words::INTEGER AS n_words, first_doc_id, copies::BIGINT AS copies
FROM late
"""

SUBSTRING = UNITS + """,
dead AS (SELECT DISTINCT r, unnest(generate_series(unit, last)) AS unit FROM late),
full_lines AS (SELECT l.r, l.unit, l.start, length(l.line) AS length, len(string_split(l.norm, ' ')) AS w, d.unit IS NOT NULL AS gone FROM lines l LEFT JOIN dead d ON d.r = l.r AND d.unit = l.unit WHERE l.norm <> ''),
islands AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY unit) - row_number() OVER (PARTITION BY r, gone ORDER BY unit) AS island FROM full_lines),
spans AS (SELECT r, min(start) AS start, max(start + length) - min(start) AS length, sum(w) AS w FROM islands WHERE gone GROUP BY r, island),
cuts AS (SELECT r, max(w) AS longest, string_agg(start || '+' || length, ',' ORDER BY start) AS spans FROM spans GROUP BY r),
sums AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sum(w) AS n_words, coalesce(sum(w) FILTER (gone), 0) AS removed_words FROM full_lines GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(removed_words, 0)::BIGINT AS removed_words,
  coalesce(longest, 0)::BIGINT AS longest_removed, coalesce(longest, 0) > 50 AS repeats_passage, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN sums USING (r) LEFT JOIN cuts USING (r)
UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, false, '' FROM documents WHERE text IS NULL
"""

DECONTAMINATE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win FROM b, range(1, greatest(len(ws) - 8, 2)) AS k(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
long AS (SELECT r, n, ws FROM d, sizes WHERE len(ws) >= n),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM long, range(1, len(ws) - n + 2) AS k(i)),
hit AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, win)),
inside AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN inside USING (r) LEFT JOIN items USING (r)
"""

NEARDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[i:i + 3], ' ') ELSE array_to_string(ws, ' ') END AS sh
  FROM w, range(1, greatest(len(ws) - 2, 2)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

PASSAGES = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text)) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, array_to_string(ws[i:i + 50], ' ') AS win FROM d, range(1, len(ws) - 49) AS k(i) WHERE len(ws) > 50),
late AS (SELECT r, i FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY r, i) > 1),
dead AS (SELECT DISTINCT r, unnest(range(i, i + 51)) AS p FROM late),
islands AS (SELECT r, p - row_number() OVER (PARTITION BY r ORDER BY p) AS island FROM dead),
cuts AS (SELECT r, count(*) AS w FROM islands GROUP BY r, island),
sums AS (SELECT r, sum(w)::BIGINT AS repeated_words, max(w) AS longest, count(*) AS n_passages FROM cuts GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(repeated_words, 0)::BIGINT AS repeated_words, coalesce(longest, 0)::BIGINT AS longest, coalesce(n_passages, 0)::INTEGER AS n_passages, n_passages IS NOT NULL AS repeats_passage
FROM d LEFT JOIN sums USING (r)
"""

ORACLES = {"op5_passages": PASSAGES, "op9_decontaminate": DECONTAMINATE, "op5_substring_units": SUBSTRING_UNITS, "op1_topk": TOPK, "op3_neardup": NEARDUP, "op5_substring": SUBSTRING, "op10_chat": CHAT}
