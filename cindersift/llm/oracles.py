"""DuckDB SQL for the queries of this subpackage that SQL expresses on whole tables in reasonable time."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n i ON a = i.doc_id JOIN n j ON b = j.doc_id WHERE 100 * k >= 85 * (i.n + j.n - k)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT t.b, c.r FROM c JOIN t ON c.doc_id = t.a)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, c.doc_id = min(r) AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id
"""

_ESCAPED = r"regexp_replace(regexp_replace({}, '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g'), '(<)(\\*)(/?s>)', '\1\\\2\3', 'g')"

OP7 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE WHEN role = 'assistant' THEN 7 + length({_ESCAPED.format("text")}) ELSE 16 + length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || 's'), chr(10), chr(92) || 'n')")}) + length({_ESCAPED.format("text")}) END AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM t),
g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(prefix) FILTER (role = 'assistant' OR i = m))::BIGINT AS formatted_chars FROM g GROUP BY conv_id
"""

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN v ON w.lang = v.lang AND w.term = v.term GROUP BY ALL),
m AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(m.n, 0) + 2 * l.v) AS p, 1 + (1000000000 * (v.n + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN v ON g.lang = v.lang JOIN l ON g.lang = l.lang LEFT JOIN m ON g.lang = m.lang AND g.source = m.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND v.term = c.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""

_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda t: ascii(t)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP13 = rf"""
WITH o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, {_CRC} % 4 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(t) AS total, t, unnest(range(0, len(t) + 1)) AS depth FROM r),
m AS (SELECT conv_id, total, depth, min(conv_id) OVER (PARTITION BY depth, t[1:depth]) AS node, CASE WHEN depth > 0 THEN len(regexp_extract_all(t[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM p),
n AS (SELECT depth, node, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '') AS ends FROM m GROUP BY depth, node),
k AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
c AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS kids FROM k WHERE depth > 0 GROUP BY ALL),
l AS (SELECT k.*, coalesce(c.kids, 0) AS kids FROM k LEFT JOIN c ON c.depth = k.depth AND c.node = k.node),
s AS (SELECT a.depth, a.node, sum(CASE WHEN l.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((l.n_convs - 1) * l.words) AS saved FROM l JOIN m a ON a.conv_id = l.node AND a.depth <= l.depth GROUP BY a.depth, a.node)
SELECT l.node AS conv_id, l.depth, l.parent AS parent_conv_id, l.n_convs, l.kids AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(l.ends) AS ends_sha256 FROM l JOIN s ON s.depth = l.depth AND s.node = l.node
"""

ORACLES = {"op13_conversation_trie": OP13, "op11_source_divergence": OP11, "op4_minhash_near_dedup": OP4, "op7_chat_formatting": OP7}
