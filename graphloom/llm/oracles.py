"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT w.doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines FROM w JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
r AS (SELECT *, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS word_len, CASE WHEN n_words > 0 THEN 1000 * n_symbols // word_chars END AS symbols, CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_lines, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeats FROM m),
u AS (SELECT lang, source, unnest([{{'rate': 'word_len', 'v': word_len}}, {{'rate': 'symbols', 'v': symbols}}, {{'rate': 'dup_lines', 'v': dup_lines}}, {{'rate': 'repeats', 'v': repeats}}]) AS x FROM r WHERE n_words > 0),
b AS (SELECT lang, source, x.rate AS rate, CASE WHEN x.v < 32 THEN x.v ELSE (length(bin(x.v)) - 5) * 32 + (x.v >> (length(bin(x.v)) - 6)::INT) - 32 END AS bin, count(*) AS n FROM u GROUP BY ALL),
lv AS (SELECT 's' AS lv, lang, source, rate, bin, n FROM b UNION ALL SELECT 'l', lang, NULL, rate, bin, sum(n) FROM b GROUP BY lang, rate, bin UNION ALL SELECT 'g', NULL, NULL, rate, bin, sum(n) FROM b GROUP BY rate, bin),
c AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, rate) AS total FROM lv),
q AS (SELECT lv, lang, source, rate, max(total) AS members, min(bin) FILTER (upto * 4 >= total) AS b1, min(bin) FILTER (upto * 4 >= total * 3) AS b3 FROM c GROUP BY ALL),
v AS (SELECT lv, lang, source, rate, members, CASE WHEN b1 < 32 THEN b1 ELSE (b1 % 32 + 32) << ((b1 >> 5) - 1) END AS q1, CASE WHEN b3 < 32 THEN b3 ELSE (b3 % 32 + 32) << ((b3 >> 5) - 1) END AS q3 FROM q),
p AS (SELECT s.lang, s.source, s.rate, CASE WHEN s.members >= 200 THEN s.q1 WHEN l.members >= 200 THEN l.q1 ELSE g.q1 END AS q1, CASE WHEN s.members >= 200 THEN s.q3 WHEN l.members >= 200 THEN l.q3 ELSE g.q3 END AS q3
  FROM v s JOIN v l ON l.lv = 'l' AND l.lang IS NOT DISTINCT FROM s.lang AND l.rate = s.rate JOIN v g ON g.lv = 'g' AND g.rate = s.rate WHERE s.lv = 's'),
f AS (SELECT lang, source, rate, q1 - 3 * greatest(q3 - q1, least) AS low, q3 + 3 * greatest(q3 - q1, least) AS high FROM (SELECT *, CASE rate WHEN 'word_len' THEN 30 WHEN 'symbols' THEN 10 ELSE 100 END AS least FROM p)),
k AS (SELECT lang, source, max(low) FILTER (rate = 'word_len') AS wl, max(high) FILTER (rate = 'word_len') AS wh, max(high) FILTER (rate = 'symbols') AS sh, max(high) FILTER (rate = 'dup_lines') AS dh, max(high) FILTER (rate = 'repeats') AS rh FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(word_len BETWEEN wl AND wh AND symbols <= sh AND dup_lines <= dh AND repeats <= rh, FALSE) AS kept, word_len, symbols, dup_lines, repeats
FROM r LEFT JOIN k ON r.lang IS NOT DISTINCT FROM k.lang AND r.source IS NOT DISTINCT FROM k.source
"""

CHAT_TREE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 20 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SOURCE_MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT AS k, coalesce(doc_id::VARCHAR, '') AS name FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank % 3 + 1)::INT] AS w FROM s),
t AS (SELECT 1.5::DOUBLE * sum(s) AS total, sum(w) FILTER (s > 0) AS all_w FROM w),
o AS (SELECT source, s, w, coalesce(sum(2 * s) OVER (ORDER BY s / w::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, coalesce(sum(w) OVER (ORDER BY s / w::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, row_number() OVER (ORDER BY s / w::DOUBLE, rank) AS i FROM w WHERE s > 0),
l AS (SELECT (total - held) / (all_w - gone) AS level, i FROM o, t WHERE 2 * s > w * ((total - held) / (all_w - gone)) ORDER BY i LIMIT 1),
g AS (SELECT w.source, s, least(s * 2.0::DOUBLE, w.w * level::DOUBLE) AS target FROM w, l),
p AS (SELECT source, s, target, CASE WHEN s > 0 THEN floor(target)::BIGINT // s ELSE 0 END AS epochs, CASE WHEN s > 0 THEN floor(target)::BIGINT % s ELSE 0 END AS rest FROM g),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, name, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT r.doc_id, r.size, p.s AS source_size, round(target, 6) AS target, (r.size * epochs + least(greatest(rest - before, 0), r.size))::BIGINT AS taken FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
"""
