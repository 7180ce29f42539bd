"""DuckDB statements for the queries of this package."""

from loomgrid.llm.license import BASE, TEMPLATES
from loomgrid.llm.quality import BOILERPLATE

QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s FROM documents),
w AS (SELECT r, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY r),
ln AS (SELECT r, l FROM (SELECT r, unnest(string_split(s, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
judged AS (
  SELECT r, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    len(regexp_extract_all(l, '[|»›·•]')) > 2
    OR len(regexp_extract_all(l, '[!?]{{2,}}')) > 2
    OR len(regexp_extract_all(l, '[#*$%&<>{{}}~^=_\\]')) > 0.1 * length(l)
    OR (length(l) <= 160 AND regexp_matches(lower(l), '{"|".join(BOILERPLATE)}'))
    OR (NOT regexp_matches(l, '[[:punct:]…»”’。！？]') AND len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 40) AS bad
  FROM ln),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS dup, coalesce(sum(chars) FILTER (NOT bad), 0) AS good FROM judged GROUP BY r),
x AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(s, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(s, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(good, 0) AS good
  FROM t JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND good >= 0.5 * word_chars AS kept
FROM x
"""

_TEMPLATES = ", ".join(f"({t}, '{x.label}', '{x.words}', {x.need}, {x.band})" for t, x in enumerate(TEMPLATES))

LICENSES = rf"""
WITH tpl AS (SELECT t, label, string_split(words, ' ') AS tw, need, band FROM (VALUES {_TEMPLATES}) AS v(t, label, words, need, band)),
tg AS (SELECT t, need, band, len(tw) - 1 AS grams, i AS tpos, tw[i + 1] AS a, tw[i + 2] AS b
  FROM (SELECT *, unnest(generate_series(0, len(tw) - 2)) AS i FROM tpl)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i AS pos, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 2)) AS i FROM d)),
v AS (SELECT doc_id, t, pos - tpos AS diagonal, min(pos) AS lo, max(pos) + 2 AS hi, bit_or(CAST(1 AS BIGINT) << tpos) AS bits, any_value(grams) AS grams, any_value(need) AS need, any_value(band) AS band
  FROM g JOIN tg USING (a, b) GROUP BY doc_id, t, pos - tpos),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= band THEN 0 ELSE 1 END AS opens FROM v),
m AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS island FROM o),
s AS (SELECT doc_id, t, min(lo) AS start, max(hi) AS stop, bit_count(bit_or(bits)) / CAST(any_value(grams) AS DOUBLE) AS share, any_value(grams) AS grams, any_value(need) AS need
  FROM m GROUP BY doc_id, t, island),
ok AS (SELECT s.*, label FROM s JOIN tpl USING (t) WHERE share >= s.need AND stop - start <= 2 * (grams + 1)),
x AS (SELECT doc_id, count(*) FILTER (t < {len(BASE)}) AS n_base, min(start) FILTER (t < {len(BASE)}) AS first_word, max(start) FILTER (t < {len(BASE)}) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < {len(BASE)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM ok GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM d LEFT JOIN x USING (doc_id)
"""

_ESC = r"regexp_replace({}, '([<\[\\])', '\1\\', 'g')"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
f AS (SELECT *, CASE role WHEN 'system' THEN '[SYS] ' || {_ESC.format("text")} || '[/SYS]' || chr(10)
    WHEN 'user' THEN '[INST] ' || {_ESC.format("text")} || '[/INST]' WHEN 'assistant' THEN '[REPLY] ' || {_ESC.format("text")} || '</s>'
    ELSE '[ROLE] ' || {_ESC.format("role")} || '[/ROLE]' || {_ESC.format("text")} || '[/TURN]' END AS formatted,
  lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) || '>' || role IN
    ('start>system', 'start>user', 'system>user', 'assistant>user', 'user>assistant') AS ok FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  3 + sum(length(formatted)) AS formatted_chars,
  bool_and(ok) AND last(role ORDER BY turn, role, text) = 'assistant' AS valid
FROM f GROUP BY conv_id
"""
