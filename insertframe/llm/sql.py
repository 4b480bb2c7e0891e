"""DuckDB SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from .perspectives import PART_TURNS

#: A participant's rendering of each part of a dialogue, and the spans of its own turns.
CHAT = rf"""
WITH numbered AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, (pos // {PART_TURNS})::bigint AS part FROM numbered),
sys AS (SELECT * FROM turns WHERE who = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos) <= {PART_TURNS}),
t AS (SELECT conv_id, part, 1 AS own, pos, who, text FROM turns
  UNION ALL SELECT p.conv_id, p.part, 0, pos, who, text FROM (SELECT DISTINCT conv_id, part FROM turns) p JOIN sys ON p.conv_id = sys.conv_id AND sys.part < p.part),
people AS (SELECT DISTINCT conv_id, who AS participant FROM t WHERE who <> 'system'),
pieces AS (
  SELECT t.conv_id, t.part, own, participant, pos, who, text, who = participant AS mine,
    '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = participant THEN 'assistant'
      ELSE 'user name=' || replace(replace(who, chr(10), ' '), '<|', '<||') END || chr(10) AS head,
    replace(text, '<|', '<||') || '<|im_end|>' AS body
  FROM t JOIN people ON t.conv_id = people.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS a, sum(length(head) + length(body) + 1) OVER w - 1 AS b,
    row_number() OVER w AS n
  FROM pieces WINDOW w AS (PARTITION BY conv_id, part, participant ORDER BY own, pos ROWS UNBOUNDED PRECEDING))
SELECT conv_id, participant, part, sum(own)::bigint AS n_turns, count_if(mine)::bigint AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY n) AS rendering,
  coalesce(string_agg(a::bigint || ':' || b::bigint, ',' ORDER BY n) FILTER (mine), '') AS mask
FROM placed GROUP BY conv_id, participant, part
"""

_SPACE = r"[ \t\n\x0B\f\r]"
_LETTER = r"\pL"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents),
m AS (
  SELECT doc_id, t, w, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls,
    length(t) - length(replace(t, '!', '')) AS bangs
  FROM d),
grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
v AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    n_symbols > 0.1 * n_words OR NOT (word_chars BETWEEN 2.0 * n_words AND 14.0 * n_words) OR bangs > 0.25 * n_words
    OR len(list_filter(w, lambda x: regexp_matches(x, '{_LETTER}'))) < 0.7 * n_words
    OR len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[•*-]\s'))) > 0.9 * len(ls)
    OR len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 0.3 * len(ls) AS rejected
  FROM m LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
  n_repeat_words::bigint AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT rejected AS kept
FROM v
"""
