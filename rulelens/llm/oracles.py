"""DuckDB SQL that gives the rows of those registered queries that SQL can express."""

from __future__ import annotations

from . import decontam, middle, suffixdup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Every 200-byte string by its digest; starts that another start shares are merged to runs, and the pieces between them are kept.
SUFFIXES = f"""WITH doc AS (SELECT row_number() OVER () AS d, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
cut AS (SELECT d, s, md5(raw[s + 1 : s + {suffixdup.LENGTH}]) AS h FROM (SELECT d, raw, unnest(range(0, octet_length(raw) - {suffixdup.LENGTH - 1})) AS s FROM doc)),
again AS (SELECT d, s FROM cut WHERE h IN (SELECT h FROM cut GROUP BY h HAVING count(*) > 1)),
edge AS (SELECT d, s, coalesce(s > lag(s) OVER (PARTITION BY d ORDER BY s) + {suffixdup.LENGTH}, TRUE) AS fresh FROM again),
run AS (SELECT d, s, count(*) FILTER (fresh) OVER (PARTITION BY d ORDER BY s ROWS UNBOUNDED PRECEDING) AS r FROM edge),
span AS (SELECT d, min(s) AS a, max(s) + {suffixdup.LENGTH} AS b, TRUE AS real FROM run GROUP BY d, r
  UNION ALL SELECT d, octet_length(raw), octet_length(raw), FALSE FROM doc),
piece AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY d ORDER BY a, b, real DESC), 0) AS since FROM span),
kept AS (SELECT d, sum(b - a) AS n_removed, count(*) FILTER (real) AS n_spans,
  string_agg(CASE WHEN a > since THEN hex(raw[since + 1 : a]) ELSE '' END, '' ORDER BY a, b, real DESC) AS left_over FROM piece JOIN doc USING (d) GROUP BY d)
SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(left_over)) AS kept_sha256
FROM doc JOIN kept USING (d)"""

_NEXT = ", ".join(f"lead(word, {i}) OVER o AS w{i}" for i in range(1, decontam.WINDOW))
_JOINED = " ".join(f"WHEN {k} THEN " + " || ' ' || ".join(["word", *(f"w{i}" for i in range(1, k))]) for k in range(1, decontam.WINDOW + 1))
_LATEST = ", ".join(f"max(CASE WHEN r = {k} THEN p END) OVER o AS l{k}" for k in range(1, decontam.NEAR_TERMS + 1))
_CLOSE = " AND ".join(f"(m < {k} OR coalesce(p - l{k} < {decontam.NEAR_SPAN}, FALSE))" for k in range(1, decontam.NEAR_TERMS + 1))

#: Windows of words as strings, joined by equality; proximity from the last places of an item's rarest words.
DECONTAMINATION = f"""WITH item AS (SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
term AS (SELECT b, item, least(len(w), {decontam.WINDOW}) AS k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM item),
windows AS (SELECT DISTINCT item, k, CASE k {_JOINED} END AS words FROM (SELECT *, {_NEXT} FROM term WINDOW o AS (PARTITION BY b ORDER BY p))),
doc AS (SELECT row_number() OVER () AS d, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
spot AS (SELECT d, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc),
led AS (SELECT *, {_NEXT} FROM spot WINDOW o AS (PARTITION BY d ORDER BY p)),
cut AS (SELECT d, p, k, CASE k {_JOINED} END AS words FROM led, (SELECT DISTINCT k FROM windows)),
hit AS (SELECT d, p, k, item FROM cut JOIN windows USING (k, words) WHERE words IS NOT NULL),
covered AS (SELECT d, count(DISTINCT q) AS n_hit FROM (SELECT d, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT d, p, k FROM hit)) GROUP BY d),
named AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT d, item FROM hit) GROUP BY d),
frequency AS (SELECT word, count(*) AS n FROM spot GROUP BY word),
rare AS (SELECT b, item, word, row_number() OVER (PARTITION BY b ORDER BY coalesce(n, 0), word) AS r, count(*) OVER (PARTITION BY b) AS m
  FROM (SELECT DISTINCT b, item, word FROM term) LEFT JOIN frequency USING (word) QUALIFY r <= {decontam.NEAR_TERMS}),
latest AS (SELECT d, item, m, p, {_LATEST} FROM spot JOIN rare USING (word) WINDOW o AS (PARTITION BY d, b ORDER BY p ROWS UNBOUNDED PRECEDING)),
close AS (SELECT d, count(DISTINCT item) AS n_near FROM latest WHERE {_CLOSE} GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM doc LEFT JOIN covered USING (d) LEFT JOIN named USING (d) LEFT JOIN close USING (d)"""

_MARKED = " OR ".join(f"contains(t, '{m}')" for m in middle.MARKS)
_DRAW = ", ".join(f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))

#: Units as a list, cut by its ranks; what is restored is the text itself.
MIDDLE = f"""WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
drawn AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, {_DRAW} FROM doc),
ranked AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR {_MARKED} OR h3 % 100 >= {middle.RATE} THEN 'plain' WHEN h4 % 100 < {middle.SPM} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT doc_id, t, n, form, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM ranked)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{middle.PREFIX}' || p || '{middle.SUFFIX}' || s || '{middle.MIDDLE}' || m ELSE '{middle.SUFFIX}' || s || '{middle.PREFIX}' || p || '{middle.MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM cut"""

ORACLES = {"op4_suffixes": SUFFIXES, "op5_decontamination": DECONTAMINATION, "op13_middle": MIDDLE}
