"""SQL that must give the same rows as the queries of the corpus operators."""

from __future__ import annotations

from jobmart.llm.common import LOWER, UPPER
from jobmart.llm.licenses import statements

HOST_RULES = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT r, doc_id, source, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), spots AS (
  SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM cut
), found AS (
  SELECT r, i FROM spots
  QUALIFY count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS c FROM found, range(0, 5) AS of_window(k) GROUP BY r
), measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT)
           AS n_symbols,
         len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words
         OR 2 * n_dup_lines > n_lines OR word_chars > 30 * n_words AS own_failed
  FROM measured
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (own_failed) AS failed
  FROM judged WHERE source IS NOT NULL GROUP BY source
), mean AS (
  SELECT sum(failed) / sum(n) AS mean FROM hosts
), spread AS (
  SELECT any_value(mean) AS mean,
         avg((failed / n - mean) * (failed / n - mean) - mean * (1 - mean) / n) AS between_hosts
  FROM hosts, mean
), prior AS (
  SELECT mean, least(1000.0, greatest(1.0, CASE WHEN between_hosts > 0
           THEN mean * (1 - mean) / between_hosts - 1 ELSE 1000.0 END)) AS strength
  FROM spread
), shrunk AS (
  SELECT source, n + strength AS weight, (failed + mean * strength) / (n + strength) AS rate
  FROM hosts, prior
), rejected AS (
  SELECT source FROM shrunk WHERE rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT own_failed AND rejected.source IS NULL AS kept
FROM judged LEFT JOIN rejected ON judged.source = rejected.source
"""

_STATEMENTS = ", ".join(
    f"('{label}', {n}, {template}, {must}, CAST({never} AS VARCHAR[]))"
    for label, n, template, must, never in statements()
)

LICENSES = (
    r"""
WITH statements(label, n, template, must, never) AS (VALUES """
    + _STATEMENTS
    + r"""), texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), cut AS (
  SELECT *, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), places AS (
  SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'gnu' AND w[i + 1] = 'general'
              AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl,
         list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
         list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc,
         list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit
  FROM cut
), runs AS (
  SELECT r, label, template, must, never,
         unnest(list_transform(list_filter(range(1, len(w) + 1),
                                           lambda i: list_contains(template, w[i])),
                               lambda i: list_distinct(w[i : i + n - 1]))) AS t
  FROM cut, statements WHERE list_has_all(w, must)
), matched AS (
  SELECT r, label, len(list_intersect(t, template)) / len(template) AS containment
  FROM runs
  WHERE 10 * len(list_intersect(t, template)) >= 8 * len(template)
    AND list_has_all(t, must) AND NOT list_has_any(t, never)
), more AS (
  SELECT r, list(DISTINCT label) AS labels, max(containment) AS best FROM matched GROUP BY r
), based AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         list_concat(list_concat(gpl, apache), list_concat(cc, mit)) AS spots,
         list_filter([CASE WHEN len(gpl) > 0 THEN 'gpl' END,
                      CASE WHEN len(apache) > 0 THEN 'apache' END,
                      CASE WHEN len(cc) > 0 THEN 'cc-by' END,
                      CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS base
  FROM places
)
SELECT doc_id, n_words, CAST(len(spots) AS BIGINT) AS n_base,
       CAST(list_min(spots) - 1 AS BIGINT) AS first_word,
       CAST(list_max(spots) - 1 AS BIGINT) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',')
         AS labels,
       CAST(CASE WHEN len(spots) > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM based LEFT JOIN more USING (r)
"""
)

COLLOCATIONS = f"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
 translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS p FROM documents),
 word AS (SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w FROM piece),
 spot AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM word),
 gram AS (SELECT lang, unnest([1, 2, 3]) AS size, unnest([w[i],
 CASE WHEN i + 1 <= len(w) THEN concat(w[i], ' ', w[i + 1]) END,
 CASE WHEN i + 2 <= len(w) THEN concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) END]) AS phrase
 FROM spot),
 f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS a FROM gram
 WHERE phrase IS NOT NULL GROUP BY ALL),
 total AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
 cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
 cut AS (SELECT c.lang, c.size, c.phrase, c.a, k, x.a AS l, y.a AS r,
 (1000000 * c.a * c.a) // (x.a * y.a) AS score
 FROM (SELECT *, unnest(CASE WHEN size = 2 THEN [1] ELSE [1, 2] END) AS k FROM cand) c
 JOIN f x ON x.lang = c.lang AND x.size = k
 AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
 JOIN f y ON y.lang = c.lang AND y.size = c.size - k
 AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')),
 best AS (SELECT * FROM cut
 QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 outside AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([
 concat(w[1], ' ', w[2]), concat(w[2], ' ', w[3])]) AS phrase FROM cand WHERE size = 3)
 GROUP BY ALL),
 kept AS (SELECT b.* FROM best b LEFT JOIN outside o ON o.lang = b.lang AND o.phrase = b.phrase
 WHERE o.a IS NULL OR 100 * o.a < 50 * b.a),
 placed AS (SELECT *, row_number() OVER (PARTITION BY lang
 ORDER BY score DESC, a DESC, encode(phrase)) AS place FROM kept)
 SELECT p.lang, CAST(place AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a,
 CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
 CAST(score AS BIGINT) AS score
 FROM placed p JOIN total t ON t.lang = p.lang WHERE place <= 2000"""


#: Every document scored for every query, by the definition.
BM25 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
 size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
 tf AS (SELECT r, term, count(*) AS f FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
 idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)::DOUBLE) AS idf
  FROM tf, size GROUP BY term),
 q AS (SELECT doc_id AS query_id, term, sum(f) AS times FROM tf JOIN d USING (r)
  WHERE doc_id % 50 = 0 GROUP BY ALL),
 scored AS (SELECT query_id, r, round(sum(times * idf * f * 2.2::DOUBLE
  / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN d USING (r), size GROUP BY query_id, r),
 ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, doc_id) AS "rank", doc_id, score FROM scored JOIN d USING (r)
  WHERE score > 0)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", doc_id, score FROM ranked WHERE "rank" <= 10
"""
