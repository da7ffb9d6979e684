"""Query of the quality rules, with its SQL twin."""

from pyspark.sql import DataFrame, SparkSession

from pagegauge.llm import quality
from pagegauge.llm.base import Stage, fingerprint
from pagegauge.llm.queries import query, table

GROUPS = ["lang", "source"]

SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), tri AS (
  SELECT r, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3)
), starts AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1
), repeated AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM starts) GROUP BY r
), m AS (
  SELECT w.r, doc_id, lang, source, t, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN repeated ON repeated.r = w.r
), v AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 10000 // greatest(n_words, 1) AS symbol_rate,
         word_chars * 1000 // greatest(n_words, 1) AS mean_length,
         n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_rate,
         n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate
  FROM m
), single AS (
  SELECT DISTINCT lang, source, t, symbol_rate, mean_length, dup_line_rate, repeat_rate FROM v WHERE NOT base_failed
), long AS (
  SELECT lang, source, measure, value FROM single UNPIVOT (value FOR measure IN (symbol_rate, mean_length, dup_line_rate, repeat_rate))
), bins AS (
  SELECT lang, source, measure, (value >> s) << s AS bin
  FROM (SELECT *, CAST(greatest(length(bin(value)) - 6, 0) AS BIGINT) AS s FROM long)
), levels AS (
  SELECT 2 AS level, lang AS g0, source AS g1, measure, bin FROM bins
  UNION ALL SELECT 1, lang, NULL, measure, bin FROM bins
  UNION ALL SELECT 0, NULL, NULL, measure, bin FROM bins
), counted AS (
  SELECT level, g0, g1, measure, bin, count(*) AS n FROM levels GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, g0, g1, measure ORDER BY bin) AS upto,
         sum(n) OVER (PARTITION BY level, g0, g1, measure) AS total
  FROM counted
), eighth AS (
  SELECT level, g0, g1, measure, max(total) AS total, min(bin) FILTER (8 * upto >= total) AS low,
         min(bin) FILTER (8 * upto >= 4 * total) AS mid, min(bin) FILTER (8 * upto >= 7 * total) AS high
  FROM ranked GROUP BY ALL
), chosen AS (
  -- The finest sketch with enough documents whose spread is not 0, else the finest with enough.
  SELECT a.g0, a.g1, a.measure, f.low, f.mid, f.high,
         row_number() OVER (PARTITION BY a.g0, a.g1, a.measure ORDER BY f.high > f.mid DESC, f.level DESC) AS place
  FROM eighth a
  JOIN eighth f ON f.measure = a.measure AND (f.level = 0 OR f.g0 IS NOT DISTINCT FROM a.g0) AND (f.level < 2 OR f.g1 IS NOT DISTINCT FROM a.g1)
  WHERE a.level = 2 AND (f.total >= 100 OR f.level = 0)
), measured AS (
  SELECT v.*, measure, value, low, mid, high, greatest(200, CASE measure
           WHEN 'symbol_rate' THEN ceil(10000 / greatest(n_words, 1)) WHEN 'mean_length' THEN trunc(mid / (2 * sqrt(greatest(n_words, 1))))
           WHEN 'dup_line_rate' THEN ceil(10000 / greatest(n_lines, 1)) ELSE greatest(ceil(60000 / greatest(n_words, 1)), dup_line_rate) END) AS event
  FROM v
  JOIN (SELECT r, measure, value FROM v UNPIVOT (value FOR measure IN (symbol_rate, mean_length, dup_line_rate, repeat_rate))) x ON x.r = v.r
  JOIN chosen USING (measure)
  WHERE place = 1 AND g0 IS NOT DISTINCT FROM lang AND g1 IS NOT DISTINCT FROM source
), verdict AS (
  SELECT r, bool_and(value <= high + 3 * greatest(high - mid, event)
                     AND (measure <> 'mean_length' OR value >= low - 3 * greatest(mid - low, event))) AS inside
  FROM measured GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(inside, false) AS kept
FROM v LEFT JOIN verdict ON verdict.r = v.r
"""


@query("op10_quality_rules", SQL)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document under the fences of its language and source."""
    docs = table(spark, folder, "documents").select("doc_id", "text", *GROUPS)
    docs = docs.withColumn("text_key", fingerprint(docs["text"]))
    rows = Stage(spark).keep(quality.measured(docs).drop("text"), "measures")
    return quality.verdicts(rows, GROUPS, "text_key").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
