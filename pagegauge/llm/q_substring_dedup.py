"""Query of the substring dedup, with its SQL twin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import substring_dedup
from pagegauge.llm.queries import query, table

SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(list_slice(words, p, p + 12), ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13)
), early AS (
  SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN early ON early.s = win.s WHERE doc_id > lo
), word AS (
  SELECT doc_id, q, words[q] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS q FROM w)
), kept AS (
  SELECT doc_id, count(gone.q) AS n, string_agg(word, ' ' ORDER BY q) FILTER (gone.q IS NULL) AS kept
  FROM word LEFT JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op9_substring_dedup", SQL)
def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document outside 13-word passages that a document with a smaller number has."""
    found = substring_dedup.deduped(table(spark, folder, "documents"), size=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
