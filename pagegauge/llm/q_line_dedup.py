"""Query of the line dedup, with its SQL twin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import line_dedup
from pagegauge.llm.queries import query, table

SQL = r"""
WITH line AS (
  SELECT doc_id, p, lines[p] AS line,
         translate(trim(lines[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM line WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, p, line, coalesce(keeper <> doc_id, false) AS gone FROM line LEFT JOIN shared ON shared.k = line.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op2_line_dedup", SQL)
def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of at least 20 characters in three documents or more stay in the largest of these only."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = line_dedup.deduped(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
