"""Query of the benchmark decontamination, with its SQL twin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import decontaminate
from pagegauge.llm.queries import query, table

SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(list_slice(words, p, p + least(10, len(words)) - 1), ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS p FROM item WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT size FROM win
), occurs AS (
  SELECT r, p, d.size, item_id
  FROM (SELECT r, p, size, array_to_string(list_slice(words, p, p + size - 1), ' ') AS w
        FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM low, sizes WHERE len(words) >= size)) d
  JOIN win ON win.w = d.w AND win.size = d.size
), hit AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + size)) AS q FROM occurs) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM occurs WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM low LEFT JOIN hit ON hit.r = low.r LEFT JOIN named ON named.r = low.r
"""


@query("op1_benchmark_decontamination", SQL)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie inside ten-word windows of benchmark items."""
    found = decontaminate.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
