"""Query of the n-gram Jaccard join, with its SQL twin."""

from pyspark.sql import DataFrame, SparkSession

from pagegauge.llm import jaccard
from pagegauge.llm.queries import query, table

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, p, p + 3), ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) AS p FROM w WHERE len(words) > 0)
), size AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r
)
SELECT w.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM w JOIN reach ON reach.doc_id = w.doc_id LEFT JOIN size ON size.doc_id = w.doc_id GROUP BY w.doc_id, size.n
"""


@query("op6_ngram_jaccard_join", SQL)
def groups(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard.similar_groups(table(spark, folder, "documents"), n=4, percent=85)
