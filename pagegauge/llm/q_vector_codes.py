"""Query of the vector codes, with its SQL twin: full scans in every round."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import vector_codes
from pagegauge.llm.queries import query, table

ROUNDS = 4


def _sql() -> str:
    """A scan of all entries for every part, ``ROUNDS`` times and once more; ties go to the lower entry."""
    steps = [
        """kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS n,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), part AS MATERIALIZED (
  SELECT vec_id, label, n, p, x[p * 16 + 1 : p * 16 + 16] AS x FROM kept, range(4) AS r(p)
), book0 AS MATERIALIZED (SELECT p, n AS e, x AS c FROM part WHERE n < 256)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""near{i} AS MATERIALIZED (
  SELECT n, p, d.d AS d, d.e AS e
  FROM (SELECT n, part.p, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}}) AS d
        FROM part JOIN book{i} ON part.p = book{i}.p GROUP BY n, part.p)
)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""mean{i} AS (
  SELECT p, e, list(floor(s::DOUBLE / k)::BIGINT ORDER BY j) AS c
  FROM (SELECT near{i}.p, near{i}.e, j, sum(x[j]) AS s, count(*) AS k
        FROM near{i} JOIN part ON part.n = near{i}.n AND part.p = near{i}.p, range(1, 17) AS r(j) GROUP BY near{i}.p, near{i}.e, j)
  GROUP BY p, e
), book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f""", coded AS (
  SELECT vec_id, label, kept.n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM kept JOIN near{ROUNDS} ON near{ROUNDS}.n = kept.n GROUP BY vec_id, label, kept.n
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded
"""
    )


@query("op11_vector_compression", _sql())
def vector_compression(spark: SparkSession, folder: str) -> DataFrame:
    """Four codes of a byte for every vector, its error and that of its label."""
    found = vector_codes.compressed(table(spark, folder, "embeddings"), rounds=ROUNDS)
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = found.rows.select(F.col("id").alias("vec_id"), "label", code.alias("code"), error.alias("error"))
    rows = vector_codes.label_errors(rows).drop("label")
    return rows.withColumn("codebooks_sha256", F.lit(found.digest()))
