"""Query of the suffix-array dedup; the tests hold it against a plain search."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import suffix_dedup
from pagegauge.llm.queries import query, table


@query("op3_suffix_array_dedup")
def strings(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document outside 400-byte strings that also start elsewhere."""
    found = suffix_dedup.deduped(table(spark, folder, "documents"), size=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
