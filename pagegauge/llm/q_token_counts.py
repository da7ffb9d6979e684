"""Query of the token counts; no SQL states it, the tests hold it against a plain loop."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import token_counts
from pagegauge.llm.queries import query, table


@query("op5_token_counts")
def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the document; a row per line."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = token_counts.section_tokens(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return found.select("doc_id", F.posexplode("sections").alias("section", "s")).select("doc_id", "section", "s.*")
