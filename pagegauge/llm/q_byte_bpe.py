"""Query of the byte-level BPE; no SQL states it, the tests hold it against a rank-file tokenizer."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagegauge.llm import byte_bpe
from pagegauge.llm.queries import query, table


@query("op7_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document under the public byte-level vocabulary, and the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.coded(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
