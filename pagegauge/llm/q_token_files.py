"""Query of the token files; no SQL states it, the tests hold it against the tokenizer and a plain stream."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagegauge.llm import token_files
from pagegauge.llm.queries import query, table


@query("op13_token_files")
def token_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the stream of ids, its length and digest, as the written files give them."""
    docs = table(spark, folder, "documents")
    manifest = token_files.write_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(manifest, docs.schema["doc_id"].dataType.simpleString())
