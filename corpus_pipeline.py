"""The corpus pipeline: quality rules, line dedup, near-duplicate groups, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but
the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the
shared checkpoint folder and reads them again for the next.

Rows without an identifier pass the line dedup and the near-duplicate stage unchanged; empty texts,
also those that the line dedup emptied, pass all stages that do not judge length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import byte_bpe, decontaminate, jaccard, line_dedup, quality
from pagegauge.llm.base import Stage, fingerprint, ready

GROUPS = ["lang", "source"]
#: The tokens' ids and their digests; no SQL states byte-pair merges.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: failed base rules, or outside the fences of their language and source,
    which their sketch decides (``quality.upper_fences``; op10 has the fences that its SQL states)."""
    ready(spark)
    whole = docs.select("text", *GROUPS, F.struct(*docs.columns).alias("doc"), fingerprint(F.col("text")).alias("text_key"))
    stage = Stage(spark)
    rows = stage.keep(quality.measured(whole).drop("text"), "measures")
    # Written, so that the join knows how small the fences are.
    bounds = quality.upper_fences(quality.sketches(quality.distinct_texts(rows, GROUPS, "text_key"), GROUPS), len(GROUPS))
    return quality.judged_by_sketch(rows, stage.keep(bounds, "fences"), GROUPS).filter("kept").select("doc.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of three documents or more stay in one of them; the texts' lengths follow."""
    ready(spark)
    found = line_dedup.deduped(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over 5-word shingles the smallest
    number stays. Rows of one identifier are one document of the groups; of the one that stays, every
    different text is kept, and of rows with the same text the one whose columns are smallest in order."""
    ready(spark)
    groups = jaccard.similar_groups(docs, n=5, percent=80)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
    named = docs.filter("doc_id IS NOT NULL")
    kept = named.join(first, named["doc_id"] == first["first_id"], "left_semi")
    kept = kept.groupBy("doc_id", fingerprint(F.col("text"))).agg(F.min(F.struct(*docs.columns)).alias("doc")).select("doc.*")
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go. Every row is judged by its own text, also
    rows of one identifier; the other columns pass through the scan under their names."""
    ready(spark)
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document under the public byte-level vocabulary, and digests of ids and decoded bytes;
    a row for each row, repeated ones too."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.coded(docs, path, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(ready(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.keep(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
