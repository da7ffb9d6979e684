"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Shuffle files of a job are removed when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leave sizing to the cluster's own configuration."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Methods over this size are never compiled by the JVM; the split projections are.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Geometry and Python folds are heavy per byte: small shuffles keep their parallelism.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    # A task that sorts and windows needs some fifty times what it reads; a cluster that names a size keeps it.
    if spark.conf.get(ADVISORY, None) is None:
        spark.conf.set(ADVISORY, "16m")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out before heavy per-row work; others are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's setting, or a local one when none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagegauge-checkpoint-"))
    return context.getCheckpointDir()


def written_once(df: DataFrame) -> DataFrame:
    """The plain columns of a table that counts and percentiles both read, so that it is computed once."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return cut(df.select(*plain))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the checkpoint folder and read from there; the shuffle files that made it go."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so lost executors cost one read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
