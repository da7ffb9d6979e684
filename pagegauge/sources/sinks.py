"""Report tables, partitioned by suite and run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(table: DataFrame, path: str, suite: str, run_id: str) -> None:
    """Replace one run's partition and leave the others."""
    stamped = table.withColumn("suite", F.lit(suite)).withColumn("run_id", F.lit(run_id))
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("suite", "run_id")
        .parquet(path)
    )


def read_report(spark, path: str, suite: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if suite is None else table.where(F.col("suite") == suite)
