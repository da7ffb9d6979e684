"""What the text operators share: staged tables, row keys and Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegauge.session import ensure_checkpoint_dir

#: White space of the word rules, as it stands in a character class of every dialect used here.
SPACE = r"\x20\x09-\x0D"


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the text jobs: small Arrow batches (documents are long) and shuffle files that go
    when the job that wrote them has ended."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


class Stage:
    """Tables that one operator writes on its way, in the shared checkpoint folder.

    A written table cuts the lineage: a lost executor costs a read of it, not the work before it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a staged table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text, under fixed names, so that further columns never clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def fingerprint(text: Column) -> Column:
    """Tells rows of the same identifier apart; null and empty text are the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mapped(
    df: DataFrame,
    schema: str,
    step: Callable[[pa.RecordBatch], dict[str, Iterable]],
    start: Callable[[], Callable[[pa.RecordBatch], dict[str, Iterable]]] | None = None,
) -> DataFrame:
    """``step`` over every Arrow batch; it returns the columns named in ``schema``.

    ``start``, where given, is called once per task and returns the step.
    """
    struct = T.StructType.fromDDL(schema)
    fields = arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start() if start is not None else step
        for batch in batches:
            out = apply(batch)
            yield pa.record_batch(
                [pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in fields],
                schema=fields,
            )

    return df.mapInArrow(run, struct)
