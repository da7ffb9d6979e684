"""A stream of the same rows gives what the batch fold gives."""

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import folds
from pagegauge.streaming import machines as m
from pagegauge.streaming import stateful


@pytest.mark.parametrize("machine", [m.READY_CUE, m.RATE_LIMIT])
def test_stream_equals_batch(spark, tmp_path, machine):
    rows = [(k, k * 1000 + i, i * 90, i % 9 < 6, i % 31 != 0) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, t long, strict boolean, keep boolean")
    # Event times of today: Spark starts its watermark at the epoch and takes a row there for late.
    df = df.withColumn("at", F.timestamp_millis(F.col("t") + 1_700_000_000_000))
    # Three files in time order, read one per micro-batch.
    for part in range(3):
        df.where((F.col("t") >= part * 1800) & (F.col("t") < (part + 1) * 1800)).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in")
        )
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out_{folds.output_names(machine)[0]}"
    query = (
        stateful.fold_stream(events, "session_id", "at", ["t", "event_id"], machine, "10 seconds")
        .writeStream.outputMode("append")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    outs = folds.output_names(machine)
    streamed = {r["event_id"]: tuple(r[o] for o in outs) for r in spark.table(name).collect()}
    batch = {
        r["event_id"]: tuple(r[o] for o in outs)
        for r in folds.fold(df, ["session_id"], ["t", "event_id"], machine, 100_000).collect()
    }
    assert streamed == batch and len(batch) == 120


@pytest.fixture
def clicks(spark, tmp_path):
    """Events of two sessions in three files, some of them repeated, as a table and as a stream of micro-batches."""
    rows = [(k, k * 1000 + i % 50, (i % 50) * 700 + (20_000 if i % 50 > 30 else 0), float(i % 7)) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, t long, value double")
    df = df.withColumn("at", F.timestamp_millis(F.col("t") + 1_700_000_000_000))
    for part in range(3):
        own = (F.col("t") >= part * 19_000) & ((F.col("t") < (part + 1) * 19_000) | F.lit(part == 2))
        df.where(own).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(out, name, mode="append"):
        query = out.writeStream.outputMode(mode).format("memory").queryName(name)
        query.option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start().awaitTermination(240)
        return sorted(map(tuple, spark.table(name).collect()))

    return df, stream, run


@pytest.mark.parametrize(
    "name,make",
    [
        ("tumbling", lambda e: stateful.tumbling_counts(e, "at", "session_id", "5 seconds", "1 hour")),
        ("sliding", lambda e: stateful.sliding_spread(e, "at", "session_id", "value", "6 seconds", "2 seconds", "1 hour")),
        ("sessions", lambda e: stateful.session_counts(e, "at", "session_id", "3 seconds", "1 hour")),
    ],
)
def test_windows_of_a_stream_are_those_of_the_table(clicks, name, make):
    df, stream, run = clicks
    assert run(make(stream()), f"w_{name}", "complete") == sorted(map(tuple, make(df).collect()))


def test_repeats_are_dropped_within_the_watermark(clicks):
    df, stream, run = clicks
    got = run(stateful.drop_repeats(stream(), "at", ["event_id"], "1 hour").select("event_id"), "once")
    assert got == sorted({(r.event_id,) for r in df.collect()})


def test_gates_are_applied_to_every_batch(spark, clicks, tmp_path):
    df, stream, _ = clicks
    metrics = lambda e: e.select("session_id", F.lit("unscoredCaptures").alias("metric"), "value")
    seen = []
    body = stateful.gate_batches("session", ["session_id"], lambda found, batch: seen.append((batch, sorted(map(tuple, found.collect())))))
    query = metrics(stream()).writeStream.foreachBatch(body).option("checkpointLocation", str(tmp_path / "ck-gate"))
    query.trigger(availableNow=True).start().awaitTermination(240)
    whole = sorted(map(tuple, stateful.absolute_violations("session", metrics(df), ["session_id"]).collect()))
    assert len(seen) == 3 and sorted(r for _, rows in seen for r in rows) == whole and whole
