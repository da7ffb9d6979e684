"""Typed readers: batch and streaming, from files or from a column of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge import schemas

# Schema numbers this package reads, and the labelled stride of a clip.
RESULTS_SCHEMA = 2
DIAGNOSTICS_VERSION = 1
LABELS_VERSION = 1
REPLAY_FPS, SPARSE_STRIDE = 15, 8
CORNER_SLACK = 0.5
MEDIA_STILLS, MEDIA_CLIPS = ["jpg", "jpeg"], ["mp4"]
MAX_STRING = 96


def read_probe_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROBE_EVENT).json(path)


def stream_probe_events(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.PROBE_EVENT).option("maxFilesPerTrigger", max_files).json(path)


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DIAGNOSTICS_EVENT).json(path)


def read_flow_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FLOW_EVENT).json(path)


def read_page_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGE_RECORD).parquet(path)


def read_result_rows(spark: SparkSession, path: str) -> DataFrame:
    return comparable_rows(spark.read.schema(schemas.RESULT_ROW).parquet(path))


def comparable_rows(rows: DataFrame) -> DataFrame:
    """Rows of the results schema this package measures; others mean different things under the same names."""
    return rows.where(F.col("schema") == RESULTS_SCHEMA)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded rasters: ``origin, width, height, nChannels, data`` (bytes in BGR order)."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")


def media_kind(path: Column) -> Column:
    """still / clip, or why a file is left out."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    recording = F.lower(path).rlike(r"screen.?recording")
    return (
        F.when(recording, "skipped: screen recording")
        .when(ext.isin(MEDIA_STILLS), "still")
        .when(ext.isin(MEDIA_CLIPS), "clip")
        .otherwise("skipped: not media")
    )


def parse_probe_events(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.from_json(column, schemas.PROBE_EVENT).alias("e")).select("e.*")


def parse_labels(rows: DataFrame, column: str) -> DataFrame:
    """One row per labelled image of label documents of the known version."""
    document = F.from_json(column, schemas.LABELS_DOCUMENT)
    items = rows.select(document.alias("d")).where(F.col("d.version") == LABELS_VERSION)
    return items.select(F.explode("d.items").alias("image_id", "item")).select("image_id", "item.*")


def label_problem(corners: Column, uncertain: Column, no_document: Column) -> Column:
    """First structural problem of a label; null when it is usable."""

    def far(v: Column) -> Column:
        return v.isNull() | F.isnan(v) | (v < -CORNER_SLACK) | (v > 1 + CORNER_SLACK)

    bad_corner = F.exists(corners, lambda c: (F.size(c) != 2) | F.exists(c, far))
    return (
        F.when(F.coalesce(no_document, F.lit(False)), None)
        .when(corners.isNull() | (F.size(corners) != 4), "corners must be four pairs")
        .when(bad_corner, "corners must be normalized")
        .when(uncertain.isNotNull() & (F.size(uncertain) != 4), "uncertain must be four booleans")
    )


# What each host event may carry.
STEPS = ["capture", "corners", "review", "build"]
QUALITIES = ["sharp", "blurred", "small_text", "unchecked"]
ERROR_CODES = ["camera_denied", "no_camera", "asset_load", "model_init", "out_of_memory", "build_failed"]
DEWARP_OUTCOMES = ["applied", "fallback", "declined"]


def flow_allowed(events: DataFrame) -> DataFrame:
    """Only known names with their allow-listed fields; anything out of its list drops the row."""
    c = F.col

    def number(name: str) -> Column:
        return c(name).isNotNull() & ~F.isnan(c(name)) & (F.abs(c(name)) != F.lit(float("inf")))

    fields = {
        "step": ({"step"}, c("step").isin(STEPS)),
        "capture": ({"page", "source"}, number("page") & c("source").isin("camera", "file")),
        "retake": ({"page"}, number("page")),
        "remove": ({"page"}, number("page")),
        "reorder": ({"from", "to"}, number("from") & number("to")),
        "dewarp": ({"page", "outcome"}, number("page") & c("outcome").isin(DEWARP_OUTCOMES)),
        "quality": ({"page", "verdict"}, number("page") & c("verdict").isin(QUALITIES)),
        "size_ladder": ({"rung", "bytes"}, number("rung") & number("bytes")),
        "pdf_built": ({"pages", "bytes", "ms"}, number("pages") & number("bytes") & number("ms")),
        "error": ({"code", "recoverable"}, c("code").isin(ERROR_CODES) & c("recoverable").isNotNull()),
        "cancel": ({"reason", "pages"}, c("reason").isin("user", "error") & number("pages")),
    }
    allowed = F.lit(False)
    for name, (_, ok) in fields.items():
        allowed = allowed | ((c("name") == name) & F.coalesce(ok, F.lit(False)))
    names = {f for kept, _ in fields.values() for f in kept}
    kept = [
        F.when(c("name").isin([n for n, (own, _) in fields.items() if f in own]), c(f)).alias(f) if f in names else c(f)
        for f in events.columns
    ]
    return events.where(allowed).select(*kept)


def clean_number(value: Column) -> Column:
    """Three decimals; what is not a number is null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, F.floor(value * 1000 + 0.5) / 1000)


def clean_text(value: Column, limit: int = MAX_STRING) -> list[Column]:
    """A text as it is, its short form for a report, and whether that leaves something out."""
    return [F.substring(value, 1, limit).alias("short"), value.alias("text"), (F.length(value) > limit).alias("truncated")]


def sparse_frames(frames: DataFrame, clip: str, k: str) -> DataFrame:
    """Every eighth frame of a clip, with its ``clip@ms`` id."""
    ms = F.floor(F.col(k) * 1000 / float(REPLAY_FPS) + 0.5).cast("bigint").cast("string")
    kept = frames.where(F.pmod(F.col(k), F.lit(SPARSE_STRIDE)) == 0)
    return kept.withColumn("frame_id", F.concat(F.col(clip), F.lit("@"), ms, F.lit("ms")))
