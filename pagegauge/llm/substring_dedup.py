"""Substring dedup: words inside long passages that an earlier document has go.

Recompression names the words' runs and pairs alike in every document. A window of the given length
then has a key, a high-level symbol with some of the words beside it, which depends on the window's
words only and which neighbouring windows share: far fewer keys than windows. Texts that are equal as
a whole are settled first. Keys that occur in one document only are dropped; windows under the other
keys are compared by hashes of all their words, and those that a smaller document also has are
removed from the larger one.

Window hashes have 96 bits and stand for the words.

Defined cases: null, empty or blank text has no words; a row with a null identifier keeps its words
and is no source for others; rows of one identifier are one document, which is not smaller than
itself; an empty table gives an empty result; texts may be of any length; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.base import Stage, chosen, fingerprint, mapped
from pagegauge.llm.recompression import Ranges, window_keys, windows_of
from pagegauge.llm.wordgrams import Words, words_of


def _per_text(words: Words, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, words.first)


def parsed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row and the keys of the text's windows."""

    def step(batch: pa.RecordBatch):
        words = words_of(batch.column("text"), lower=False)
        starts = windows_of(words, size)
        keys = window_keys(words, starts, size, Ranges(words.hash)).view(np.int64)
        cut = _per_text(words, starts)
        return {
            "doc_id": batch.column("doc_id"),
            "row": batch.column("row"),
            "keys": [np.unique(keys[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)],
        }

    return mapped(docs, "doc_id bigint, row bigint, keys array<bigint>", step)


def hashed_windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, at, w1, w2): the windows of every text under one of its ``keys``."""

    def step(batch: pa.RecordBatch):
        words = words_of(batch.column("text"), lower=False)
        ranges = Ranges(words.hash)
        starts = windows_of(words, size)
        keys = window_keys(words, starts, size, ranges).view(np.int64)
        cut = _per_text(words, starts)
        wanted = batch.column("keys")
        keep = np.zeros(len(starts), bool)
        for t, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            keep[i:j] = np.isin(keys[i:j], wanted[t].values.to_numpy())
        own = starts[keep]
        of = np.searchsorted(words.first, own, "right") - 1
        second = Ranges(words_of(batch.column("text"), lower=False, seed=1).hash).of(own, own + size)
        take = pa.array(of)
        return {
            "doc_id": batch.column("doc_id").take(take),
            "row": batch.column("row").take(take),
            "at": own - words.first[of],
            "w1": ranges.of(own, own + size).view(np.int64),
            "w2": (second >> np.uint64(32)).astype(np.uint32).view(np.int32),
        }

    return mapped(docs, "doc_id bigint, row bigint, at int, w1 bigint, w2 int", step)


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """One row per document: doc_id (a long), n_words, n_removed, kept (its words, joined by blanks)."""
    stage = Stage(docs.sparkSession)
    own = chosen(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    own = own.withColumn("row", fingerprint(F.col("text")))
    known = own.filter("doc_id IS NOT NULL")
    # Texts that are equal as a whole: all but that of the smallest number repeat it.
    whole = known.select("doc_id", "row", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("hash"))
    classes = whole.groupBy("hash").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last")
    # Tables of counts are written before rows meet them: each join deals both sides itself, and Spark
    # can split the rows of a hot key.
    classes = stage.keep(classes, "classes")
    copies = stage.keep(whole.join(classes, "hash").filter("doc_id <> source").select("doc_id", "row").distinct(), "copies")
    rows = stage.keep(parsed(known.join(copies, ["doc_id", "row"], "left_anti"), size), "parsed")
    only = rows.select("doc_id", "row", F.explode("keys").alias("key"))
    shared = stage.keep(only.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "shared")
    asked = stage.keep(only.join(shared, "key").groupBy("doc_id", "row").agg(F.collect_set("key").alias("keys")), "asked")
    stage.drop("parsed")
    stage.drop("shared")
    windows = stage.keep(hashed_windows(known.join(asked, ["doc_id", "row"]), size), "windows")
    stage.drop("asked")
    repeated = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    repeated = stage.keep(repeated.select("w1", "w2", "lo"), "repeated")
    found = windows.join(repeated, ["w1", "w2"]).filter("doc_id > lo").groupBy("doc_id", "row").agg(F.collect_set("at").alias("at"))
    found = stage.keep(found.select("doc_id", "row", "at", F.lit(False).alias("whole")), "found")
    stage.drop("windows")
    stage.drop("repeated")
    marks = found.unionByName(copies.select("doc_id", "row", F.array().cast("array<int>").alias("at"), F.lit(True).alias("whole")))
    joined = own.join(marks, ["doc_id", "row"], "left")

    def step(batch: pa.RecordBatch):
        n_words, n_removed, kept = [], [], []
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for text, at, whole in zip(texts, batch.column("at").to_pylist(), batch.column("whole").to_pylist(), strict=True):
            words = (text or b"").split()
            gone = np.zeros(len(words) + 1, np.int64)
            if whole and len(words) >= size:
                gone[0] = 1
            elif at:
                np.add.at(gone, at, 1)
                np.add.at(gone, np.array(at) + size, -1)
            gone = np.cumsum(gone[:-1]) > 0
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())}

    return mapped(joined, "doc_id bigint, n_words bigint, n_removed bigint, kept string", step)

