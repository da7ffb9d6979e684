"""Line dedup: lines that many documents share stay in one of them.

Texts are cut into lines, every line's key (stripped of ASCII white space, A-Z lowered) is hashed,
and (hash, document) pairs are counted: first made distinct, which no hot line can skew, then added
up per hash with partial sums in every task. Pairs of hashes over the threshold go back to their
documents, which are put together again from the kept lines in their order.

A hash is 16 bytes of SHA-256; keys are taken as equal when these are.

Defined cases: null or empty text is one empty line; short keys always stay; a row whose identifier
is null neither counts as a document nor loses lines; rows of one identifier are one document; an
empty table gives an empty result; texts and lines may be of any length; further columns are kept
by ``deduped`` unless they have the names it makes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.base import Stage, chosen, mapped, texts

STRIPPED = b" \t\n\v\f\r"


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, or None when the key is too short to count."""
    key = line.strip(STRIPPED).lower()  # bytes.lower() touches A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.sha256(key).digest()[:16]


def shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Pairs of a line hash and a document that loses it (doc_id, drop: all its hashes)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch):
        ids, hashes = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            own = {h for line in text.split(b"\n") if (h := line_hash(line, min_chars)) is not None}
            ids += [doc] * len(own)
            hashes += own
        return {"doc_id": ids, "line": hashes}

    pairs = mapped(docs.filter(F.col("doc_id").isNotNull()), f"doc_id {id_type}, line binary", step).distinct()
    counts = pairs.groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    # Written, so that the join deals both sides itself and Spark can split a hot line's rows.
    counts = Stage(docs.sparkSession).keep(counts, "counts")
    lost = pairs.join(counts, "line").filter(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_list("line").alias("drop"))


def deduped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """The input with ``kept_text``, ``n_lines`` (before) and ``n_dropped``."""
    made = ["kept_text", "n_lines", "n_dropped", "_drop"]
    own = docs.select(*[docs[c] for c in docs.columns if c not in made])
    lost = shared_lines(chosen(docs, id_col, text_col), min_chars, min_docs)
    lost = lost.select(F.col("doc_id").alias("_lost_id"), F.col("drop").alias("_drop"))
    joined = own.join(lost, own[id_col] == lost["_lost_id"], "left").drop("_lost_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)

    def step(batch: pa.RecordBatch):
        out = {name: batch.column(name) for name in batch.schema.names if name != "_drop"}
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts(batch.column(text_col)), batch.column("_drop").to_pylist(), strict=True):
            if not drop:
                kept.append(text)
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                continue
            lines, gone = text.split(b"\n"), set(drop)
            left = [line for line in lines if line_hash(line, min_chars) not in gone]
            kept.append(b"\n".join(left))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
        return out | {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": n_lines, "n_dropped": n_dropped}

    return mapped(joined, f"{schema}, kept_text string, n_lines bigint, n_dropped bigint", step)
