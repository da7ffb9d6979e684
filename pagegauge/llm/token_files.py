"""Token ids in Arrow files of equal-length sequences, each with its mask, for random access without copies.

One shuffle puts the documents in order of their identifier (a range partition, so a hot identifier
or a long run of copies is only a longer run of rows: repeats are told apart by text, then by their
place in the input, and can be split). Every partition is a shard: its task encodes the documents in
order, appends the end id, and cuts the stream of ids into sequences of ``length``; a document may go
on from one sequence, and one file, to the next. Only a shard's last sequence is padded, and its mask
says so.

A file is an Arrow stream with a footer (the IPC file format), uncompressed, in record batches of
``BATCH`` sequences: ``ids``, a fixed-size list of unsigned 16-bit integers (32-bit for a vocabulary over
65,536), and ``mask``, a fixed-size list of bytes with a bit per id, lowest bit first, 1 for an id and 0
for padding. Sequence ``i`` of a file is row ``i % BATCH`` of batch ``i // BATCH``, so a mapped file gives it as a
view. Beside it lies a second Arrow file, the documents' pieces in it: identifier, number of the
document in its shard, number of the piece, first position, length, whether it ends there.

Files get a name of their own in every attempt; the manifest (shard, file, paths, sizes) is written by
Spark, so it names the files of the attempts that counted, and the files of a lost or repeated
attempt are never read. They go to the folder given, by default that of ``spark.checkpoint.dir``.

``start`` of a document is what all shards before hold, and its own place in its shard; the driver adds
up one number per shard. Digests are taken file by file and those of a document cut between files
are combined, so reading is even in files, however long a document is.

Defined cases: null text is empty and holds the end id alone; a null identifier comes first; rows of
one identifier are separate documents in the order of the 64-bit hash of their text; no rows give no
files, and no rows; strings that name special tokens are ordinary text; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegauge.llm.base import Stage, arrow_schema, chosen, fingerprint, mapped
from pagegauge.llm.byte_bpe import alphabet
from pagegauge.session import ensure_checkpoint_dir

LENGTH = 2048
FILE_SEQUENCES = 4096
BATCH = 64
MODEL_LIMIT = 64 << 20
#: Chunks remembered by a worker before it forgets the later half; what is remembered changes no result.
CACHED = 1_000_000
#: Longer chunks are not remembered.
REMEMBERED = 64
#: The reflected polynomial of CRC-32 (fixed value).
CRC = 0xEDB88320

MANIFEST = "shard int, file int, path string, docs_path string, sequences bigint, tokens bigint"


# Encoding


class Encoder:
    """Ids of texts under a byte-level tokenizer file, chunk by chunk.

    The pre-tokens of such a vocabulary never reach over a blank, or a line break, that stands between
    two characters that are not white space: the blank opens the next one, the break is one of its own.
    Texts are cut there, and the library encodes every different chunk once. A text with white space in
    a row is cut at single blanks only.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.model.encode_special_tokens = True
        self.model.no_padding()
        self.model.no_truncation()
        self.wide = self.model.get_vocab_size() > 1 << 16
        self.known: dict[str, bytes] = {}
        # The merges alone, for pre-tokens in the vocabulary's own characters.
        self.merged = self.model.model.tokenize
        self.shown = dict(enumerate(alphabet()))
        self.between = re.compile(r"(?<=\S) (?=\S)").split
        self.line, self.marks = self._single("\n"), {m: self._single(m) for m in ",."}

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _single(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. Those of letters alone (and a blank before) are one pre-token, which needs no
        looking for: they go to the merges in the vocabulary's own characters."""
        merged, shown = self.merged, self.shown
        plain = [c.isalpha() or c[0] == " " and c[1:].isalpha() for c in chunks]
        rest = self.model.encode_batch_fast([c for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False)
        rest = iter([e.ids for e in rest])
        found = [
            [t.id for t in merged(c.encode().decode("latin-1").translate(shown))] if p else next(rest)
            for c, p in zip(chunks, plain, strict=True)
        ]
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = [4 * n for n in accumulate(map(len, found))]
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _add(self, fresh: list[str], into: dict[str, bytes]) -> None:
        """Ids of chunks without white space at their ends, but for the line break that may open them
        in place of a blank. Letters and one mark after them are two pre-tokens."""
        ends = [w[-1] if w[-1] in ",." and w[:-1].lstrip("\n").isalpha() else "" for w in fresh]
        stems = [w[:-1] if e else w for w, e in zip(fresh, ends, strict=True)]
        need = list({s for s in stems if s not in self.known})
        made = dict(zip(need, self._encoded([s[1:] if s[0] == "\n" else " " + s for s in need]), strict=True))
        into.update((s, self.line + ids if s[0] == "\n" else ids) for s, ids in made.items())
        known = self.known
        into.update((w, (into[s] if s in into else known[s]) + self.marks[e]) for w, s, e in zip(fresh, stems, ends, strict=True) if e)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        known = self.known
        cut = [x.replace("\n", " \n").split(" ") for x in batch]
        heads = [p.pop(0) for p in cut]
        found = [list(map(known.get, p)) for p in cut]
        holes = [list(compress(range(len(f)), map(not_, f))) for f in found]
        fresh = {p[i] for p, h in zip(cut, holes, strict=True) for i in h}
        # White space in a row shows in an empty chunk or one with white space at an end; such chunks
        # are never remembered, so every text that has one is found here.
        odd = {w for w in fresh if not w or w[-1].isspace() or w[0].isspace() and (w[0] != "\n" or w[1].isspace())}
        if odd:
            for t, (p, h) in enumerate(zip(cut, holes, strict=True)):
                if any(p[i] in odd for i in h):
                    heads[t], *cut[t] = self.between(batch[t])
                    found[t] = list(map(known.get, cut[t]))
                    holes[t] = list(compress(range(len(found[t])), map(not_, found[t])))
            fresh = {p[i] for p, h in zip(cut, holes, strict=True) for i in h}
        if len(known) + len(fresh) > CACHED:
            # What came first is what comes often.
            known = self.known = dict(islice(known.items(), CACHED // 2))
        kept = {w for w in fresh if len(w) <= REMEMBERED and (w.isalpha() or len(w.split()) == 1)}
        own = {w: self._single(" " + w) for w in fresh if w not in kept}
        self._add([w for w in kept if w not in known], known)
        out = []
        for head, p, f, h in zip(heads, cut, found, holes, strict=True):
            for i in h:
                f[i] = own[p[i]] if p[i] in own else known[p[i]]
            out.append((self._single(head) if head else b"") + b"".join(f))
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(model: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    return Encoder(model)


# Files


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file, as executors reach it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def packed_mask(n: int, length: int) -> np.ndarray:
    return np.packbits(np.arange(-(-length // 8) * 8) < n, bitorder="little")


class Shard:
    """Writer of one shard: documents in, files and manifest rows out."""

    def __init__(self, folder: str, number: int, length: int, file_sequences: int, wide: bool, id_type: pa.DataType):
        self.fs, self.folder = located(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.uri, self.number, self.length, self.file_sequences = folder, number, length, file_sequences
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.mask_bytes = -(-length // 8)
        self.schema = pa.schema(
            [
                ("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)),
                ("mask", pa.list_(pa.uint8(), self.mask_bytes)),
            ],
            metadata={"length": str(length), "batch": str(BATCH)},
        )
        self.docs_schema = pa.schema([("doc_id", id_type), ("doc", pa.int64()), ("piece", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("last", pa.bool_())])
        self.rows: list[tuple] = []
        self.file = 0
        self.doc = 0
        self.out = None

    def _open(self) -> None:
        name = f"shard-{self.number:06d}-{self.file:06d}-{uuid.uuid4().hex}"
        self.path, self.docs_path = f"{self.folder}/{name}.arrow", f"{self.folder}/{name}-docs.arrow"
        self.names = (f"{self.uri}/{name}.arrow", f"{self.uri}/{name}-docs.arrow")
        self.sink = self.fs.open_output_stream(self.path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.buffer = np.zeros(BATCH * self.length, self.dtype)
        self.held = self.written = self.tokens = 0
        self.pieces: list[tuple] = []

    def _flush(self) -> None:
        """The full sequences held, and the last one with its padding when the shard ends."""
        n = -(-self.held // self.length)
        if n:
            self.buffer[self.held : n * self.length] = 0
            masks = np.tile(packed_mask(self.length, self.length), (n, 1))
            masks[-1] = packed_mask(self.held - (n - 1) * self.length, self.length)
            ids = pa.FixedSizeListArray.from_arrays(pa.array(self.buffer[: n * self.length]), self.length)
            mask = pa.FixedSizeListArray.from_arrays(pa.array(masks.ravel()), self.mask_bytes)
            self.out.write_batch(pa.record_batch([ids, mask], schema=self.schema))
            self.written += n
            self.held = 0

    def _close(self) -> None:
        self._flush()
        self.out.close()
        self.sink.close()
        columns = list(zip(*self.pieces, strict=True)) or [[]] * 6
        with self.fs.open_output_stream(self.docs_path) as sink, pa.ipc.new_file(sink, self.docs_schema) as docs:
            docs.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, self.docs_schema)], schema=self.docs_schema), max_chunksize=1 << 16)
        self.rows.append((self.number, self.file, *self.names, self.written, self.tokens))
        self.file += 1
        self.out = None

    def add(self, doc_id, ids: np.ndarray) -> None:
        place = piece = 0
        while place < len(ids):
            if self.out is None:
                self._open()
            left = self.file_sequences * self.length - self.tokens
            take = min(left, len(ids) - place)
            self.pieces.append((doc_id, self.doc, piece, self.tokens, take, place + take == len(ids)))
            self.tokens += take
            while take:
                step = min(take, len(self.buffer) - self.held)
                self.buffer[self.held : self.held + step] = ids[place : place + step]
                self.held += step
                place += step
                take -= step
                if self.held == len(self.buffer):
                    self._flush()
            piece += 1
            if self.tokens == self.file_sequences * self.length:
                self._close()
        self.doc += 1

    def close(self) -> list[tuple]:
        if self.out is not None:
            self._close()
        return self.rows


def write_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    length: int = LENGTH,
    file_sequences: int = FILE_SEQUENCES,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the files; returns the manifest, one row per file. ``tokenizer_path`` is read on the driver."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        model = file.read()
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"a tokenizer of {len(model)} characters is too large to broadcast")
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(model)
    own = chosen(docs, id_col, text_col)
    own = own.withColumn("tie", fingerprint(F.col("text"))).withColumn("place", F.monotonically_increasing_id())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    ordered = own.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    layout = T.StructType.fromDDL(MANIFEST)
    fields = arrow_schema(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(shared.value), None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if shard is None:
                shard = Shard(folder, TaskContext.get().partitionId(), length, file_sequences, encoder.wide, batch.schema.field("doc_id").type)
            found = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                shard.add(doc_id, np.frombuffer(ids + end, "<u4"))
        rows = shard.close() if shard else []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return Stage(spark).keep(ordered.mapInArrow(run, layout), "manifest")


# Reading


class TokenFile:
    """One file, mapped into memory where it is local: its sequences and masks are views, not copies."""

    def __init__(self, path: str):
        fs, place = located(path)
        self.source = pa.memory_map(place) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(place)
        self.file = pa.ipc.open_file(self.source)
        self.length = int(self.file.schema.metadata[b"length"])
        self.rows = int(self.file.schema.metadata[b"batch"])

    @functools.lru_cache(maxsize=4)
    def batch(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (sequences, length) and packed masks of a record batch."""
        found = self.file.get_batch(i)
        shape = (found.num_rows, -1)
        return tuple(found.column(c).flatten().to_numpy(zero_copy_only=True).reshape(shape) for c in (0, 1))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence ``i`` and its packed mask."""
        ids, mask = self.batch(i // self.rows)
        return ids[i % self.rows], mask[i % self.rows]

    def span(self, at: int, n: int) -> Iterator[np.ndarray]:
        """Ids ``at`` to ``at + n``, in views of at most a record batch."""
        step = self.rows * self.length
        while n:
            flat = self.batch(at // step)[0].reshape(-1)
            piece = flat[at % step : at % step + n]
            yield piece
            at += len(piece)
            n -= len(piece)

    def close(self) -> None:
        self.source.close()


class Sequences:
    """All sequences of a manifest by number, in the documents' order. ``files``: the manifest's rows in
    order of shard and file."""

    def __init__(self, files: list):
        files = sorted(files, key=lambda r: (r["shard"], r["file"]))
        self.paths = [r["path"] for r in files]
        self.ends = list(accumulate(r["sequences"] for r in files))
        self.opened = functools.lru_cache(maxsize=16)(TokenFile)

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        f = bisect_right(self.ends, i)
        return self.opened(self.paths[f]).sequence(i - (self.ends[f - 1] if f else 0))


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, both in reflected bits."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = b >> 1 ^ (CRC if b & 1 else 0)
        bit >>= 1
    return out


def crc_joined(pieces: list[tuple[int, int]]) -> int:
    """CRC-32 of bytes in a row, from (crc, number of bytes) of their pieces."""
    total = 0
    for crc, n in pieces:
        shift, square, e = 1 << 31, 1 << 30, 8 * n
        while e:
            if e & 1:
                shift = _times(shift, square)
            square = _times(square, square)
            e >>= 1
        total = _times(shift, total) ^ crc
    return total


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per document, read back from the files: doc_id, start (ids of all documents before),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    spark = manifest.sparkSession
    # One row per shard, of which there are as many as shuffle partitions.
    totals = manifest.groupBy("shard").agg(F.sum("tokens").alias("n")).orderBy("shard").collect()
    before = dict(zip([r["shard"] for r in totals], [0, *accumulate(r["n"] for r in totals)]))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    starts = manifest.select("shard", "file", "path", "docs_path", "tokens")
    # Few rows per shard: the ids of the shard's files before.
    inside = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("base", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).repartition(tasks, "path")
    layout = T.StructType.fromDDL(f"doc_id {id_type}, shard int, doc bigint, piece int, start bigint, n bigint, crc bigint, whole boolean")
    fields = arrow_schema(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(row["path"])
                base = before[row["shard"]] + row["base"]
                fs, place = located(row["docs_path"])
                with fs.open_input_file(place) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        at, n = docs.column("at").to_numpy(), docs.column("n").to_numpy()
                        crcs = np.zeros(len(at), np.int64)
                        for k, (a, m) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
                            crc = 0
                            for piece in tokens.span(a, m):
                                crc = zlib.crc32(piece.astype("<u4"), crc)
                            crcs[k] = crc
                        piece = docs.column("piece").to_numpy()
                        whole = (piece == 0) & docs.column("last").to_numpy(zero_copy_only=False)
                        made = [docs.column("doc_id"), pa.array(np.full(len(at), row["shard"])), docs.column("doc"), docs.column("piece"), pa.array(base + at), docs.column("n"), pa.array(crcs), pa.array(whole)]
                        yield pa.record_batch([c.cast(f.type) for c, f in zip(made, fields, strict=True)], schema=fields)
                tokens.close()

    pieces = Stage(spark).keep(starts.select("shard", "path", "docs_path", "base").mapInArrow(run, layout), "pieces")
    whole = pieces.filter("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # A text of 2 GB, the longest a row can hold, is in some hundred files of the default size.
    cut = (
        pieces.filter("NOT whole")
        .groupBy("shard", "doc")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.sum("n").alias("n_tokens"),
            F.array_sort(F.collect_list(F.struct("piece", "crc", "n"))).alias("pieces"),
        )
    )

    def combine(batch: pa.RecordBatch):
        crcs = [crc_joined([(p["crc"], 4 * p["n"]) for p in row]) for row in batch.column("pieces").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": crcs}

    joined = mapped(cut.select("doc_id", "start", "n_tokens", "pieces"), f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint", combine)
    return whole.unionByName(joined)
