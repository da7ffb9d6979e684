"""Byte-level BPE through sentencepiece, from nothing but a file of ranks.

The vocabulary is written out as a sentencepiece BPE model: every token's bytes become printable
characters, its score is its negative rank, and the normaliser is the identity. Merging the best
score first, leftmost among equals, is merging the lowest rank. A pre-token that is itself a token
is that token, as in rank-file tokenizers; the rest goes through the model. Ids are ranks, and
decoding maps them back to bytes.

The model is broadcast: one vocabulary file, refused when over ``MODEL_LIMIT`` bytes.

Defined cases: null text is empty and has no ids; characters that no pre-token matches are left out,
as the pattern says; texts may be of any length; further columns are ignored; rows are independent.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from pagegauge.llm.base import chosen, mapped

MODEL_LIMIT = 64 << 20
#: Pre-tokens remembered by a task before it starts afresh; what is remembered changes no result.
CACHED = 200_000
#: Field numbers and types of the public sentencepiece model format (fixed values).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
BPE = 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, blank, rank in each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def alphabet() -> list[str]:
    """A printable character for every byte: itself where it prints, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a serialised sentencepiece model; piece ids are ranks."""
    chars = alphabet()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without a gap")
    out = []
    for rank, token in enumerate(by_rank):
        name = "".join([chars[b] for b in token]).encode()
        out.append(_block(PIECES, _block(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, NORMAL)))
    # One more piece, outside the alphabet, for what cannot occur: every byte is a piece.
    out.append(_block(PIECES, _block(1, "⁇".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, UNKNOWN)))
    trainer = _number(3, BPE) + _number(4, len(by_rank) + 1) + _number(40, len(by_rank)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _block(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join([*out, _block(TRAINER, trainer), _block(NORMALIZER, normalizer)])


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        chars = alphabet()
        byte = {c: b for b, c in enumerate(chars)}
        self.shown = {b: c for b, c in enumerate(chars)}
        size = self.pieces.get_piece_size() - 1
        self.tokens = [bytes([byte[c] for c in self.pieces.id_to_piece(i)]) for i in range(size)]
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def _add(self, words: set[str]) -> None:
        """Ids of pre-tokens not met before."""
        rest, lines = [], []
        for word in words:
            data = word.encode()
            if (rank := self.ranks.get(data)) is not None:
                self.known[word] = rank.to_bytes(4, "little")
            else:
                rest.append(word)
                lines.append(data.decode("latin-1").translate(self.shown))
        if rest:
            found = self.pieces.encode(lines, num_threads=1)
            packed = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            ends = [4 * n for n in accumulate(map(len, found))]
            self.known.update((w, packed[a:b]) for w, a, b in zip(rest, [0, *ends], ends))

    def encode(self, text: str) -> np.ndarray:
        words = self.split(text)
        known = self.known
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > CACHED:
            known.clear()
            fresh = set(words)
        if fresh:
            self._add(fresh)
        return np.frombuffer(b"".join([known[word] for word in words]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


@functools.lru_cache(maxsize=1)
def codec_of(model: bytes, pattern: str) -> Codec:
    """The codec of this worker process, kept from task to task."""
    return Codec(model, pattern)


def coded(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256, and with ``keep_ids`` the ids themselves. ``ranks_path`` is read on
    the driver."""
    model = model_bytes(read_ranks(ranks_path))
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"a vocabulary of {len(model)} bytes is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = chosen(docs, id_col, text_col)
    id_type = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def start():
        codec = codec_of(shared.value, pattern)

        def step(batch: pa.RecordBatch):
            out: dict = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            if keep_ids:
                out["ids"] = []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text or "")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    out["ids"].append(ids.astype("i4"))
            return out

        return step

    return mapped(own, schema, None, start)
