"""Token counts per section of a document, from one encoding of the whole document.

Encoding sections one by one gives other tokens than encoding the document: white space before a
section is merged with what is around it. Here the whole text is encoded once, the tokens' byte
lengths give their character spans, and the sorted spans meet the sorted sections in one pass.

Rule for a token over a boundary (``rule``): ``majority``, the default, gives it to the section that
holds most of its characters, the earlier among equals; ``first`` to the section of its first
character. A character whose bytes are spread over several tokens belongs to each of them. Sections
tile the text, so every token goes to exactly one section and the counts add up to the whole.

Sections are the pieces between separators (``separator``, by default a line break); a separator
belongs to the section before it.

Defined cases: null or empty text is one empty section without tokens; further columns are ignored;
repeated rows are counted one by one; texts may be of any length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from pagegauge.llm.base import chosen, mapped
from pagegauge.llm.byte_bpe import read_ranks

RANKS_LIMIT = 64 << 20


@functools.lru_cache(maxsize=1)
def _encoder(rank_bytes: tuple[bytes, ...], pattern: str):
    """Encoder and token lengths of this worker process, kept from task to task."""
    ranks = {token: rank for rank, token in enumerate(rank_bytes)}
    lengths = np.array([len(t) for t in rank_bytes], dtype=np.int64)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, encoding: tiktoken.Encoding, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of every token."""
    ids = np.array(encoding.encode_ordinary(text), dtype=np.int64)
    ends = np.cumsum(lengths[ids])
    data = np.frombuffer(text.encode(), np.uint8)
    if len(ends) and ends[-1] != len(data):
        raise ValueError("the pattern leaves characters out")
    # Number of the character that each byte belongs to.
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return char[ends - lengths[ids]], char[ends - 1] + 1


def attributed(starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token, and whether it crosses a boundary. ``bounds``: first characters of the sections."""
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, stops - 1, "right") - 1
    crossing = last > first
    if rule == "first" or not crossing.any():
        return first, crossing
    out = first.copy()
    edges = np.append(bounds, np.iinfo(np.int64).max)
    for i in np.flatnonzero(crossing).tolist():
        own = edges[first[i] : last[i] + 2].clip(starts[i], stops[i])
        out[i] = first[i] + int(np.argmax(np.diff(own)))  # the first of the largest
    return out, crossing


def section_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: str = "\n",
    rule: str = "majority",
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_crossing (tokens over a boundary) and sections
    (char_from, char_to, n_tokens of each, in order)."""
    if rule not in ("majority", "first"):
        raise ValueError(f"unknown rule {rule}")
    ranks = read_ranks(ranks_path)
    if sum(map(len, ranks)) > RANKS_LIMIT:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(ranks, key=ranks.__getitem__)))
    own = chosen(docs, id_col, text_col)
    id_type = own.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, n_tokens bigint, n_crossing bigint, "
        "sections array<struct<char_from:bigint,char_to:bigint,n_tokens:bigint>>"
    )
    sections_type = pa.list_(pa.struct([("char_from", pa.int64()), ("char_to", pa.int64()), ("n_tokens", pa.int64())]))

    def start():
        encoding, lengths = _encoder(shared.value, pattern)

        def step(batch: pa.RecordBatch):
            n_tokens, n_crossing, sizes, froms, tos, counts = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                pieces = np.array([len(p) for p in text.split(separator)], dtype=np.int64) + len(separator)
                bounds = np.cumsum(pieces) - pieces
                if text.endswith(separator):
                    bounds = bounds[:-1]  # the separator at the end closes the last section
                if text:
                    starts, stops = token_spans(text, encoding, lengths)
                    section, crossing = attributed(starts, stops, bounds, rule)
                    counts.append(np.bincount(section, minlength=len(bounds)))
                    n_crossing.append(int(crossing.sum()))
                else:
                    counts.append(np.zeros(len(bounds), dtype=np.int64))
                    n_crossing.append(0)
                n_tokens.append(int(counts[-1].sum()))
                sizes.append(len(bounds))
                froms.append(bounds)
                tos.append(np.append(bounds[1:], len(text)))
            rows = [pa.array(np.concatenate(x) if x else np.array([]), pa.int64()) for x in (froms, tos, counts)]
            flat = pa.StructArray.from_arrays(rows, names=["char_from", "char_to", "n_tokens"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": n_tokens,
                "n_crossing": n_crossing,
                "sections": pa.ListArray.from_arrays(offsets, flat).cast(sections_type),
            }

        return step

    return mapped(own, schema, None, start)
