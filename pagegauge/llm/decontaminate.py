"""Benchmark decontamination: windows of the benchmark's words, found in one scan of every text.

The windows of all items go into one Aho-Corasick automaton. A text is normalised byte by byte
(letters A-Z lowered, every other ASCII byte that is not a word's becomes a blank), so byte offsets
stay those of the original; the scan runs over the words joined by single blanks, and word numbers
lead back to the original offsets.

The automaton is broadcast, so its size is bounded: items are dealt into blocks of about
``block_bytes`` of text by their hash, and every text, read once, passes the automata of all blocks;
one block is the usual case.

Defined cases: null or empty text has no words; a null item text has no windows; an item with a null
identifier still hits words but is not named among the items; repeated items count once, repeated
documents are judged one by one; empty tables give no rows, or no hits. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.base import chosen, mapped, texts

#: Bytes of ASCII letters and digits stay (upper case is lowered), all other ASCII is a blank.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
HITS = "array<struct<item:string,word_from:int,word_to:int,byte_from:bigint,byte_to:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def automaton(items: list[tuple[str | None, bytes]], window: int) -> ahocorasick.Automaton | None:
    """Every window of every item, with its number of words and the items that have it."""
    owners: dict[bytes, set] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners[b" ".join(words[i : i + window])].add(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for words, names in owners.items():
        # Latin-1 gives one character per byte.
        found.add_word(f" {words.decode('latin-1')} ", (words.count(b" ") + 1, sorted(names, key=lambda x: (x is not None, x))))
    found.make_automaton()
    return found


def hits_of(text: bytes, found: ahocorasick.Automaton | None) -> tuple[int, list[tuple]]:
    """Number of words, and per item the merged word ranges of its windows with their byte ranges."""
    plain = text.translate(NORMAL)
    words = plain.split()
    if not words or found is None:
        return len(words), []
    line = f" {b' '.join(words).decode('latin-1')} "
    ends = list(found.iter(line))
    if not ends:
        return len(words), []
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(blanks, [end for end, _ in ends])
    ranges: dict[str | None, list[list[int]]] = defaultdict(list)
    for to, (_, (size, names)) in zip(last.tolist(), ends, strict=True):
        for name in names:
            own = ranges[name]
            # Ends come in order, starts need not when windows differ in size.
            while own and own[-1][1] >= to - size and own[-1][0] >= to - size:
                own.pop()
            if own and own[-1][1] >= to - size:
                own[-1][1] = to
            else:
                own.append([to - size, to])
    at = [m.span() for m in re.finditer(rb"[^ ]+", plain)]
    return len(words), [(name, a, b, at[a][0], at[b - 1][1]) for name, own in ranges.items() for a, b in own]


def blocks_of(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> list[Broadcast]:
    """The items' names and texts, in broadcasts of about ``block_bytes`` of text; one at least."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].alias("text")).dropna(subset="text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        rows = items.filter(F.col("block") == block).select("item", "text").collect()
        found.append(benchmark.sparkSession.sparkContext.broadcast([(r.item, r.text.encode()) for r in rows]))
    return found


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any window), items (sorted names of
    the items with occurring windows) and hits (word and byte ranges in the original text)."""
    found = chosen(docs, id_col, text_col).select("doc_id", "text", F.expr(f"CAST(array() AS {HITS})").alias("hits"), F.lit(0).cast("bigint").alias("n_words"))
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, text string, hits {HITS}, n_words bigint"
    # The texts are read once; the scans of further blocks follow in the same tasks.
    for known in blocks_of(benchmark, item_col, item_text_col, block_bytes):

        def start(known=known):
            machine = automaton(known.value, window)

            def step(batch: pa.RecordBatch):
                got = [hits_of(t, machine) for t in texts(batch.column("text"))]
                named = [[dict(zip(("item", "word_from", "word_to", "byte_from", "byte_to"), h, strict=True)) for h in hs] for _, hs in got]
                hits = [old + [h for h in new if h not in old] for old, new in zip(batch.column("hits").to_pylist(), named, strict=True)]
                return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "hits": hits, "n_words": [n for n, _ in got]}

            return step

        found = mapped(found, schema, None, start)
    covered = F.expr(
        "aggregate(array_sort(transform(hits, h -> struct(h.word_from AS a, h.word_to AS b))), struct(0L AS n, 0 AS upto), "
        "(s, h) -> struct(s.n + greatest(0, h.b - greatest(h.a, s.upto)) AS n, greatest(h.b, s.upto) AS upto), s -> s.n)"
    )
    named = F.expr("array_sort(array_distinct(filter(transform(hits, h -> h.item), x -> x IS NOT NULL)))")
    return found.select("doc_id", "n_words", covered.alias("n_hit"), named.alias("items"), "hits")


def uncontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has no window of an item.

    A row is judged by its own text where it is scanned: nothing is shuffled. Rows of one identifier
    are judged one by one; other columns may have any names but each one once.
    """
    kept = docs
    for known in blocks_of(benchmark, item_col, item_text_col, block_bytes):

        def run(batches, known=known):
            machine = automaton(known.value, window)
            for batch in batches:
                clean = [not hits_of(t, machine)[1] for t in texts(batch.column(text_col))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
