"""Suffix-array dedup of long byte strings, as a merge sort over many machines.

Every window of ``size`` bytes has an anchor, the leftmost of its ``GRAM``-byte pieces with the
smallest hash: equal windows have it at the same place, and neighbouring windows mostly share it, so
the suffixes that begin at anchors are a sparse suffix array in which no window is missed. Suffixes
whose first bytes occur once go (their distinguishing prefix is known to end there). The others are
sorted in every task, front-coded, exchanged by leading bits in runs, and merged by loser trees that
carry common-prefix lengths (``suffix_runs``).

The merged order gives what suffixes share on the right of their anchors, a second sort what they
share on the left. A window lies at offset o of its anchor and repeats when another suffix shares o
bytes on the left and the rest on the right. Of every anchor the first and the last repeated window
are kept: those between are covered by these, as they lie less than a window apart.

Texts that are equal as a whole are settled first, one of them goes on. Leading pieces that occur
more often than one task should hold (``HOT``) are settled by counting the hashes of their windows.

Defined cases: null text is empty; texts shorter than a window lose nothing; rows are documents of
their own, repeated rows are copies of each other, null identifiers make no difference; an empty
table gives an empty result; texts may be of any length; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.base import Stage, chosen, fingerprint, mapped, texts
from pagegauge.llm.suffix_runs import common, decoded, front_coded, merged
from pagegauge.llm.wordgrams import buffer_of, mix, powers

GRAM = 32
PIECE = 1 << 20
BUFFERED = 24 << 20
PER_RANGE = 8_000
HOT = 60_000
_BASE = 0x9E6C63D0876A9A35


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = (p[: n + 1] for p in _powers(max(n + 1, PIECE + 1024)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: n - size + 1])


def anchors_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: place, smallest and largest offset of a window to it, and hash of its piece."""
    width = size - GRAM + 1
    places, least, most, keys = [], [], [], []
    for begin in range(0, max(len(data) - size + 1, 0), PIECE):
        part = data[begin : begin + PIECE + size - 1]
        grams = gram_hashes(part, GRAM)
        n = len(grams) - width + 1
        bits = np.uint64(21)
        low = np.uint64((1 << 21) - 1)
        ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        blocks = -(-len(ranked) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(ranked)] = ranked
        padded = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        best = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
        del bits
        at = np.arange(n) + begin
        # Windows inside one text.
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + size <= offsets[text + 1]
        at, best = at[inside], best[inside]
        if not len(at):
            continue
        cut = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        ends = np.append(cut[1:], len(at)) - 1
        own = best[cut]
        places.append(own + begin)
        most.append(own + begin - at[cut])
        least.append(own + begin - at[ends])
        keys.append(grams[own])
    if not places:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    place, low_, high, key = (np.concatenate(x) for x in (places, least, most, keys))
    # An anchor of windows in two pieces is one.
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[cut], np.minimum.reduceat(low_, cut), np.maximum.reduceat(high, cut), key[cut]


def keyed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row, bytes, hash of the whole text and the hashes of its anchors' pieces."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch):
        data, offsets = buffer_of(batch.column("text"))
        place, _, _, key = anchors_of(data, offsets, size)
        cut = np.searchsorted(place, offsets)
        return {
            "doc_id": batch.column("doc_id"),
            "row": batch.column("row"),
            "n": np.diff(offsets),
            "whole": [hashlib.sha256(t).digest()[:16] for t in texts(batch.column("text"))],
            "keys": [key[i:j].view(np.int64) for i, j in zip(cut[:-1], cut[1:], strict=True)],
        }

    return mapped(docs, f"doc_id {id_type}, row bigint, n bigint, whole binary, keys array<bigint>", step)


def _asked_anchors(batch: pa.RecordBatch, size: int):
    """Anchors of a batch whose pieces are asked for: text number, begin and end of the text, place, offsets, key."""
    data, offsets = buffer_of(batch.column("text"))
    place, low, high, key = anchors_of(data, offsets, size)
    cut = np.searchsorted(place, offsets)
    keep = np.zeros(len(place), bool)
    wanted = batch.column("keys")
    for t, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        keep[i:j] = np.isin(key[i:j].view(np.int64), wanted[t].values.to_numpy())
    place, low, high, key = place[keep], low[keep], high[keep], key[keep]
    text = np.searchsorted(offsets, place, "right") - 1
    return data, offsets, text, place, low, high, key


RUN = (
    "part bigint, shared array<int>, rest_size array<int>, rests binary, left_size array<int>, lefts binary, "
    "doc_id array<{id}>, row array<bigint>, place array<bigint>, low array<int>, high array<int>"
)


def sorted_runs(docs: DataFrame, size: int, bits: int, id_type: str) -> DataFrame:
    """Front-coded sorted runs of the suffixes at asked anchors, cut by the leading bits of their order."""
    from pagegauge.llm.base import arrow_schema
    from pyspark.sql import types as T

    struct = T.StructType.fromDDL(RUN.format(id=id_type))
    fields = arrow_schema(struct)

    def run(batches):
        held: list[tuple] = []
        weight = 0

        def flush():
            held.sort(key=lambda m: (m[0], m[1]))
            by_part = defaultdict(list)
            for m in held:
                by_part[int.from_bytes(m[0][:8], "big") >> (64 - bits) if bits else 0].append(m)
            out = []
            for part, own in by_part.items():
                coded = list(front_coded([m[0] for m in own]))
                sizes, lefts, last = [], [], None
                for m in own:
                    same = m[1] == last
                    sizes.append(-1 if same else len(m[1]))
                    lefts.append(b"" if same else m[1])
                    last = m[1]
                out.append(
                    {
                        "part": part,
                        "shared": [n for n, _ in coded],
                        "rest_size": [len(r) for _, r in coded],
                        "rests": b"".join([r for _, r in coded]),
                        "left_size": sizes,
                        "lefts": b"".join(lefts),
                        "doc_id": [m[2] for m in own],
                        "row": [m[3] for m in own],
                        "place": [m[4] for m in own],
                        "low": [m[5] for m in own],
                        "high": [m[6] for m in own],
                    }
                )
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[i : i + 64], schema=fields)

        for batch in batches:
            data, offsets, text, place, low, high, key = _asked_anchors(batch, size)
            raw = data.tobytes()
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            heads = key.astype(">u8").tobytes()
            for i, (t, a, lo, hi) in enumerate(zip(text.tolist(), place.tolist(), low.tolist(), high.tolist(), strict=True)):
                begin, end = int(offsets[t]), int(offsets[t + 1])
                right = heads[8 * i : 8 * i + 8] + raw[a : min(end, a + size)]
                left = raw[max(begin, a - (size - GRAM)) : a][::-1]
                held.append((right, left, ids[t], rows[t], a - begin, lo, hi))
                weight += len(right) + len(left) + 200
                if weight > BUFFERED:
                    yield from flush()
                    held.clear()
                    weight = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, struct)


class Members:
    """The suffixes of one range in merged order."""

    def __init__(self, size: int):
        self.size = size
        self.runs: list[dict] = []

    def add(self, row: dict) -> None:
        self.runs.append(row)

    @staticmethod
    def _strings(row: dict):
        at = 0
        rests = row["rests"]
        for n, more in zip(row["shared"], row["rest_size"], strict=True):
            yield n, rests[at : at + more]
            at += more

    @staticmethod
    def _lefts(row: dict) -> list[bytes]:
        out, at = [], 0
        for n in row["left_size"]:
            if n < 0:
                out.append(out[-1])
            else:
                out.append(row["lefts"][at : at + n])
                at += n
        return out

    def covered(self) -> list[tuple]:
        """(doc_id, row, from, to) of the bytes that repeated windows of each anchor cover."""
        size = self.size
        lefts = [self._lefts(r) for r in self.runs]
        next_in = [0] * len(self.runs)
        shared, strings, members = [], [], []
        for n, suffix, i in merged([decoded(self._strings(r)) for r in self.runs]):
            shared.append(n)
            strings.append(suffix)
            members.append((i, next_in[i]))
            next_in[i] += 1
        out = []
        meta = lambda i, j: tuple(self.runs[i][c][j] for c in ("doc_id", "row", "place", "low", "high"))
        # Suffixes with equal bytes on both sides are one class; a class of two or more repeats as a whole.
        classes: list[tuple[int, bytes, list]] = []  # shared with the class before on the right, left bytes, members
        block: dict[bytes, list] = {}
        begun = 0

        def close():
            for number, (left, own) in enumerate(block.items()):
                classes.append((begun if number == 0 else len(last), left, own))

        last = b""
        for n, suffix, (i, j) in zip(shared, strings, members, strict=True):
            if n < len(suffix) or n < len(last):
                if block:
                    close()
                block, begun = {}, n
            block.setdefault(lefts[i][j], []).append(meta(i, j))
            last = suffix
        if block:
            close()
        del strings
        for _, _, own in classes:
            if len(own) > 1:
                out += [(d, r, a - hi, a - lo + size) for d, r, a, lo, hi in own]
        # Only classes beside another one with the same leading piece can repeat in part.
        right = np.array([c[0] for c in classes], dtype=np.int64) - 8
        near = right >= GRAM
        beside = near | np.append(near[1:], False) if len(right) else near
        if beside.any():
            out += self._partly([c for c, b in zip(classes, beside.tolist(), strict=True) if b], right[beside])
        return out

    def _partly(self, classes: list[tuple], right: np.ndarray) -> list[tuple]:
        size, n = self.size, len(classes)
        order = sorted(range(n), key=lambda c: classes[c][1])
        left = np.zeros(n, np.int64)
        for x, y in zip(order[:-1], order[1:], strict=True):
            left[y] = common(classes[x][1], classes[y][1])
        by_left = np.array(order)
        alone = np.array([len(c[2]) == 1 for c in classes])
        low = np.array([c[2][0][3] for c in classes])
        high = np.array([c[2][0][4] for c in classes])
        first, last = np.full(n, -1), np.full(n, -1)
        for o in range(int(low[alone].min(initial=size)), int(high[alone].max(initial=-1)) + 1):
            on_right = np.cumsum(right < size - o)
            on_left = np.empty(n, np.int64)
            on_left[by_left] = np.cumsum(left[by_left] < o)
            both = on_right * (n + 1) + on_left
            ranked = np.argsort(both, kind="stable")
            same = both[ranked][1:] == both[ranked][:-1]
            again = np.zeros(n, bool)
            again[ranked[1:][same]] = True
            again[ranked[:-1][same]] = True
            hit = again & alone & (low <= o) & (o <= high)
            first[hit & (first < 0)] = o
            last[hit] = o
        out = []
        for c in np.flatnonzero(last >= 0).tolist():
            d, r, a, _, _ = classes[c][2][0]
            out.append((d, r, a - int(last[c]), a - int(first[c]) + size))
        return out


def covered_ranges(runs: DataFrame, size: int, id_type: str) -> DataFrame:
    """(doc_id, row, begin, stop) from the runs of all ranges, each merged in one task."""
    ordered = runs.repartition("part").sortWithinPartitions("part")
    from pagegauge.llm.base import arrow_schema
    from pyspark.sql import types as T

    struct = T.StructType.fromDDL(f"doc_id {id_type}, row bigint, begin bigint, stop bigint")
    fields = arrow_schema(struct)

    def run(batches):
        part, own = None, None

        def result():
            found = own.covered()
            return pa.record_batch([pa.array([f[i] for f in found], type=fields[i].type) for i in range(4)], schema=fields)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if own is not None:
                        yield result()
                    part, own = row["part"], Members(size)
                own.add(row)
        if own is not None:
            yield result()

    return ordered.mapInArrow(run, struct)


def counted_windows(docs: DataFrame, size: int, id_type: str) -> DataFrame:
    """(doc_id, row, place, o, w1, w2): every window at an asked anchor, for pieces too frequent to merge."""

    def step(batch: pa.RecordBatch):
        data, offsets, text, place, low, high, _ = _asked_anchors(batch, size)
        count = high - low + 1
        of = np.repeat(np.arange(len(place)), count)
        o = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
        begin = place[of] - o
        one, two = gram_hashes(data, size), gram_hashes(data ^ np.uint8(0x5A), size)
        take = pa.array(text[of])
        return {
            "doc_id": batch.column("doc_id").take(take),
            "row": batch.column("row").take(take),
            "place": place[of] - offsets[text[of]],
            "o": o,
            "w1": one[begin].view(np.int64),
            "w2": two[begin].view(np.int64),
        }

    return mapped(docs, f"doc_id {id_type}, row bigint, place bigint, o int, w1 bigint, w2 bigint", step)


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes)."""
    if size <= GRAM:
        raise ValueError(f"windows need more than {GRAM} bytes")
    stage = Stage(docs.sparkSession)
    own = chosen(docs, id_col, text_col).withColumn("row", fingerprint(F.col("text")))
    id_type = own.schema["doc_id"].dataType.simpleString()
    rows = stage.keep(keyed(own, size).filter(F.col("n") >= size), "keyed")
    # Tables of counts are written before rows meet them: each join deals both sides itself, and Spark
    # can split the rows of a hot key.
    classes = stage.keep(rows.groupBy("whole").agg(F.count("*").alias("copies"), F.min("doc_id").alias("of")), "classes")
    known = rows.select("doc_id", "row", "whole").join(classes, "whole")
    wholes = known.filter("copies > 1").select("doc_id", "row").distinct()
    one = classes.withColumnRenamed("whole", "w")
    firsts = rows.join(one, (F.col("whole") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    keys = firsts.select("doc_id", "row", F.explode("keys").alias("key"))
    counts = stage.keep(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "counts")
    total, most = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    bits = max(0, (total // PER_RANGE).bit_length())

    def asked(which: DataFrame, name: str) -> DataFrame:
        """Texts with the keys that are asked of them."""
        want = keys.join(which.select("key"), "key").groupBy("doc_id", "row").agg(F.collect_set("key").alias("keys"))
        want = stage.keep(want, name).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "keys")
        return own.join(want, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "row", "text", "keys")

    runs = sorted_runs(asked(counts.filter(F.col("c") <= hot), "asked"), size, bits, id_type)
    found = covered_ranges(runs, size, id_type)
    if most > hot:
        windows = stage.keep(counted_windows(asked(counts.filter(F.col("c") > hot), "asked-hot"), size, id_type), "windows")
        twice = stage.keep(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1").select("w1", "w2"), "twice")
        ends = windows.join(twice, ["w1", "w2"]).groupBy("doc_id", "row", "place").agg(F.min("o").alias("a"), F.max("o").alias("b"))
        found = found.unionByName(ends.select("doc_id", "row", (F.col("place") - F.col("b")).alias("begin"), (F.col("place") - F.col("a") + size).alias("stop")))
    found = found.unionByName(wholes.select("doc_id", "row", F.lit(0).cast("bigint").alias("begin"), F.lit(-1).cast("bigint").alias("stop")))
    marks = stage.keep(found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("begin", "stop")).alias("spans")), "marks")
    marks = marks.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "spans")
    joined = own.join(marks, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "spans")

    def step(batch: pa.RecordBatch):
        sizes, removed, n_spans, kept = [], [], [], []
        for text, spans in zip(texts(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            pieces, at, gone, runs_ = [], 0, 0, 0
            edges = sorted((s["begin"], len(text) if s["stop"] < 0 else s["stop"]) for s in spans or [])
            reach = None
            for a, b in edges:
                if reach is None or a > reach:
                    pieces.append(text[at:a])
                    runs_ += 1
                    gone += b - a
                    reach = b
                elif b > reach:
                    gone += b - reach
                    reach = b
                at = reach
            pieces.append(text[at:])
            sizes.append(len(text))
            removed.append(gone)
            n_spans.append(runs_)
            kept.append(b"".join(pieces))
        return {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_removed": removed, "n_spans": n_spans, "kept": kept}

    return mapped(joined, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", step)
