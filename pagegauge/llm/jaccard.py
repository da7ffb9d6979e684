"""Groups of documents whose word n-gram sets are similar, by an exact prefix-filtered join.

Documents are sets of hashed n-word shingles; equal sets are one node. Every set is put in one order
(rare shingles first, shingles of frequent classes last, by their counts), and its prefix is long
enough that two sets over the threshold share at least k shingles of their prefixes. Rare shingles
of a prefix are indexed singly; of the frequent ones every pair is indexed, so a frequent shingle
alone makes no candidate. Two shared shingles are a shared rare one or a shared frequent pair. Sets
with fewer shared prefix shingles than any partner would need are left out before that. In large
sets, where pairs would be many, frequent shingles are indexed singly as well (the size classes
overlap, so no pair of sets falls between).

Candidates are verified on the shingles themselves. Only links between different components matter,
so the members of an entry are first compared with the smallest of them. Then every pair of members
of one entry that are still in different components is verified: no link is lost, and groups of
copies never become all pairs. Before a pair's texts meet, the parities of both sets (a bound on what they
differ by) must allow it: first those over ``BITS`` places, which the index entries carry, then, for
sets that fill these, those over as many places as half the set's size, a few bytes in the place of a text.

Shingles are 64-bit hashes. The list of frequent shingles is broadcast; its length is bounded
(``FREQUENT_LIMIT``), as a shingle must have a fixed share of all.

Defined cases: null, empty or blank text has no shingle, links with nothing and is its own
component; fewer words than n are one shingle; a row with a null identifier has a null component;
rows of one identifier are one document and belong together; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm.base import Stage, chosen, mapped
from pagegauge.llm.components import components
from pagegauge.llm.wordgrams import mix, shingle_sets, words_of

FREQUENT_LIMIT = 400_000
FREQUENT_LEAST = 48
COUNT_CHUNK = 1 << 21
#: Sets up to this size index pairs of frequent shingles, larger ones single shingles.
PAIRS_UPTO = 256
#: Places of the parities that travel with the index entries; larger sets have wider ones beside them.
BITS = 512
GROUP = 256


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set over the threshold, at least."""
    return -(-percent * n // 100)


def shared_in_prefix(n: int, percent: int) -> int:
    """k: shingles that the prefixes of two similar sets share, the smaller one having n."""
    return max(1, min(needed(n, percent), 2 + n // 40))


def places(n: int) -> int:
    """Places of a set's parities: a power of two of at least half its size. Unlike sets differ in a
    quarter of them or more, at every size, and the bound allows fewer for sets that are alike."""
    return max(BITS, 1 << (max(1, -(-n // 2)) - 1).bit_length())


def parities(own: np.ndarray, width: int) -> np.ndarray:
    """Parity of the number of shingles at each place, packed; halves of it fold onto fewer places by xor."""
    odd = (np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def frequent_shingles(docs: DataFrame, n: int, lower: bool, stage: Stage) -> list[tuple[int, int]]:
    """Shingles with a share of all over a bound, and their counts (within one per counted chunk)."""

    def run(batches):
        pending: list[np.ndarray] = []
        size = 0

        def counted():
            values, counts = np.unique(np.concatenate(pending), return_counts=True)
            often = counts > 1
            total = int(counts.sum())
            return pa.record_batch(
                [pa.array(np.append(values[often].view(np.int64), 0)), pa.array(np.append(counts[often], total)), pa.array(np.append(np.ones(often.sum(), bool), False))],
                names=["token", "count", "is_token"],
            )

        for batch in batches:
            own = shingle_sets(words_of(batch.column("text"), lower), n)
            pending += own
            size += sum(map(len, own))
            if size >= COUNT_CHUNK:
                yield counted()
                pending, size = [], 0
        if size:
            yield counted()

    parts = docs.select("text").mapInArrow(run, "token bigint, count bigint, is_token boolean")
    sums = stage.keep(parts.groupBy("token", "is_token").agg(F.sum("count").alias("count")), "counts")
    totals = sums.agg(F.sum(F.when(~F.col("is_token"), F.col("count")))).first()[0] or 0
    least = max(FREQUENT_LEAST, -(-totals // FREQUENT_LIMIT))
    found = sums.filter(F.col("is_token") & (F.col("count") >= least)).select("count", "token").toArrow()
    stage.drop("counts")
    return sorted(zip(found.column("count").to_pylist(), found.column("token").to_pylist(), strict=True))


def signed_sets(docs: DataFrame, frequent: list[tuple[int, int]], n: int, percent: int, lower: bool) -> DataFrame:
    """doc_id, size of the set, two fingerprints of it, the parity of its shingles over ``BITS`` places
    and (``wide``, where there are more) over ``places``, and the rare and the frequent part of its prefix."""
    spark = docs.sparkSession
    tokens = np.array([t for _, t in frequent], dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[order], order.astype(np.int64)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n bigint, f1 bigint, f2 bigint, bits array<bigint>, wide array<bigint>, rare array<bigint>, often array<bigint>"

    def step(batch: pa.RecordBatch):
        known, rank = shared.value
        sizes, f1, f2, bits, wide, rare, often = [], [], [], [], [], [], []
        for own in shingle_sets(words_of(batch.column("text"), lower), n):
            size = len(own)
            sizes.append(size)
            f1.append(mix(own).sum(dtype=np.uint64))
            f2.append(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            bits.append(parities(own, BITS))
            width = places(size)
            wide.append(parities(own, width) if width > BITS else None)
            length = min(size, size - needed(size, percent) + shared_in_prefix(size, percent))
            if len(known) and size:
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                is_often = known[at] == own
                single = own[~is_often][:length]
                heavy = own[is_often][np.argsort(rank[at[is_often]])][: length - len(single)]
            else:
                single, heavy = own[:length], own[:0]
            rare.append(single.view(np.int64))
            often.append(heavy.view(np.int64))
        return {
            "doc_id": batch.column("doc_id"),
            "n": sizes,
            "f1": np.array(f1, dtype=np.uint64).view(np.int64),
            "f2": np.array(f2, dtype=np.uint64).view(np.int64),
            "bits": bits,
            "wide": wide,
            "rare": rare,
            "often": often,
        }

    return mapped(docs, schema, step)


def index_entries(nodes: DataFrame, percent: int, stage: Stage) -> DataFrame:
    """(sig, node, n): the index entries of the nodes that can have a partner; entries of one node go.

    ``nodes``: node, n, rare, often.
    """
    singles = nodes.select("node", F.explode("rare").alias("token"))
    # Tables of counts are written before rows meet them: each join deals both sides itself, and Spark
    # can split the rows of a hot key.
    shared = stage.keep(singles.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "shared-tokens")
    met = singles.join(shared, "token").groupBy("node").agg(F.collect_list("token").alias("rare"))
    own = nodes.select("node", "n", "often", F.size("rare").alias("n_rare")).join(met, "node", "left")
    smallest = F.ceil(F.col("n") * percent / 100)
    k = F.greatest(F.lit(1), F.least(F.ceil(smallest * percent / 100), 2 + F.floor(smallest / 40)))
    own = own.filter(F.coalesce(F.size("rare"), F.lit(0)) + F.size("often") >= k)
    # Two shared shingles are enough for an entry: of the frequent ones, those of the shorter prefix.
    short = F.col("n") - F.ceil(F.col("n") * percent / 100) + 2 - F.col("n_rare")
    own = own.withColumn("often", F.sort_array(F.slice("often", 1, F.greatest(F.lit(0), short).cast("int"))))
    rare = F.expr("transform(coalesce(rare, CAST(array() AS ARRAY<BIGINT>)), x -> xxhash64(1, x))")
    one = F.expr(f"IF(n > {PAIRS_UPTO}, transform(often, x -> xxhash64(1, x)), CAST(array() AS ARRAY<BIGINT>))")
    two = F.expr(
        f"IF(n * {percent} <= {PAIRS_UPTO} * 100, "
        "flatten(transform(often, (x, i) -> transform(slice(often, i + 2, size(often)), y -> xxhash64(2, x, y)))), CAST(array() AS ARRAY<BIGINT>))"
    )
    entries = own.select("node", "n", F.explode(F.concat(rare, one, two)).alias("sig"))
    return entries


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """The pairs (node, center) whose sets are over the threshold.

    Pairs are gathered by center, in groups of about ``GROUP``; a task reads the center's text and
    then its partners' one after the other.
    """
    counts = pairs.groupBy("center").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    centers = counts.join(texts, counts["center"] == texts["node"]).select(
        "center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("node"), "text"
    )
    members = (
        pairs.join(counts, "center")
        .join(texts, "node")
        .select("center", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "text")
    )
    rows = centers.unionByName(members).repartition("center", "part").sortWithinPartitions("center", "part", F.col("node").asc_nulls_first())

    def start():
        state: dict = {"key": None, "sets": []}

        def step(batch: pa.RecordBatch):
            nodes, met = [], []
            sets = shingle_sets(words_of(batch.column("text"), lower), n)
            keys = zip(batch.column("center").to_pylist(), batch.column("part").to_pylist(), strict=True)
            for key, node, own in zip(keys, batch.column("node").to_pylist(), sets, strict=True):
                if key != state["key"]:
                    state.update(key=key, sets=[])
                if node is None:
                    state["sets"].append(own)
                    continue
                for other in state["sets"]:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        nodes.append(node)
                        met.append(key[0])
                        break
            return {"a": nodes, "b": met}

        return step

    return mapped(rows, "a bigint, b bigint", None, start)


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, lower: bool = True
) -> DataFrame:
    """One row per document: doc_id (a long), n_shingles, component_id (smallest doc_id reachable)."""
    spark: SparkSession = docs.sparkSession
    stage = Stage(spark)
    own = chosen(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = stage.keep(signed_sets(own, frequent_shingles(own, n, lower, stage), n, percent, lower), "sets")
    full = sets.filter("doc_id IS NOT NULL AND n > 0")
    classes = stage.keep(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("node")), "classes")
    plain = sets.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2"], "left")
    member = stage.keep(plain.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "members")
    first = full.join(classes.withColumn("doc_id", F.col("node")), ["f1", "f2", "doc_id"]).select("node", "n", "bits", "wide", "rare", "often")
    nodes = stage.keep(first, "nodes")
    stage.drop("sets")
    entries = stage.keep(index_entries(nodes, percent, stage), "entries-all")
    shared = entries.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("sig")
    shared = stage.keep(shared, "shared")
    posting = stage.keep(entries.join(shared, "sig").distinct(), "entries")
    stage.drop("entries-all")
    candidates = posting.select("node").distinct()
    bits = stage.keep(nodes.select("node", *[F.get("bits", F.lit(i)).alias(f"p{i}") for i in range(BITS // 64)]).join(candidates, "node"), "bits")
    wide = stage.keep(nodes.filter("wide IS NOT NULL").select("node", "n", "wide").join(candidates, "node"), "wide")
    stage.drop("nodes")
    texts = stage.keep(own.join(candidates, own["doc_id"] == candidates["node"]).select("node", "text"), "texts")
    # Rows of one identifier with different texts belong together.
    several = member.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("hi"), F.collect_set("node").alias("all"))
    links = stage.keep(several.filter("b < hi").select(F.explode("all").alias("a"), "b"), "links")
    at = posting.withColumn("label", F.col("node"))
    known = at.join(bits, "node")
    pairs = stage.keep(_center_pairs(known, percent), "pairs-0")
    pairs = stage.keep(_not_told_apart(pairs, wide, percent), "near-0")
    links = links.unionByName(stage.keep(verified(pairs, texts, n, percent, lower), "links-0"))
    labels = components(links, stage, "labels-0")
    # Entries whose members are still in different components.
    at = posting.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    at = stage.keep(at, "labelled")
    mixed = at.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("sig")
    mixed = stage.keep(mixed, "mixed")
    pairs = stage.keep(_all_pairs(at.join(mixed, "sig").join(bits, "node"), percent), "pairs-1")
    pairs = stage.keep(_not_told_apart(pairs, wide, percent), "near-1")
    new = stage.keep(verified(pairs, texts, n, percent, lower), "links-1")
    if not new.isEmpty():
        labels = components(links.unionByName(new), stage, "labels-1")
    result = member.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "node")).otherwise(F.col("doc_id"))
    return result.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    )


def _near(percent: int) -> F.Column:
    """Can two sets be over the threshold, by their sizes and parities? A shingle that only one of
    them has changes the parity of one place."""
    fits = (F.col("n") * 100 >= F.col("c_n") * percent) & (F.col("c_n") * 100 >= F.col("n") * percent)
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"c_p{i}"))) for i in range(BITS // 64)), F.lit(0))
    return fits & (differ * (100 + percent) <= (F.col("n") + F.col("c_n")) * (100 - percent))


def _not_told_apart(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs that the wide parities of both sets allow; pairs without two of them pass.

    Of two widths the wider is folded onto the other. Sets in many pairs are met as any hot key: both
    sides of the joins are written tables.
    """
    a = wide.select("node", F.col("n").alias("a_n"), F.col("wide").alias("a"))
    b = wide.select(F.col("node").alias("center"), F.col("n").alias("b_n"), F.col("wide").alias("b"))
    met = pairs.join(a, "node", "left").join(b, "center", "left").select("node", "center", "a_n", "b_n", "a", "b")

    def step(batch: pa.RecordBatch):
        sizes = zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist(), strict=True)
        keep = []
        for (m, n), x, y in zip(sizes, batch.column("a"), batch.column("b"), strict=True):
            if m is None or n is None:
                keep.append(True)
                continue
            x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
            least = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
            differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            keep.append(differ * (100 + percent) <= (m + n) * (100 - percent))
        kept = batch.select(["node", "center"]).filter(pa.array(keep, pa.bool_()))
        return {"node": kept.column("node"), "center": kept.column("center")}

    return mapped(met, "node bigint, center bigint", step)


def _as_center(at: DataFrame) -> list[F.Column]:
    return [F.col("node").alias("center"), *[F.col(c).alias(f"c_{c}") for c in at.columns if c not in ("sig", "node")]]


def _center_pairs(at: DataFrame, percent: int) -> DataFrame:
    """Every member of an index entry with its smallest one."""
    pick = at.groupBy("sig").agg(F.min(F.struct(*_as_center(at))).alias("c")).select("sig", "c.*")
    return at.join(pick, "sig").filter((F.col("label") != F.col("c_label")) & _near(percent)).select("node", "center").distinct()


def _all_pairs(at: DataFrame, percent: int) -> DataFrame:
    """Every pair of members of an index entry in different components that is not ruled out.

    The largest component of an entry is not paired with itself; its members meet the others only.
    """
    sizes = at.groupBy("sig", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("sig").agg(F.max(F.struct("c", "label")).alias("m")).select("sig", F.col("m.label").alias("main"))
    split = at.join(main, "sig")
    few = split.filter("label <> main").select("sig", *_as_center(at))
    once = (F.col("label") == F.col("main")) | (F.col("node") < F.col("center"))
    met = split.join(few, "sig").filter((F.col("label") != F.col("c_label")) & once & _near(percent))
    return met.select("node", "center").distinct()
