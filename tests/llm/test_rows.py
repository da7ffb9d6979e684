"""Operators on single documents: quality rules, decontamination, tokens, token counts."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagegauge.llm import byte_bpe, decontaminate, quality, token_counts
from pagegauge.llm.base import fingerprint

SPACE = " \t\n\v\f\r"


@pytest.fixture(scope="module")
def known():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(prose):
    rng = random.Random(3)
    strange = "".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(3000))
    return [None, "", " \n\n ", "a", "aaaa" * 20000, "▁⁇ <unk> <s> <|endoftext|>", "日本語🎉", strange, prose(1, 300), prose(2, 30000), prose(1, 300), "x\n\ny\n\n\n  z\n"]


# Byte-level BPE


def test_bpe_is_that_of_a_rank_tokenizer(make, prose, known):
    rows = [(i, t) for i, t in enumerate(odd_texts(prose))] + [(None, "no number"), (3, "a"), (3, "a")]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.coded(make(rows), path, public_tokenizers.PATTERN, keep_ids=True).collect()
    want = [(d, known.encode_ordinary(t or ""), t or "") for d, t in rows]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), ids) for d, ids, _ in want)
    digests = {hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(): hashlib.sha256(t.encode()).hexdigest() for _, ids, t in want}
    assert all(digests[r.ids_sha256] == r.decoded_sha256 and r.n_tokens == len(r.ids) for r in got)


def test_bpe_table_may_start_afresh(monkeypatch, prose, known):
    monkeypatch.setattr(byte_bpe, "CACHED", 50)
    codec = byte_bpe.Codec(byte_bpe.model_bytes(known._mergeable_ranks), public_tokenizers.PATTERN)
    for seed in range(5):
        text = prose(seed, 400)
        assert codec.encode(text).tolist() == known.encode_ordinary(text)


def test_bpe_of_no_documents(make):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.coded(make([]), path, public_tokenizers.PATTERN).count() == 0


# Token counts


def plain_sections(text, encoding, rule):
    ends, at = [], 0
    for piece in text.split("\n"):
        at += len(piece) + 1
        ends.append(min(at, len(text)))
    if text.endswith("\n"):
        ends.pop()
    begins = [0, *ends[:-1]]
    counts = [0] * len(ends)
    ids = encoding.encode_ordinary(text)
    data = text.encode()
    place = 0
    for i in ids:
        size = len(encoding.decode_single_token_bytes(i))
        first = len(re.sub(rb"[\x80-\xbf]", b"", data[: place + 1])) - 1
        last = len(re.sub(rb"[\x80-\xbf]", b"", data[: place + size])) - 1
        if rule == "first":
            best = next(s for s, e in enumerate(ends) if first < e)
        else:
            share = [max(0, min(e, last + 1) - max(b, first)) for b, e in zip(begins, ends)]
            best = share.index(max(share))
        counts[best] += 1
        place += size
    return list(zip(begins, ends, counts))


@pytest.mark.parametrize("rule", ["majority", "first"])
def test_sections_are_those_of_a_plain_loop(make, prose, known, rule):
    texts = [t for t in odd_texts(prose) if t is None or len(t) < 10000] + ["a\r\n\r\n b", "\n", "x\n \ny"]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = token_counts.section_tokens(make(list(enumerate(texts))), path, public_tokenizers.PATTERN, rule=rule).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        want = plain_sections(text, known, rule) if text else [(0, 0, 0)]
        assert [(s.char_from, s.char_to, s.n_tokens) for s in r.sections] == want
        assert r.n_tokens == len(known.encode_ordinary(text))


# Decontamination


def plain_hits(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, named = split(text), set(), set()
    for item, t in items:
        own = split(t)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i : i + window]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    named |= {item} - {None}
    return len(words), len(hit), sorted(map(str, named))


@pytest.mark.parametrize("block_bytes", [16 << 20, 120])
def test_hits_are_those_of_a_plain_search(spark, make, prose, block_bytes):
    items = [(1, prose(11, 30)), (2, prose(12, 25)), (12, prose(12, 25)), (3, "Two words"), (4, None), (5, "?!"), (None, prose(13, 12)), (2, prose(12, 25)), (6, "a a a a a a a a a a a a")]
    inside = re.split(r"(?<=\s)", prose(11, 30))
    rows = [
        (1, prose(20, 200)), (2, prose(20, 40) + prose(11, 30).upper() + prose(21, 30)), (3, None), (4, ""), (5, "so TWO—words, two, words!"),
        (6, prose(12, 25) + prose(13, 12)), (7, "".join(inside[:14]) + "zzz " + "".join(inside[14:])), (7, prose(22, 50)), (None, prose(12, 25)), (8, "a " * 5000), (9, prose(23, 20000)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("block", __import__("pyspark").sql.functions.lit("x"))
    got = decontaminate.benchmark_hits(make(rows), bench, block_bytes=block_bytes).collect()
    want = [(d, *plain_hits(t, items)) for d, t in rows if len(t or "") < 20000]
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got if r.doc_id != 9])) == sorted(map(str, want))
    for r in got:  # offsets lead back to the original
        text = next(t for d, t in rows if d == r.doc_id and len(t or "") > 0) if r.hits and r.doc_id != 7 else None
        for h in r.hits if text else []:
            piece = text.encode()[h.byte_from : h.byte_to].decode()
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", piece)) == h.word_to - h.word_from


@pytest.mark.parametrize("block_bytes", [16 << 20, 60])
def test_clean_rows_keep_all_their_columns(spark, make, prose, block_bytes):
    items = [(f"i{i}", prose(40 + i, 12)) for i in range(4)]
    bench = spark.createDataFrame([*items, (None, prose(44, 12)), ("none", None)], "item_id string, text string")
    bad = [(1, f"x {items[2][1]} y"), (2, prose(44, 12)), (3, re.sub("[a-z]", lambda m: m[0].upper(), items[0][1])), (3, f"{prose(9, 30)} {items[3][1]}")]
    good = [(3, prose(50, 40)), (3, prose(50, 40)), (4, None), (5, ""), (None, prose(51, 20)), (6, " ".join(items[1][1].split()[:9]))]
    docs = make(bad + good).select("doc_id", "text").withColumn("hits", F.lit("kept")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = decontaminate.uncontaminated(docs, bench, block_bytes=block_bytes)
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text, r.hits, r.m)) for r in got.collect()) == sorted(str((*r, "kept", {"a": 1})) for r in good)
    assert decontaminate.uncontaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.uncontaminated(docs, bench.limit(0)).count() == len(bad + good)


def test_no_items_and_no_documents(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.benchmark_hits(make([(1, "a b")]), none).collect()] == [0]
    assert decontaminate.benchmark_hits(make([]), none).count() == 0


# Quality rules


def plain_quality(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_and_verdicts(make, prose):
    rows = [(i, prose(i, 80)) for i in range(40)] + [
        (100, None), (101, ""), (102, " ".join(w + "$$$" for w in prose(5, 90).split())), (103, "same words again " * 40), (104, ("one line of words\n" * 30) + prose(9, 60)),
        (None, prose(50, 70)), (7, prose(7, 80)), (105, prose(51, 4000)), (106, "a b"), (107, "x" * 50000),
    ]
    docs = make(rows)
    measures = quality.measured(docs.withColumn("text_key", fingerprint(docs["text"])))
    assert {"row", "hits", "lang"} <= set(measures.columns)
    got = quality.verdicts(measures, ["lang", "source"], "text_key", min_docs=10).collect()
    assert len(got) == len(rows)
    want = sorted(str((d, *plain_quality(t))) for d, t in rows if d != 105)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got if r.doc_id != 105) == want
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(40)) - kept == set()
    assert kept & {100, 101, 102, 103, 106, 107} == set()


def test_null_groups_and_empty_table(spark, make, prose):
    docs = make([(i, prose(i, 80)) for i in range(4)]).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    for table, count in ((docs, 4), (docs.limit(0), 0)):
        measures = quality.measured(table.withColumn("text_key", fingerprint(table["text"])))
        got = quality.verdicts(measures, ["lang", "source"], "text_key")
        assert got.filter("kept").count() == count


def test_only_the_sketch_rejects(make, prose):
    """Word lists with a bar after two words of five pass every base rule, and would pass among their like."""
    listed = lambda seed: " ".join(w + (" |" if i % 5 < 2 else "") for i, w in enumerate(prose(seed, 120).split()))
    odd = [(2 * (200 + i), listed(300 + i)) for i in range(6)]
    plain = [(2 * i, prose(i, 80)) for i in range(120)]
    for rows, rejected in ((plain + odd, {d for d, _ in odd}), (odd, set())):
        docs = make(rows)
        got = quality.verdicts(quality.measured(docs.withColumn("text_key", fingerprint(docs["text"]))), ["lang", "source"], "text_key").collect()
        assert not any(r.base_failed for r in got)
        assert {r.doc_id for r in got if not r.kept} == rejected


def test_merged_sketches_are_the_sketch_of_all(spark, make, prose):
    docs = [make([(i, prose(i, 60 + i)) for i in range(a, b)]) for a, b in ((0, 9), (9, 20))]
    parts = [quality.sketches(quality.measured(d), ["lang"]) for d in docs]
    both = parts[0].unionByName(parts[1]).groupBy("g0", "measure", "bin").agg({"n": "sum"})
    whole = quality.sketches(quality.measured(docs[0].unionByName(docs[1])), ["lang"])
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))


def test_pipeline_fences_come_from_the_sketch(spark, make, prose, tmp_path):
    """Word lists with a bar after two words of five are outside what their group's sketch allows, also
    where a hundred copies of one are among its rows."""
    import corpus_pipeline as pipeline

    listed = lambda seed: " ".join(w + (" |" if i % 5 < 2 else "") for i, w in enumerate(prose(seed, 120).split()))
    one_bar = prose(500, 60) + "|"
    rows = [(i, prose(i, 80)) for i in range(120)] + [(200 + i, listed(300 + i)) for i in range(6)] + [(1000 + i, listed(900)) for i in range(150)] + [(400, one_bar)]
    docs = make(rows, extra=False)
    kept = {r.doc_id for r in pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert kept == {*range(120), 400}


def test_texts_that_share_an_identifier_all_stay(spark, make, prose, tmp_path):
    import corpus_pipeline as pipeline

    rows = [(1, prose(1, 80)), (1, prose(2, 80)), (1, prose(2, 80)), (2, prose(3, 80)), (3, prose(3, 80))]
    kept = pipeline.one_of_each_group(spark, make(rows, extra=False), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, prose(1, 80)), (1, prose(2, 80)), (2, prose(3, 80))])
