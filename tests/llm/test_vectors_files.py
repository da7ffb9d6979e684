"""Vector codes and token files."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagegauge.llm import token_files, vector_codes

# Vector codes


def plain_lloyd(rows, parts, entries, rounds, scale=1024):
    """Full scans in Python integers over (id, vector, label); ids in order, null last."""
    kept = sorted(((i is None, i or 0, [int(np.floor(scale * x)) for x in v], i, label) for i, v, label in rows), key=lambda r: r[:3])
    cut = len(kept[0][2]) // parts
    pieces = [[r[2][p * cut : (p + 1) * cut] for r in kept] for p in range(parts)]
    books = [[list(x) for x in own[:entries]] for own in pieces]

    def scan(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for x in pieces[p]:
                met.setdefault(scan(p, x)[1], []).append(x)
            for e, own in met.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [[scan(p, pieces[p][k]) for p in range(parts)] for k in range(len(kept))]
    out = [(str(kept[k][3]), [e for _, e in f], [d for d, _ in f]) for k, f in enumerate(found)]
    flat = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(out), hashlib.sha256(flat.encode()).hexdigest()


VEC = "vec_id long, embedding array<float>, label int"


def rows_of(found):
    return sorted((str(r["id"]), list(r["codes"]), list(r["errors"])) for r in found.rows.collect())


@pytest.mark.parametrize("width,coarse", [(8, False), (8, True), (12, True)])
def test_lloyd_is_that_of_full_scans(spark, width, coarse):
    rng = np.random.default_rng(width + coarse)
    values = rng.integers(-2, 3, (300, width)) / 1024 if coarse else rng.normal(size=(300, width))
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i % 5 else None) for i, v in enumerate(values.tolist())]
    rows += [(None, rows[0][1], 1), (7, rows[9][1], 2), (7, rows[9][1], 2), (8, rows[1][1], None)]
    found = vector_codes.compressed(spark.createDataFrame(rows, VEC).repartition(5), parts=4, entries=16, rounds=4)
    want, digest = plain_lloyd(rows, 4, 16, 4)
    assert rows_of(found) == want and found.digest() == digest


def test_moved_entries_decide_like_all_entries():
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (500, 3))
    entries = rng.integers(-3, 4, (20, 3))
    who, far = vector_codes.nearest(x, entries)
    for _ in range(20):
        moved = np.sort(rng.choice(20, rng.integers(0, 8), replace=False))
        entries = entries.copy()
        entries[moved] = rng.integers(-3, 4, (len(moved), 3))
        who, far = vector_codes.reassigned(x, who, far, entries, moved)
        full = vector_codes.nearest(x, entries)
        assert (who == full[0]).all() and (far == full[1]).all()


def test_rows_without_whole_vectors_go(spark):
    whole = [(1, [0.5, -0.5, 0.25, -0.001], None), (2, [0.5, -0.5, 0.25, 3e30], 4), (3, [1e-9, 0.0, -1e-9, 2.0], 4)]
    bad = [(4, None, 1), (5, [0.1, None, 0.2, 0.3], 1), (6, [float("nan")] * 4, 1), (7, [float("inf")] * 4, 1), (8, [], 1), (9, [1.0] * 8, 1), (10, [1.0] * 3, 1)]
    table = spark.createDataFrame(whole + bad, VEC)
    for name in ("id", "x", "codes", "errors", "part", "entry", "sums", "of_label", "n"):
        table = table.withColumn(name, F.lit("other"))
    found = vector_codes.compressed(table, entries=2)
    assert [r[0] for r in rows_of(found)] == ["1", "2", "3"]
    bound = vector_codes.limit(4)
    assert found.codebooks[3].max() == bound and found.codebooks[3].min() < 2048
    errors = found.rows.select("id", "label", F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b).alias("error"))
    got = {r["id"]: r for r in vector_codes.label_errors(errors).collect()}
    assert got[2]["label_error"] == got[3]["label_error"] == got[2]["error"] + got[3]["error"]
    assert got[1]["label_error"] == got[1]["error"]


def test_no_vectors_no_codes(spark):
    for rows in ([], [(1, None, 2)]):
        found = vector_codes.compressed(spark.createDataFrame(rows, VEC))
        assert found.rows.count() == 0 and [len(b) for b in found.codebooks] == [0] * 4
        assert found.digest() == hashlib.sha256(b"").hexdigest()


# Token files


@pytest.fixture(scope="module")
def plain():
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "x\ty  z\r\n q", "<|endoftext|> and <|endoftext|>", "don't we'll. I, A.B, 3. 4,", "日本語 🎉 é, ü.   　x  y", "a\x1c b \x1f c", "word." * 3000, "1 " * 5000]


def test_chunks_give_the_tokens_of_whole_texts(prose, plain, monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read())
    given = [t or "" for t in ODD] + [prose(i, 200) for i in range(20)]
    for cached in (600_000, 50):
        monkeypatch.setattr(token_files, "CACHED", cached)
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(given)] == [plain(t) for t in given]


@pytest.mark.parametrize("length,files", [(16, 2), (24, 1000), (2048, 4096)])
def test_documents_come_back_from_the_files(make, prose, plain, length, files):
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD * 2)] + [(200 + i, prose(i, 80)) for i in range(30)] + [(None, "none"), (5, "same"), (5, "same"), (5, "other")]
    manifest = token_files.write_sequences(make(rows), public_tokenizers.path("byte_bpe_50k.json"), length=length, file_sequences=files)
    got = token_files.read_documents(manifest).collect()
    want = sorted((str(d), len(plain(t)) + 1, crc([*plain(t), 2])) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    listed = manifest.collect()
    reader = token_files.Sequences(listed)
    assert len(reader) == sum(r.sequences for r in listed)
    stream = []
    for i in range(len(reader)):
        own, mask = reader[i]
        bits = np.unpackbits(mask, bitorder="little")[:length].astype(bool)
        assert len(own) == length and not own.flags.owndata and not own.flags.writeable and not own[~bits].any()
        stream += own[bits].tolist()
    assert crc(stream) == token_files.crc_joined([(r.ids_crc32, 4 * r.n_tokens) for r in got])
    with pytest.raises(IndexError):
        reader[len(reader)]


def test_no_documents_no_files(make):
    manifest = token_files.write_sequences(make([]), public_tokenizers.path("byte_bpe_50k.json"))
    assert manifest.count() == 0 and token_files.read_documents(manifest).count() == 0


def test_digests_of_pieces_join():
    data = bytes(range(256)) * 40
    for cut in (0, 1, 77, len(data)):
        pieces = [data[:cut], data[cut:]]
        assert token_files.crc_joined([(zlib.crc32(p), len(p)) for p in pieces]) == zlib.crc32(data)
