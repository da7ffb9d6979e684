"""Language-model scores, URL filters, the pipeline and the registered queries."""

import datetime as dt
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from check import compare, connect

from pagegauge.llm import gated_lm, lm_scores, queries, url_filter

# Language model


def plain_base(rows):
    texts = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    held = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2
    counts = Counter(w for d, t in texts if not held(d) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    return [(d, held(d), len(t), sum(w in counts for w in t), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in t)) for d, t in texts]


@pytest.mark.parametrize("listed", [500_000, 40])
def test_counts_and_base_of_a_plain_loop(monkeypatch, make, prose, listed):
    monkeypatch.setattr(lm_scores, "LISTED", listed)
    rows = [(i, prose(i % 9, 100)) for i in range(40)] + [(50, None), (51, ""), (None, "a B c"), (3, prose(3, 20)), (3, prose(3, 20)), (52, prose(60, 6000)), (53, "only here")]
    got = lm_scores.scored(make(rows)).collect()
    key = lambda d, h, n, k, total: str((d, h, n, k, total))
    assert sorted(key(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == sorted(key(*w[:5]) for w in plain_base(rows))
    assert np.allclose(sorted(r.base_score for r in got), sorted(w[5] for w in plain_base(rows)))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_no_documents_and_none_to_learn_from(make):
    assert lm_scores.scored(make([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lm_scores.scored(make([(held, "a b")])).collect()
    assert row.held_out and row.n_known == 0 and abs(row.base_score) < 1e-9 and abs(row.score) < 1e-6


def test_model_is_a_distribution_and_carries_its_state():
    rng = np.random.default_rng(1)
    counts = np.sort(rng.integers(1, 50, 300))[::-1].astype(float)
    params = gated_lm.initial(counts, 20)
    trainer = gated_lm.Trainer(params)
    y = rng.integers(0, 300, 5000)
    begins = np.zeros(5000, bool)
    begins[::500] = True
    trainer.learn(np.roll(y, 1), y, begins)
    params = trainer.p
    state = gated_lm.states(params, y[:7], np.array([0, 7]))[-1:]
    every = np.append(np.arange(300), gated_lm.RARE)
    total = np.exp(gated_lm.log_probs(params, np.repeat(state, len(every), axis=0), every)).sum()
    assert abs(total - 1) < 1e-4
    # Side by side in windows, or one token after the other.
    first = np.array([0, 150, 150, 151, 1000])
    together = gated_lm.states(params, y[:1000], first, window=16)
    for a, b in zip(first[:-1], first[1:]):
        h = np.zeros(gated_lm.HIDDEN)
        for t in range(a, b):
            z, g = gated_lm._gates(params, y[t])
            h = (1 - z) * h + z * g
            assert np.allclose(h, together[t], atol=1e-4)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(4)
    params = {k: v.astype(np.float64) for k, v in gated_lm.initial(np.arange(200.0, 0, -1), 9).items()}
    params["class_w"] = rng.normal(0, 0.3, params["class_w"].shape)
    params["word_w"] = rng.normal(0, 0.3, params["word_w"].shape)
    x, y = rng.integers(0, 200, (6, 3)), rng.integers(0, 200, (6, 3))
    begins = np.zeros((6, 3), bool)
    begins[2, 1] = True
    found = {}

    class Watched(gated_lm.Trainer):
        def _step(self, name, grad, at=slice(None)):
            whole = found.setdefault(name, np.zeros(self.p[name].shape))
            whole[at] += grad

    watched = Watched(params)
    watched._window(x, y, begins, np.zeros((3, gated_lm.HIDDEN)))

    def loss(p):
        h, total = np.zeros((3, gated_lm.HIDDEN)), 0.0
        for t in range(6):
            z, g = gated_lm._gates(p, x[t])
            h = (1 - z) * np.where(begins[t][:, None], 0, h) + z * g
            total -= gated_lm.log_probs(p, h, y[t]).sum()
        return total / 18

    for name in found:
        for at in np.argwhere(found[name] != 0)[:: max(1, np.count_nonzero(found[name]) // 5)]:
            up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
            up[name][tuple(at)] += 1e-4
            down[name][tuple(at)] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - found[name][tuple(at)]) < 1e-3 * max(1e-2, abs(found[name][tuple(at)]))


def test_held_out_documents_are_foreseen_better_than_by_counts(make):
    rng = np.random.default_rng(3)
    words = [[f"w{k}{i}" for i in range(40)] for k in range(4)]
    rows = [(i, " ".join(rng.choice(words[i % 4], 80))) for i in range(3000)]
    got = [r for r in lm_scores.scored(make(rows).coalesce(2)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.995 * sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.9 * len(got)


def test_the_model_grows_with_the_words():
    """Every word with enough counts is a token of the model, and rarer ones differ as contexts."""
    counts = np.append(np.full(9000, float(gated_lm.LEAST_COUNT)), np.full(5000, 1.0))
    known = gated_lm.known_of(counts)
    assert known == 9000 and gated_lm.known_of(counts[8000:]) == gated_lm.LEAST_KNOWN
    params = gated_lm.initial(counts[:known], 5000, contexts=9000)
    classes, size = params["word_b"].shape
    assert classes * size >= 9000 and abs(classes - size) <= 1
    rare = lm_scores._rare_ids(np.arange(5, 9, dtype=np.uint64), lm_scores._contexts(params))
    assert (rare < 0).all() and len(set(rare)) == 4
    every = np.append(np.arange(known), gated_lm.RARE)
    state = gated_lm.states(params, rare, np.array([0, 1, 2, 3, 4]))
    assert len({tuple(h) for h in state}) == 4
    assert abs(np.exp(gated_lm.log_probs(params, np.repeat(state[:1], len(every), axis=0), every)).sum() - 1) < 1e-3
    trainer = gated_lm.Trainer(params)
    for _ in range(2):  # the gates learn once the weights are not 0
        trainer.learn(np.append(8999, rare), np.append(rare, 8999), np.arange(5) == 0)
    assert (trainer.p["gate"][8999] != params["gate"][8999]).any() and (trainer.p["word_b"] != params["word_b"]).any()


# URL filters


def test_entries_as_of_the_fetch(spark):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    entries = [
        ("spam", "domain", "bad.example", "add", at(10)), ("spam", "domain", "bad.example", "remove", at(20)), ("spam", "domain", "bad.example", "add", at(400)),
        ("spam", "domain", "bad.example", "add", at(10)), ("adult", "host", "a.bad.example", "add", at(0)), ("adult", "prefix", "ok.example/x/y", "add", at(0)),
        ("adult", "url", "ok.example/q?a=1", "add", at(5)), ("tie", "host", "ok.example", "add", at(7)), ("tie", "host", "ok.example", "remove", at(7)),
        (None, "host", "ok.example", "add", at(0)), ("odd", "other", "ok.example", "add", at(0)), ("odd", "host", None, "add", at(0)), ("odd", "host", "ok.example", "add", None),
    ]
    captures = [
        (1, "http://bad.example/", at(9)), (2, "http://bad.example/", at(10)), (3, "https://u:p@WWW.Bad.Example.:8080/p#f", at(19)), (4, "http://bad.example", at(20)),
        (5, "http://x.bad.example/", at(500)), (6, "http://a.bad.example/", at(15)), (7, "http://ok.example/x/y/z?k", at(3)), (8, "http://ok.example/x/yy", at(3)),
        (9, "http://ok.example/q?a=1", at(5)), (10, "http://ok.example/q?a=2", at(5)), (11, None, at(5)), (12, "http://bad.example/", None), (2, "http://bad.example/", at(10)), (None, "", at(3)),
    ]
    e = spark.createDataFrame(entries, "list string, kind string, rule string, action string, at timestamp")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("lists", __import__("pyspark").sql.functions.lit(1))
    got = [(r.page_id, ",".join(r.lists), r.n_active) for r in url_filter.active_entries(c, e).collect()]
    want = [(1, "", 0), (2, "spam", 1), (2, "spam", 1), (3, "spam", 1), (4, "", 0), (5, "spam", 1), (6, "adult,spam", 2), (7, "adult", 1), (8, "", 0), (9, "adult", 1), (10, "", 0), (11, "", 0), (12, "", 0), (None, "", 0)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert url_filter.active_entries(c, e.limit(0)).filter("blocked").count() == 0
    assert url_filter.active_entries(c.limit(0), e).count() == 0


# Registered queries and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    problems, rows = compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name])
    assert not problems, problems
    assert rows > 0


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert {name for name in queries.QUERIES if name not in queries.ORACLES} == {"op3_suffix_array_dedup", "op4_lm_scoring", "op5_token_counts", "op7_byte_level_bpe", "op13_token_files"}


def test_pipeline_keeps_clean_documents(spark, make, prose, tmp_path):
    import corpus_pipeline as pipeline

    clean = [(i, prose(i, 120)) for i in range(12)]
    item = prose(70, 25)
    rows = clean + [
        (50, clean[0][1]), (51, clean[1][1] + " more words"), (52, prose(71, 60) + item + prose(72, 40)), (53, "short"), (54, None), (55, " ".join(w + "$$$" for w in prose(73, 90).split())), (None, prose(74, 80)),
    ]
    docs = make(rows, extra=False)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = docs
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, found, str(tmp_path))
        assert found.columns == docs.columns, name
        found.write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted([*map(str, range(12)), "None"])
    last = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in last) == sorted([*map(str, range(12)), "None"]) and all(r.n_tokens == len(r.ids) for r in last)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
