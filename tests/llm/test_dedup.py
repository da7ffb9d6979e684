"""Operators across documents: lines, strings, passages and near-duplicate groups."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagegauge.llm import jaccard, line_dedup, recompression, substring_dedup, suffix_dedup, suffix_runs, wordgrams
from pagegauge.llm.base import Stage
from pagegauge.llm.components import components

SPACE = " \t\n\v\f\r"


def copies(prose):
    """Documents with shared lines and passages, copies, odd texts, a repeated number and null numbers."""
    base, line = prose(100, 220), "This very line stands in many of them, twice."
    words = base.split()
    rows = [(i, prose(i, 120) + "\n" + line + "\n" + prose(i + 50, 40)) for i in range(12)]
    rows += [(20, base), (21, base), (22, base.upper()), (23, base + " and more"), (24, " ".join(words[:180])), (25, " ".join(words[40:]))]
    rows += [(26 + i, " ".join(words[:i] + [f"new{i}"] + words[i:])) for i in range(8)]
    rows += [(40, None), (41, ""), (42, " \n "), (43, "two words"), (44, "Two words"), (45, "a " * 4000), (46, "a " * 3000 + "b"), (47, line), (48, f"  {line.upper()}\t\n{line}")]
    rows += [(60, prose(200, 100)), (60, prose(201, 90)), (60, prose(201, 90)), (None, base), (None, None), (61, prose(202, 9000)), (62, "xx" + prose(202, 9000)[2000:])]
    return rows


# Lines


def test_lines_of_a_plain_loop(make, prose):
    rows = copies(prose)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 20:
                holders[key(x)].add(d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == d]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.deduped(make(rows))
    assert {"row", "lang", "key"} <= set(got.columns)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.kept_text)) for r in got.collect())
    assert line_dedup.deduped(make([])).count() == 0


# Suffixes


def test_merge_of_runs_is_a_sort():
    rng = random.Random(1)
    for runs in (0, 1, 2, 3, 5, 8):
        data = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(runs)]
        out = list(suffix_runs.merged([suffix_runs.decoded(suffix_runs.front_coded(r)) for r in data]))
        assert [s for _, s, _ in out] == sorted(s for r in data for s in r)
        last = b""
        for n, s, _ in out:
            assert n == suffix_runs.common(last, s) == len(__import__("os").path.commonprefix([last, s]))
            last = s


def plain_strings(rows, size):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + size] for _, t in texts for i in range(len(t) - size + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        flags = np.cumsum(gone)[:-1] > 0
        spans = int(np.sum(flags & ~np.append(False, flags[:-1]))) if len(t) else 0
        out.append((d, len(t), int(flags.sum()), spans, bytes(b for b, g in zip(t, flags) if not g)))
    return sorted(map(str, out))


@pytest.mark.parametrize("size,hot", [(100, suffix_dedup.HOT), (48, 3)])
def test_strings_of_a_plain_search(make, prose, size, hot):
    rows = copies(prose) + [(80, "ab" * 300 + "x" + "ab" * 300), (81, "q" * (size - 1)), (82, "r" * size), (83, "r" * size), (84, "s" * (size + 1))]
    got = suffix_dedup.deduped(make(rows), size=size, hot=hot).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == plain_strings(rows, size)


def test_strings_of_no_documents(make):
    assert suffix_dedup.deduped(make([])).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch, prose):
    column = pa.array([prose(1, 900), None, "z" * 700, prose(2, 40), prose(1, 900)[200:]])
    data, offsets = wordgrams.buffer_of(column)
    whole = suffix_dedup.anchors_of(data, offsets, 100)
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    for a, b in zip(whole, suffix_dedup.anchors_of(data, offsets, 100)):
        assert np.array_equal(a, b)


# Passages


def plain_passages(rows, size):
    least = {}
    for d, t in rows:
        words = re.findall(f"[^{SPACE}]+", t or "")
        for i in range(len(words) - size + 1) if d is not None else []:
            w = tuple(words[i : i + size])
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        words = re.findall(f"[^{SPACE}]+", t or "")
        gone = {i + j for i in range(len(words) - size + 1) if d is not None and least[tuple(words[i : i + size])] < d for j in range(size)}
        out.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [13, 5])
def test_passages_of_a_plain_search(make, prose, size):
    rows = copies(prose) + [(90, "the " * 40), (91, "the " * 13), (92, "the " * 6 + "cat " * 7), (93, "x " + "the " * 6 + "cat " * 8)]
    got = substring_dedup.deduped(make(rows), size=size).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == plain_passages(rows, size)
    assert substring_dedup.deduped(make([]), size=size).count() == 0


def test_equal_windows_have_equal_keys(prose):
    passage = prose(7, 60)
    texts = [prose(1, 50) + passage + prose(2, 50), prose(3, 31) + passage, passage, "the " * 30 + passage + "the " * 30]
    words = wordgrams.words_of(pa.array(texts), lower=False)
    ranges = recompression.Ranges(words.hash)
    starts = recompression.windows_of(words, 13)
    keys = recompression.window_keys(words, starts, 13, ranges)
    same = defaultdict(set)
    for w, k in zip(ranges.of(starts, starts + 13).tolist(), keys.tolist()):
        same[w].add(k)
    assert len(same) < len(starts) and all(len(k) == 1 for k in same.values())


# Near-duplicate groups


def plain_groups(rows, n, percent):
    sets = []
    for d, t in rows:
        words = re.findall(f"[^{SPACE}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if d is not None and rows[j][0] is not None and (linked or d == rows[j][0]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(str((d, len(sets[i]), min(least[root(i)]) if d is not None else None)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("frequent,pairs_upto,group", [(48, 256, 256), (3, 150, 2), (2, 10, 256)])
def test_groups_of_a_plain_search(monkeypatch, make, prose, frequent, pairs_upto, group):
    monkeypatch.setattr(jaccard, "FREQUENT_LEAST", frequent)
    monkeypatch.setattr(jaccard, "PAIRS_UPTO", pairs_upto)
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng = random.Random(5)
    rows = copies(prose)
    for c in range(6):  # chains: each differs a little from the one before, the ends much
        words = prose(300 + c, 60 + 40 * c).split()
        for i in range(14):
            rows.append((500 + 20 * c + i, " ".join(words)))
            for _ in range(1 + c // 3):
                words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
    got = jaccard.similar_groups(make(rows), n=4, percent=85).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain_groups(rows, 4, 85)


def test_large_sets_are_told_apart_by_wide_parities(make, prose):
    """Texts on both sides of a doubling of the places, with common passages that make them candidates."""
    rng = random.Random(9)
    rows = []
    shared = prose(900, 500)
    for c in range(4):
        words = prose(700 + c, 1545).split()
        for i in range(4):
            rows.append((100 * c + i, f"{' '.join(words)} {shared}"))
            for _ in range(1 + 25 * (i > 1)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(50)}"
            words += prose(40 * c + i, 9).split()
    got = jaccard.similar_groups(make(rows), n=4, percent=85).collect()
    sizes = {jaccard.places(r.n_shingles) for r in got}
    assert len(sizes) == 2 and min(sizes) > jaccard.BITS
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == plain_groups(rows, 4, 85)


def test_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(4)
    for n, m, both in [(1100, 1200, 1000), (2040, 2060, 2000), (5000, 5000, 0), (1500, 3000, 1400)]:
        pool = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
        a, b = jaccard.parities(pool[:n], jaccard.places(n)), jaccard.parities(pool[n - both :], jaccard.places(m))
        least = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (a, b))
        assert np.array_equal(a, jaccard.parities(pool[:n], least * 64))
        differ = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        assert differ <= n + m - 2 * both
        if not both:
            assert differ * 185 > 15 * (n + m)


def test_groups_of_no_documents(make):
    assert jaccard.similar_groups(make([])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), Stage(spark), "c").collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent if x in got} and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Stage(spark), "c").count() == 0


def test_hashes_of_words_do_not_depend_on_neighbours(monkeypatch, prose):
    text = prose(4, 300)
    one = wordgrams.words_of(pa.array([text]), lower=True)
    monkeypatch.setattr(wordgrams, "CHUNK", 17)
    two = wordgrams.words_of(pa.array(["zz", None, text, "zz"]), lower=True)
    assert np.array_equal(one.hash, two.hash[1:-1])
    assert len(set(one.hash.tolist())) == len({w for w in text.encode().lower().split()})
