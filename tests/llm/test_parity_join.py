import itertools
import random
import re

import numpy as np
import pytest

from tracewalk.llm import parity_join as pj
from tracewalk.llm import textkernel as tk


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            u, v = find(a), find(b)
            root[max(u, v)] = min(u, v)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed, n=160):
    """Families of near copies of all degrees about a base, exact copies, short texts, and a passage many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, i = [], 0
    while i < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 6, 12, 40, 90, 200]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            own = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.005, 0.02, 0.05]) else w for w in base]
            rows.append((i, " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_groups_agree_with_brute_force(spark, k, percent, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_buckets_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(pj, "BLOCK", 3)
    rows = corpus(4, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_a_part_and_sketches_bound_the_difference(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = np.unique(tk.mix(rng.integers(0, 1 << 62, n, dtype=np.uint64)))
        lose = int(rng.integers(0, max(1, n // 6) + 1))
        b = np.union1d(rng.permutation(a)[lose:], tk.mix(rng.integers(0, 1 << 62, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        sizes = np.array([len(a), len(b)])
        if not both or 100 * both < percent * (sizes.sum() - both):
            continue
        keys = [set(), set()]
        for rows, key in pj.part_keys(np.concatenate([a, b]), sizes, percent):
            for r, x in zip(rows.tolist(), key.tolist(), strict=True):
                keys[r].add(x)
        assert keys[0] & keys[1]
        table = pj.SketchTable(pj.sketches(np.concatenate([a, b]), sizes))
        assert table.distances(np.array([0]), np.array([1]))[0] <= sizes.sum() - 2 * both


def test_sketches_of_long_texts_tell_them_apart():
    rng = np.random.default_rng(9)
    sizes = np.array([900, 1100, 1500, 2500, 9000, 30_000])
    sets = [np.unique(tk.mix(rng.integers(0, 1 << 62, n, dtype=np.uint64))) for n in sizes]
    sets.append(np.union1d(sets[3], sets[4][:100]))
    sizes = np.array([len(x) for x in sets])
    raw = pj.sketches(np.concatenate(sets), sizes)
    assert [len(x) * 8 for x in raw] == [1024, 2048, 2048, 4096, 16384, 32768, 4096]
    table = pj.SketchTable(raw)
    i, j = np.triu_indices(len(sets), 1)
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    far = table.distances(i, j)
    assert (far <= apart).all()
    linkable = np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * 70
    assert ((far > 0.2 * (sizes[i] + sizes[j])) | (apart <= 100) | ~linkable).all()


def test_odd_rows(odd_docs, no_docs):
    rows = pj.near_duplicates(odd_docs, 5, 80).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == [by[1][0]] * 2 and by[1][0][1] == 1 and by[2][0][1] == 1
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[8] == [(0, 8)]
    assert sorted(by[None], key=repr) == sorted([(0, None), (18, 1)], key=repr)  # 22 words, five at a time
    assert pj.near_duplicates(no_docs).count() == 0


def brute_links(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    n = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            n[a] += 1
            n[b] += 1
    return n


def test_all_links_of_three_pairwise_different_copies_are_counted(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:at] + [f"x{i}"] + words[at + 1 :])) for i, at in enumerate((20, 90, 160))] + [(3, "alone in here with nobody"), (4, None)]
    got = {r.doc_id: r.n_links for r in pj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, count_links=True).collect()}
    assert got == brute_links(rows, 4, 85) == {0: 2, 1: 2, 2: 2, 3: 0, 4: 0}


@pytest.mark.parametrize("block", [3, 1024])
def test_links_agree_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pj, "LINK_BLOCK", block)
    rows = corpus(7, 120)
    got = {r.doc_id: r.n_links for r in pj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, count_links=True).collect()}
    assert got == brute_links(rows, 4, 85)


@pytest.mark.parametrize("block", [2, 5])
def test_groups_larger_than_a_block(spark, monkeypatch, block):
    monkeypatch.setattr(pj, "LINK_BLOCK", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    # A group of near copies of one text, of which some reach the others by way of a chain only, and another group.
    rows = [(i, " ".join(words[: at] + [f"x{i}"] + words[at + 1 :])) for i, at in enumerate(rng.choices(range(5, 115), k=14))]
    rows += [(100 + i, " ".join([*words, *(f"y{j}" for j in range(3 * i))])) for i in range(20)]
    rows += corpus(5, 40)[:0] + [(1000 + d, t) for d, t in corpus(5, 40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_frequent_keys_dealt_by_node_too(spark, monkeypatch):
    monkeypatch.setattr(pj, "HOT_SAMPLE", 100)
    rows = corpus(6, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(pj._frequent(docs, len(rows), 4, 85, np.zeros(0, np.uint64)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.near_duplicates(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_buckets_of_any_length_in_batches_of_any_length(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted({(int(k), int(k % 3 == 0) * (1 + n % 2), int(n)) for k, n in zip(rng.integers(0, 40, 700) ** 2 // 40, rng.integers(0, 60, 700), strict=True)})
    wanted = {}
    for k, s, n in rows:
        wanted.setdefault(k, set()).add(n)
    for step, most in ((7, 5), (50, 1 << 20), (1000, 12)):
        monkeypatch.setattr(pj, "RUN_ROWS", most)
        k, s, n = (np.array(x) for x in zip(*rows, strict=True))
        batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + step]), pa.array(s[i : i + step].astype(np.int32)), pa.array(n[i : i + step])], names=["key", "salt", "node"]) for i in range(0, len(rows), step)]
        got = {}
        for b in pj._buckets(batches):
            for bucket, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.setdefault(bucket, set()).add(node)
        sets = [x for x in got.values() if len(x) > 1]
        assert {frozenset(x) for x in sets} == {frozenset(x) for x in wanted.values() if len(x) > 1}


def test_sets_that_share_a_digest_are_told_apart():
    rng = np.random.default_rng(4)
    found, sizes = np.sort(rng.integers(0, 1 << 62, 30, dtype=np.uint64)), np.array([10, 0, 20])
    none = np.zeros(0, np.uint64)
    plain, check = pj.digests(found, sizes)
    assert (pj.nodes_of(found, sizes, none) == plain).all() and plain[1] == 0 and len({*plain.tolist(), *check.tolist()}) == 5
    again = pj.nodes_of(found, sizes, np.sort(plain[[0]]))
    assert again[0] != plain[0] and again[2] == plain[2]
