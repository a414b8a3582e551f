import random

import numpy as np
import pyarrow as pa

from tracewalk.llm import decontaminate as dc

SF = "/root/testdata/sf0.01"


def test_lcs_is_the_textbook_one():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert dc.lcs_length([masks.get(y, 0) for y in b], len(a)) == t[-1][-1]


def test_svd_finds_the_leading_space(spark):
    rng = np.random.default_rng(4)
    rows = [[int(x) for x in rng.choice(40, 30, p=None) + 40 * (i % 3)] for i in range(200)]
    idf = np.ones(dc.TERMS)
    table = spark.createDataFrame([(1.0, r) for r in rows], "weight double, terms array<int>")
    two, six = (np.frombuffer(dc._load(dc.randomised_svd(table, idf, rank=3, extra=6, passes=n)), np.float32).reshape(dc.TERMS, -1).T for n in (2, 6))
    row, term, value = dc._tfidf([np.array(r) for r in rows], np.ones(len(rows)), idf)
    dense = np.zeros((200, 120))
    dense[row, term] = value
    want = np.linalg.svd(dense)[2][:3]
    near = [np.linalg.svd(want @ x.T[:120])[1].min() for x in (two, six)]
    assert near[0] > 0.95 and near[1] > 0.9999


def test_basis_is_fitted_on_every_passage_and_item(spark, monkeypatch):
    """Of many subjects a few rows hold few: the basis must hold nearly as much of all rows as the best one does."""
    monkeypatch.setattr(dc, "FIT_PASSAGES", 25)
    monkeypatch.setattr(dc, "FIT_ITEMS", 10)
    rng = random.Random(3)
    texts = [" ".join(f"s{i % 60}w{rng.randrange(12)}" for _ in range(rng.choice([20, 40, 70, 150]))) for i in range(240)]
    items = [" ".join(f"i{i}w{rng.randrange(12)}" for _ in range(20)) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    search = dc._fit(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), dc.COSINE, dc.LCS, dc.ANSWER)

    def terms(text):
        _, _, data, offsets = next(dc.tk.chunks(pa.array([text])))
        return dc.terms_of(dc._words(data, offsets)[2]).astype(np.int64)

    words = [terms(t) for t in texts]
    df = np.bincount(np.concatenate([np.unique(w) for w in words]), minlength=dc.TERMS)
    idf = np.log((len(texts) + 1) / (df + 1)) + 1e-3
    passages = [w[b:e] for w in words for b, e in zip(*dc._passages(np.array([len(w)]))[1:], strict=True)]
    weight = np.concatenate([np.full(len(passages), (25 / len(passages)) ** 0.5), np.full(30, dc.ITEM_WEIGHT * (10 / 30) ** 0.5)])
    row, term, value = dc._tfidf([*passages, *map(terms, items)], weight, idf)
    dense = np.zeros((len(weight), dc.TERMS), np.float32)
    dense[row, term] = value
    basis = np.frombuffer(dc._load(search.table), np.float32).reshape(dc.TERMS, -1) / idf[:, None]
    assert np.allclose(basis.T @ basis, np.eye(dc.RANK), atol=1e-3)
    held, asked = dense[: len(passages)].astype(np.float64), dense[len(passages) :]
    best = np.sort(np.linalg.eigvalsh(held @ held.T))[-(dc.RANK - len(items)) :].sum()  # the items, which weigh more, take a direction each
    assert np.sum((held @ basis) ** 2) > 0.8 * best
    assert np.sum((asked @ basis) ** 2) > 0.9 * np.sum(asked**2)


def test_passages_add_up_as_rows_of_their_own(monkeypatch):
    """The shares that passages give, long texts cut into pieces among them, are those of the same passages as rows."""
    rng = np.random.default_rng(5)
    sizes = [0, 1, 23, 24, 25, 48, 49, 72, 300, 0, 5, 4801, 12]
    texts = [rng.integers(0, 300, n).astype(np.uint16) for n in sizes]
    idf = rng.uniform(0.1, 5, dc.TERMS)
    packed = pa.RecordBatch.from_pydict({"terms": pa.array([x.tobytes() for x in texts], pa.binary())})
    passages = [x[b:e].tolist() for x in texts for b, e in zip(*dc._passages(np.array([len(x)]))[1:], strict=True)]
    rows = pa.RecordBatch.from_pydict({"weight": pa.array([0.5] * len(passages)), "terms": pa.array(passages, pa.list_(pa.int32()))})

    def whole(parts):
        return np.concatenate([np.frombuffer(x, np.float32).reshape(-1, 7) for p in parts for x in p.column("part").to_pylist()])

    for most in (dc.FIT_WORDS, 1 << 12, 100, 30):
        monkeypatch.setattr(dc, "FIT_WORDS", most)
        for last in (False, True):
            want = whole(dc._normal([rows], None, 7, 3, idf, last))
            assert np.allclose(whole(dc._normal_passages([packed.slice(0, 3), packed.slice(3)], None, 7, 3, idf, last, 0.5)), want, rtol=1e-3, atol=1e-4 * abs(want).max())
        (counts,) = dc._frequencies([packed.slice(0, 3), packed.slice(3)])
        got = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist(), strict=True))
        assert got.pop(-1) == len(texts) and got.pop(-2) == len(passages)
        assert got == dict(zip(*(x.tolist() for x in np.unique(np.concatenate([np.unique(x) for x in texts]), return_counts=True)), strict=True))


def paraphrase(words, rng):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < 0.08 else [w, "moreover"] if x < 0.14 else ["otherword"] if x < 0.22 else [w]
    return out


def test_verbatim_and_paraphrased_items_are_found_and_clean_texts_left_alone(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    verbatim = {(d, i) for d, t in texts.items() for i, b in items.items() if b in t}
    held = {d for d, _ in verbatim}
    rng, planted, rows = random.Random(5), set(), [(d, t) for d, t in texts.items()]
    hosts = [d for d in texts if d not in held and len(texts[d].split()) > 30]
    for n, (i, b) in enumerate(sorted(items.items())):
        if len(b.split()) >= 15:
            w = texts[hosts[n]].split()
            at = rng.randrange(len(w))
            rows.append((10_000 + i, " ".join([*w[:at], *paraphrase(b.upper().split(), rng), *w[at:]])))
            planted.add((10_000 + i, i))
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert verbatim <= got
    assert len(planted & got) >= 0.9 * len(planted)
    assert not got - verbatim - planted


def test_drop_keeps_the_rest(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    leaks = {r.doc_id for r in dc.find_leaks(docs, bench).collect()}
    kept = dc.drop_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - leaks


def test_long_items_are_searched_piece_by_piece(spark):
    rng = random.Random(6)
    item = [f"v{rng.randrange(2000)}" for _ in range(300)]
    filler = [f"u{rng.randrange(2000)}" for _ in range(500)]
    rows = [(1, " ".join(filler[:250] + item + filler[250:])), (2, " ".join(filler)), (3, " ".join(item[:60]))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short")], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.lcs) for r in dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()]
    assert got == [(1, 7, 1.0)]


def test_odd_rows(spark, odd_docs, no_docs):
    item = "The quick BROWN fox jumps over the lazy dog, and then it sleeps under the old tree near the river bank"
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, item, "x"), (2, None, "x"), (3, "", "x"), (4, "a b", "x")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id) for r in dc.find_leaks(odd_docs, bench).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1)], key=repr)
    assert dc.find_leaks(no_docs, bench).count() == 0
    assert dc.find_leaks(odd_docs, bench.limit(0)).count() == 0
    assert dc.drop_leaks(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert dc.drop_leaks(odd_docs, bench).count() == odd_docs.count() - 4


def test_passages_cover_every_word():
    for n in (0, 1, 23, 24, 25, 48, 49, 1000):
        text, begin, end = dc._passages(np.array([n, 3]))
        own = [(b, e) for t, b, e in zip(text, begin, end, strict=True) if t == 0]
        assert sorted({x for b, e in own for x in range(b, e)}) == list(range(n))


def test_no_verbatim_item_is_lost_among_thousands(spark):
    rng = random.Random(8)
    # Bare punctuation is no word.
    texts = [[w for w in (r.text or "").split() if any(c.isalnum() for c in w)] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    texts, spans = [w for w in texts if len(w) > 60], []
    for _ in range(3000):
        w = rng.choice(texts)
        n = rng.randint(2, 30)  # short ones among them, which are found word for word
        at = rng.randrange(len(w) - n)
        spans.append(w[at : at + n])
    rows = []
    for i in range(300):
        w = rng.choice(texts)
        at = rng.randrange(len(w))
        rows.append((i, " ".join([*w[:at], *spans[i], *w[at:]])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(spans)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), bench).select("doc_id", "item_id").collect()}
    lost = [i for i in range(300) if (i, i) not in got]
    assert not lost, (len(lost), lost)


def test_candidates_lose_nothing_that_a_search_of_all_places_finds(spark):
    rng = random.Random(9)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and 40 < len(r.text.split()) < 2000]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = []
    for d, t in texts[:60]:
        w = t.split()
        at = rng.randrange(len(w))
        rows.append((d, " ".join([*w[:at], *paraphrase(rng.choice(items)[1].split(), rng), *w[at:]])))

    def hashes(text):
        import pyarrow as pa

        _, _, data, offsets = next(dc.tk.chunks(pa.array([text])))
        return dc._words(data, offsets)[2].tolist()

    want = set()
    for i, b in items:
        words, masks = hashes(b), {}
        for k, h in enumerate(words):
            masks[h] = masks.get(h, 0) | 1 << k
        for d, t in rows:
            if dc.verify(hashes(t), words, masks, dc.LCS, dc.ANSWER):
                want.add((d, i))
    found = dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 40 and len(want - {(r.doc_id, r.item_id) for r in found}) <= 0.02 * len(want)


def test_rows_add_up_by_key_however_frequent():
    rng = np.random.default_rng(6)
    table = rng.normal(size=(50, 3)).astype(np.float32)
    for n in (0, 1, 24, 25, 600, 20_000):
        keys = np.sort(np.where(rng.random(n) < 0.5, 3, rng.integers(0, 400, n)))
        rows = rng.integers(0, 50, n)
        want, got = np.zeros((400, 3)), np.zeros((400, 3), np.float32)
        np.add.at(want, keys, table[rows])
        dc._add_by_key(keys, table, rows, got)
        assert np.allclose(got, want, atol=1e-3 * max(1, abs(want).max()))


def test_no_region_is_refused_that_holds_a_leak(monkeypatch):
    """Regions of few words, repeated ones among them, are held against ``verify`` one by one, under few codes too."""
    rng = random.Random(12)
    mask = (1 << 64) - 1
    vocabulary = [(i + 1) * 0x9E3779B97F4A7C15 & mask for i in range(40)]
    for codes, at_once in ((1 << 13, 1 << 15), (1 << 4, 50)):
        monkeypatch.setattr(dc, "CODES", codes)
        monkeypatch.setattr(dc, "REGION_WORDS", at_once)
        words = [[rng.choice(vocabulary[:n]) for _ in range(rng.randint(8, 30))] for n in (3, 10, 40, 40)]
        items = dc.Items([0, 1, 2, 3], words, np.zeros((4, 1), np.float32), np.arange(4), np.zeros(4, np.int64))
        text = [w for i in range(300) for w in (rng.choice(words)[rng.randrange(4) :] if i % 3 else [rng.choice(vocabulary) for _ in range(9)])]
        lo = np.array([rng.randrange(len(text)) for _ in range(1500)])
        hi, item = np.minimum(lo + [rng.randrange(-1, 70) for _ in lo], len(text)), np.array([rng.randrange(4) for _ in lo])
        kept = items.enough(dc.code_of(np.array(text, np.uint64)), lo, hi, item, dc.LCS)
        leaks = np.array([dc.verify(text[a:b], words[j], items.masks()[j], dc.LCS, dc.ANSWER) is not None for a, b, j in zip(lo.tolist(), hi.tolist(), item.tolist(), strict=True)])
        assert 200 < leaks.sum() and not (leaks & ~kept).any()
        assert codes < 1 << 13 or kept.sum() < 1200


def test_places_with_too_few_of_an_items_words_are_not_verified(monkeypatch):
    """Texts whose vectors are near an item's, for they repeat one word of it, cost no comparison of words; a paraphrase does and is found."""
    item = [f"w{i}" for i in range(20)]
    hashes = lambda text: dc._words(*next(dc.tk.chunks(pa.array([text])))[2:])[2]
    own = hashes(" ".join(item))
    table = np.zeros((dc.TERMS, 2), np.float32)
    table[:, 1] = 1
    table[dc.terms_of(own)] = 1, 0
    items = dc.Items([7], [own.tolist()], np.array([[1, 0]], np.float32), np.zeros(1, np.int64), np.zeros(1, np.int64))
    calls, verify = [], dc.verify
    monkeypatch.setattr(dc, "verify", lambda *a: calls.append(a) or verify(*a))
    texts = [" ".join([f"w{i % 20}"] * 40) for i in range(100)] + [" ".join(w for i, w in enumerate(item) if i % 5)]
    _, _, data, offsets = next(dc.tk.chunks(pa.array(texts)))
    got = dc._leaks(data, offsets, table, [items], dc.COSINE, dc.LCS, dc.ANSWER)
    assert [(t, i, row[0]) for (t, i), row in got.items()] == [(100, 7, 0.8)]
    assert len(calls) <= 2, len(calls)
