import numpy as np

from tracewalk.llm import weak_labels as wl


def test_em_finds_good_and_bad_labellers():
    rng = np.random.default_rng(1)
    k = len(wl.LABELLERS)
    miss, catch = np.linspace(0.002, 0.1, k), np.linspace(0.45, 0.1, k)
    counts, truth = {}, {}
    for _ in range(20_000):
        good = rng.random() < 0.85
        p = "".join("-" if rng.random() < 0.2 else "b" if rng.random() < (miss[j] if good else catch[j]) else "g" for j in range(k))
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(good)
    m = wl.fit_labels(counts)
    assert abs(m.prior - 0.85) < 0.08
    post = np.array([m.posterior(p) for p in counts])
    share = np.array([np.mean(truth[p]) for p in counts])
    n = np.array([counts[p] for p in counts])
    assert np.average(np.abs(post - share), weights=n) < 0.12
    assert m.posterior("b" * k) < 0.01 < 0.9 < m.posterior("g" * k)


def test_quality_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in wl.classify_quality(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in rows]
    good, bad = [r.keep for r, q in labels if q == 1], [r.keep for r, q in labels if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def test_odd_rows(odd_docs, no_docs):
    rows = wl.classify_quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].score == by[1][1].score == by[2][0].score
    assert not any(r.keep for d in (3, 4, 8) for r in by[d])
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and len(r.votes) == len(wl.LABELLERS) for r in rows)
    assert wl.classify_quality(no_docs).count() == 0


def test_without_training_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.keep for r in wl.classify_quality(df).collect()] == [False, False]
