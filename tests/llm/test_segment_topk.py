from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewalk.llm import segment_topk as st

SCHEMA = "vec_id long, embedding array<float>, query_id string, score string"


def brute(rows, every, k):
    v = [(i, np.floor(np.array(x, np.float64) * 256).astype(int)) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    out = set()
    for q in {i for i, _ in v if i % every == 0}:
        own = min((x.tolist() for i, x in v if i == q))
        best = sorted((-int(np.dot(own, x)), i) for i, x in v if i != q and len(x) == len(own))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def run(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(i, x, None, "x") for i, x in rows], SCHEMA).repartition(3)
    return {tuple(r) for r in st.exact_topk(df, F.col("vec_id") % every == 0, k).collect()}


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_agrees_with_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.2, (300, 64)).astype(np.float32)
    if kind == "clusters":
        x = x * 0.1 + rng.normal(0, 1, (5, 64))[rng.integers(0, 5, 300)].astype(np.float32)
    if kind == "copies":
        x[50:250] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows) == brute(rows, 5, 5)


@pytest.mark.parametrize("size", [1e6, 1e12, 1e300, "mixed"])
def test_large_components_are_scored_in_whole_numbers(spark, size):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (60, 8)) * (10.0 ** rng.integers(0, 300, (60, 1)) if size == "mixed" else size)
    x[3] = x[4] = [1.7e308, 1.7e308, 0, 0, 0, 0, 0, 0] if size == 1e300 else x[5]
    whole = [[int(Fraction(v) * 256 // 1) for v in row] for row in x.tolist()]
    want = set()
    for q in range(0, 60, 5):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(60) if i != q)[:5]
        want |= {(q, r, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(best, 1)}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in st.exact_topk(df, F.col("vec_id") % 5 == 0).collect()} == want


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(st, "QUERY_BLOCK", 7)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).normal(size=(90, 8)).astype(np.float32))]
    assert run(spark, rows, 3) == brute(rows, 3, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (10, [float("inf"), 0.0]), (6, [2.0, 2.0, 2.0]), (None, [9.0, 9.0]), (1, [1.0, 1.0]), (7, [-0.001, 0.0]), (15, [3.0]), (20, [0.0, 0.0])]
    got = run(spark, rows)
    assert got == {(q, r, i, s) for q, r, i, s in got}
    assert [x for x in sorted(got) if x[0] == 0] == [(0, 1, 1, 196608), (0, 2, 1, 196608), (0, 3, 20, 0), (0, 4, 7, -256)]
    assert not [x for x in got if x[0] in (5, 10, 15)]
    assert run(spark, []) == set()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(40, 64)), rng.normal(size=(60, 64))
    far = ((q[:, None] - c[None]) ** 2).sum(2)
    coarse, fine = (((st.segment_features(q, n)[:, None] - st.segment_features(c, n)[None]) ** 2).sum(2) for n in (4, 16))
    assert (coarse <= far + 1e-9).all() and (fine <= far + 1e-9).all() and (coarse <= fine + 1e-9).all()
