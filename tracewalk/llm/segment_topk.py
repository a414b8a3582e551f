"""Exact top-k by inner product, with bounds from segment means and deviations.

A vector's coordinates are cut into equal segments; of a segment the mean m and the
standard deviation s are kept. For two vectors the squared distance over a segment of
w coordinates is at least w((m - m')**2 + (s - s')**2), so at one resolution

    |q - c|**2 >= LB,   q.c = (|q|**2 + |c|**2 - |q - c|**2) / 2 <= (|q|**2 + |c|**2 - LB) / 2.

Coarse segments come first; what may still beat a query's k-th best so far goes on
to finer ones, and only survivors get exact scores. Nothing is approximate: bounds are
computed with a slack above their rounding, and scores in integers as wide as they need
(in floating point only where every sum stays below 2**53).

Queries are a stated set, taken in blocks of bounded size that each task gets whole;
candidates are read once for each block, and no task gathers more than k rows a query.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Queries of one block: the most that is broadcast at a time.
QUERY_BLOCK = 8192
CANDIDATES = 1024
SLICE = 256


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(width) * (means, deviations): squared distances of these are lower bounds of the vectors' own."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    out = np.empty((len(x), 2 * len(parts)))
    for i, p in enumerate(parts):
        w = np.sqrt(len(p))
        out[:, 2 * i] = x[:, p].mean(1) * w
        out[:, 2 * i + 1] = x[:, p].std(1) * w
    return out


def _clean(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """By dimension: (ids, vectors)."""
    column = batch.column("vector")
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    lengths = np.where(np.array(column.is_valid()), lengths, 0)
    begins = np.cumsum(lengths) - lengths
    by = []
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        by.append((ids[rows], flat[begins[rows][:, None] + np.arange(dim)]))
    return by


def _integers(x: np.ndarray, raw: np.ndarray, scale: float, wide: bool) -> np.ndarray:
    """The whole numbers floor(scale * raw), of which x holds the floating-point form: as 64-bit integers, or as Python's."""
    if not wide:
        return x.astype(np.int64)
    whole = [int(v) if math.isfinite(v) else math.floor(Fraction(r) * Fraction(scale)) for v, r in zip(x.ravel().tolist(), raw.ravel().tolist(), strict=True)]
    return np.array(whole, object).reshape(x.shape)


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def _as_float(x: np.ndarray) -> np.ndarray:
    return np.array([max(min(v, 10**300), -(10**300)) for v in x.tolist()], np.float64) if x.dtype == object else x.astype(np.float64)


def _rank_key(score: int) -> str | None:
    """Orders, as text, scores beyond 64 bits; null for others."""
    if -(1 << 63) < score < (1 << 63) - 1:
        return None
    digits = f"{len(str(abs(score))):06d}{abs(score)}"
    return digits if score > 0 else digits.translate(str.maketrans("0123456789", "9876543210"))


def _search(batches, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, scale: float, levels: tuple[int, ...]):
    state = {}
    with np.errstate(over="ignore", invalid="ignore"):
        for dim, (qid, raw) in queries.items():
            q = np.floor(raw * scale)
            state[dim] = {"q": q, "thr": np.full(len(qid), -np.inf), "found": [[] for _ in qid], "f": [segment_features(q, s) for s in levels], "sq": (q * q).sum(1), "most": np.abs(q).max(1)}
        for batch in batches:
            for ids, raw in _clean(batch):
                if raw.shape[1] in queries:
                    _meet(state[raw.shape[1]], *queries[raw.shape[1]], ids, raw, k, scale, levels)
    for dim, (qid, _) in queries.items():
        n = [len(x) for x in state[dim]["found"]]
        if sum(n):
            scores, ids = zip(*(x for own in state[dim]["found"] for x in own), strict=True)
            held = [max(min(x, (1 << 63) - 1), -(1 << 63)) for x in scores]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(ids, pa.int64()), pa.array(held, pa.int64()), pa.array([_rank_key(x) for x in scores], pa.string())], names=["query_id", "vec_id", "score", "beyond"])


def _meet(s: dict, qid: np.ndarray, raw_q: np.ndarray, ids: np.ndarray, raw: np.ndarray, k: int, scale: float, levels: tuple[int, ...]) -> None:
    """Hold candidates of one dimension to the queries, whose best so far are in the state ``s``."""
    dim = raw.shape[1]
    size = np.abs(np.floor(raw * scale)).max(1)
    order = np.argsort(size, kind="stable")  # large vectors apart, so that few are scored in wide integers
    for lo in range(0, len(order), CANDIDATES):
        pick = order[lo : lo + CANDIDATES]
        c, cid = np.floor(raw[pick] * scale), ids[pick]
        csq = (c * c).sum(1)
        feats = [segment_features(c, n) for n in levels]
        for a in range(0, len(qid), SLICE):
            b = min(a + SLICE, len(qid))
            q, thr = s["q"][a:b], s["thr"][a:b, None]
            half = (s["sq"][a:b, None] + csq[None, :]) / 2
            # Slack for rounding, relative to the size of the terms: a bound never cuts a tie.
            need = thr - 1e-9 * (1 + half)
            alive = np.ones(half.shape, bool)
            sure = np.isfinite(half).all()
            for qf, cf in zip(s["f"], feats, strict=True):
                qf = qf[a:b]
                if not sure:
                    break
                if alive.mean() > 0.05:
                    lb = ((qf * qf).sum(1)[:, None] + (cf * cf).sum(1)[None, :] - 2 * qf @ cf.T) / 2
                    alive &= half - lb >= need
                else:
                    i, j = np.nonzero(alive)
                    lb = ((qf[i] - cf[j]) ** 2).sum(1) / 2
                    alive[i, j] = half[i, j] - lb >= need[i, j]
            alive &= qid[a:b, None] != cid[None, :]
            bound = dim * float(s["most"][a:b].max()) * float(size[pick].max())
            i, j = np.nonzero(alive)
            if bound < 1 << 53:
                exact = (q @ c.T)[i, j] if alive.mean() > 0.05 else np.einsum("ij,ij->i", q[i], c[j])
                exact = exact.astype(np.int64)
            else:
                wide = not bound < 1 << 62
                qi, ci = _integers(q, raw_q[a:b], scale, wide), _integers(c, raw[pick], scale, wide)
                exact = np.concatenate([np.zeros(0, qi.dtype), *((qi[i[x : x + 65536]] * ci[j[x : x + 65536]]).sum(1) for x in range(0, len(i), 65536))])
            near = _as_float(exact) >= thr[i, 0]
            i, j, exact = i[near], j[near], exact[near]
            cuts = np.searchsorted(i, np.arange(b - a + 1))
            for r in np.unique(i).tolist():
                own = slice(cuts[r], cuts[r + 1])
                best = _top(exact[own], cid[j[own]], k)
                best = s["found"][a + r] = _best(s["found"][a + r] + best, k)
                if len(best) == k:
                    s["thr"][a + r] = max(min(best[-1][0], 10**300), -(10**300))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    if scores.dtype != object:
        pick = np.lexsort((ids, -scores))[:k]
        scores, ids = scores[pick], ids[pick]
    return _best(list(zip(scores.tolist(), ids.tolist(), strict=True)), k)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, levels: tuple[int, ...] = (4, 16)) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    ``vectors(vec_id, embedding)``; a component x counts as floor(scale * x). A query's
    own vec_id is no candidate of it. Vectors that are null, empty, or hold a null or non-finite component, and rows
    with a null vec_id, take no part; vectors of different lengths are not compared. Of
    repeated rows with one vec_id, each is a candidate and the query is the first by vector.
    A score beyond 64 bits is ranked as what it is and returned as the nearest 64-bit integer.
    An empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = rows.where(sound)
    asked = materialize(rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK)
    # Blocks by hash, each of about QUERY_BLOCK rows; one block's vectors are all the driver holds.
    found = None
    schema = "query_id long, vec_id long, score long, beyond string"
    for i in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in sorted({len(r.vector) for r in held} - {0}):
            own = [r for r in held if len(r.vector) == dim]
            by[dim] = np.array([r.vec_id for r in own], np.int64), np.array([r.vector for r in own], np.float64)
        part = materialize(rows.mapInArrow(partial(_search, queries=by, k=k, scale=scale, levels=levels), schema), "found")
        found = part if found is None else found.unionByName(part)
    discard(asked)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
