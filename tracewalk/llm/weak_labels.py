"""A quality classifier without gold labels.

Overlapping heuristics vote good, bad or nothing on each text. How often each is right
comes from expectation-maximisation over the counts of vote patterns: there are at most
3**labellers of them whatever the corpus, and they are counted over every text, so the
estimate is that of all data. The posterior of a pattern is a soft label, and a linear
scorer over hashed words learns it from a bounded sample, so that it also speaks where the heuristics are silent.

Both passes read texts whole, where they are, and shuffle nothing but pattern counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import materialize

BUCKETS = 1 << 16
#: The bound of the scorer's training sample, in texts.
TRAIN_TEXTS = 6000
GOOD, BAD, SILENT = "g", "b", "-"

_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_MARK = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)])
_STOP = np.array([b in b".!?" for b in range(256)])

#: (statistic, bad below, good from, good up to, bad above, least words); between good and bad, silence.
LABELLERS = (
    ("marks", -1.0, -1.0, 0.08, 0.15, 1),  # marks among visible bytes
    ("shouting", -1.0, -1.0, 0.15, 0.5, 5),  # capitals among letters
    ("distinct", 0.2, 0.35, 2.0, 2.0, 40),  # distinct words among words
    ("repeated", -1.0, -1.0, 0.1, 0.3, 40),  # three-word runs that stood before
    ("length", 1.0, 20.0, 1e12, 1e12, 0),  # words: few are no fault, none is
    ("word_length", 2.0, 3.0, 10.0, 16.0, 5),  # mean bytes of a word
    ("cluttered", -1.0, -1.0, 0.05, 0.3, 5),  # words that end in two marks or more
    ("digits", -1.0, -1.0, 0.1, 0.3, 1),  # digits among visible bytes
    ("sentences", 0.004, 0.01, 0.34, 0.6, 40),  # sentence ends a word
)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(statistics of each text, word hashes, words per text)."""
    n = len(offsets) - 1
    starts, ends, hashes, words = tk.words(data, offsets, tk.NON_SPACE)
    seen = _sums(tk.NON_SPACE[data], offsets)
    letters = _sums(_LETTER[data], offsets)
    text_of = np.repeat(np.arange(n), words)
    order = np.lexsort((hashes, text_of))
    h, t = hashes[order], text_of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[fresh], minlength=n)
    runs = np.maximum(words - 2, 0)
    _, kinds = tk.shingle_sets(hashes, words, 3)
    tail = np.zeros(len(starts), bool)
    long = ends - starts >= 2
    tail[long] = _MARK[data[ends[long] - 1]] & _MARK[data[ends[long] - 2]]
    per = lambda a, b: a / np.maximum(b, 1)
    return {
        "marks": per(_sums(_MARK[data], offsets), seen),
        "shouting": per(_sums(_UPPER[data], offsets), letters),
        "distinct": per(distinct, words),
        "repeated": np.where(runs > 0, 1 - per(kinds, runs), 0.0),
        "length": words.astype(float),
        "word_length": per(seen, words),
        "cluttered": per(np.bincount(text_of, weights=tail, minlength=n), words),
        "digits": per(_sums(_DIGIT[data], offsets), seen),
        "sentences": per(_sums(_STOP[data], offsets), words),
    }, hashes, words


def votes(stats: dict[str, np.ndarray]) -> list[str]:
    """A string of one vote for each labeller, for each text."""
    out = []
    for name, bad_below, good_from, good_to, bad_above, least in LABELLERS:
        x = stats[name]
        v = np.where((x < bad_below) | (x > bad_above), BAD, np.where((x >= good_from) & (x <= good_to), GOOD, SILENT))
        out.append(np.where(stats["length"] >= least, v, SILENT))
    return ["".join(x) for x in zip(*(v.tolist() for v in out), strict=True)]


@dataclass
class LabelModel:
    """P(good), and for each labeller P(says good | good) and P(says bad | bad) when it votes."""

    prior: float
    right: np.ndarray  # (labellers, 2)

    def posterior(self, pattern: str) -> float:
        a, b = np.log(self.prior), np.log(1 - self.prior)
        for (g, d), v in zip(self.right, pattern, strict=True):
            if v == GOOD:
                a, b = a + np.log(g), b + np.log(1 - d)
            elif v == BAD:
                a, b = a + np.log(1 - g), b + np.log(d)
        return float(1 / (1 + np.exp(np.clip(b - a, -700, 700))))


def fit_labels(counts: dict[str, int], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over pattern counts, from fixed accuracies; a labeller rarely calls good text bad (at most half, at least 0.002 of it), and sees at
    most half of bad text, since each looks for one kind of badness: so silence of the others never outvotes two alarms.
    One that is no better than chance is held to tell nothing."""
    model = LabelModel(0.8, np.tile([0.95, 0.4], (len(LABELLERS), 1)))
    if not counts:
        return model
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    good = np.array([[v == GOOD for v in p] for p in patterns])
    bad = np.array([[v == BAD for v in p] for p in patterns])
    for _ in range(rounds):
        q = np.array([model.posterior(p) for p in patterns])
        w, u = n * q, n * (1 - q)
        right_g = (w @ good + 4) / (w @ (good | bad) + 5)
        right_b = (u @ bad + 4) / (u @ (good | bad) + 5)
        right = np.stack([np.clip(right_g, 0.5, 0.998), np.clip(right_b, 0.05, 0.5)], 1)
        chance = right.sum(1) < 1.02
        right[chance, 1] = np.clip(1.0 - right[chance, 0], 0.01, 0.95)
        model = LabelModel(float(np.clip((w.sum() + 4) / (n.sum() + 5), 0.05, 0.99)), right)
    return model


def _features(data: np.ndarray, offsets: np.ndarray, stats, hashes, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, weight, features per text): hashed words, and shapes of the words' endings, of unit length."""
    n = len(words)
    text_of = np.repeat(np.arange(n), words)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % (BUCKETS - 4096)
    parts, own = [bucket], [text_of]
    for k, name in enumerate(sorted(stats)):  # a bin of each statistic is a word too
        x = np.clip(np.log2(np.maximum(stats[name], 2.0**-10)) + 10, 0, 60).astype(np.int64)
        parts.append(BUCKETS - 4096 + k * 64 + x)
        own.append(np.arange(n))
    key = np.concatenate(own) * BUCKETS + np.concatenate(parts)
    distinct, tf = np.unique(key, return_counts=True)
    text, bucket = distinct // BUCKETS, distinct % BUCKETS
    weight = 1 + np.log(tf)
    plain = bucket < BUCKETS - 4096
    norm = np.sqrt(np.bincount(text[plain], weights=weight[plain] ** 2, minlength=n))
    weight = np.where(plain, weight / np.maximum(norm[text], 1e-9), 0.5)
    return bucket, weight, np.bincount(text, minlength=n)


def _vote(batches, keep_features: bool):
    for batch in batches:
        for first, end, data, offsets in tk.chunks(batch.column("text")):
            stats, hashes, words = statistics(data, offsets)
            columns = [batch.column("doc_id")[first:end], pa.array(votes(stats))]
            if not keep_features:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "votes"])
                continue
            bucket, weight, n = _features(data, offsets, stats, hashes, words)
            cuts = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(cuts, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(weight.astype(np.float32)))], names=["doc_id", "votes", "buckets", "weights"])


def train_scorer(buckets: list, weights: list, target: np.ndarray, epochs: int = 12, seed: int = 5, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression on soft labels, by AdaGrad over batches; the last weight is the bias."""
    w, g2 = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-2)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            sizes = [len(buckets[i]) for i in pick]
            cols, vals = np.concatenate([buckets[i] for i in pick]), np.concatenate([weights[i] for i in pick])
            row = np.repeat(np.arange(len(pick)), sizes)
            z = np.bincount(row, weights=w[cols] * vals, minlength=len(pick)) + w[-1]
            d = 1 / (1 + np.exp(-z)) - target[pick]
            at, inv = np.unique(cols, return_inverse=True)
            grad = np.bincount(inv, weights=d[row] * vals) / len(pick) + decay * w[at]
            g2[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(g2[at])
            bias = d.mean()
            g2[-1] += bias * bias
            w[-1] -= rate * bias / np.sqrt(g2[-1])
    return w


def _score(batches, model: LabelModel, w: np.ndarray, threshold: float):
    known: dict[str, float] = {}
    for batch in batches:
        for first, end, data, offsets in tk.chunks(batch.column("text")):
            n = end - first
            stats, hashes, words = statistics(data, offsets)
            said = votes(stats)
            post = []
            for p in said:
                if p not in known:
                    known[p] = model.posterior(p)
                post.append(known[p])
            bucket, weight, count = _features(data, offsets, stats, hashes, words)
            z = np.bincount(np.repeat(np.arange(n), count), weights=w[bucket] * weight, minlength=n) + w[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            keep = (score >= threshold) & (words > 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], pa.array(said), pa.array(np.round(post, 6)), pa.array(np.round(score, 6)), pa.array(keep)], names=["doc_id", "votes", "posterior", "score", "keep"])


def classify_quality(docs: DataFrame, threshold: float = 0.5, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) of every row of ``docs(doc_id, text)``.

    votes has one letter for each labeller. score is the scorer's probability of good, and
    keep is score >= threshold. The scorer learns from about ``train_texts`` texts, picked by a hash
    of the text at a rate that the count sets; all else covers every text. Null and empty texts, and texts without
    words, are not kept. Repeated rows score alike; a null id keeps its row; other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = {r.votes: r.n for r in rows.mapInArrow(partial(_vote, keep_features=False), "doc_id long, votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit_labels(counts)
    total = sum(counts.values())
    share = min(1.0, train_texts / max(1, total))
    drawn = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    held = materialize(rows.where((drawn < share) & F.col("text").isNotNull()).dropDuplicates(["text"]).mapInArrow(partial(_vote, keep_features=True), "doc_id long, votes string, buckets array<int>, weights array<float>"), "training").orderBy("doc_id", "votes").toPandas()
    target = np.array([model.posterior(p) for p in held["votes"]])
    if len(target):
        w = train_scorer([np.asarray(x) for x in held["buckets"]], [np.asarray(x, np.float64) for x in held["weights"]], target)
    else:
        w = np.zeros(BUCKETS + 1)
    return rows.mapInArrow(partial(_score, model=model, w=w, threshold=threshold), "doc_id long, votes string, posterior double, score double, keep boolean")
