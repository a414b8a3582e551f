"""Language identification by a byte convolutional network, in numpy.

Text is cut into windows of a fixed number of bytes (A-Z lower-cased, the last padded
with zeros). Filters of several widths run over a window's bytes; each filter's largest
response in the window, rectified, is a feature, and softmax over a linear layer gives
the window's language. A filter of width w over one-hot bytes is w tables of 256 rows,
so a response is a sum of w table rows: no embedding is multiplied, and at inference
two adjacent bytes share one row of a table of pairs.

A text's probabilities are the mean over all its windows, weighted by their letters.
The network is trained in one task from a bounded sample of labelled windows and is
a few hundred KB; texts are labelled on the executors, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import discard, materialize, trim

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: The bound of the training sample: texts of each language and of all, and windows of each text.
TEXTS_PER_LANGUAGE = 600
TEXTS_OF_ALL = 60_000
WINDOWS_PER_TEXT = 4
BATCH_WINDOWS = 192
#: One in so many sampled texts is held back, to see how low the scores of texts of a known language come.
HELD_BACK = 10
LETTER = regex.compile(r"\p{L}")
_LETTER_BYTE = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0 for b in range(256)])
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # by width: (width, 256, filters)
    bias: np.ndarray
    out: np.ndarray  # (features, languages)
    out_bias: np.ndarray
    least: float = 0.0  # texts that score less are of no known language

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows for the first two bytes of every filter, the third of width 3, and the last two of width 4."""
        if not hasattr(self, "_pairs"):
            two, three, four = self.tables
            both = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            self._pairs = np.concatenate([both(two[0], two[1]), both(three[0], three[1]), both(four[0], four[1])], 1).astype(np.float32), three[2].astype(np.float32), both(four[2], four[3]).astype(np.float32)
        return self._pairs

    def features(self, windows: np.ndarray) -> np.ndarray:
        """Largest rectified responses of each window, by table pairs."""
        head, third, tail = self.pairs()
        f = FILTERS
        out = np.empty((len(windows), 3 * f), np.float32)
        for lo in range(0, len(windows), BATCH_WINDOWS):
            w = windows[lo : lo + BATCH_WINDOWS].astype(np.int32)
            pair = w[:, :-1] * 256 + w[:, 1:]
            first = head[pair]
            part = out[lo : lo + len(w)]
            part[:, :f] = first[:, :, :f].max(1)
            part[:, f : 2 * f] = (first[:, :-1, f : 2 * f] + third[w[:, 2:]]).max(1)
            part[:, 2 * f :] = (first[:, :-2, 2 * f :] + tail[pair[:, 2:]]).max(1)
        return np.maximum(out + self.bias.astype(np.float32), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.features(windows) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, windows per text): all bytes of every text, each text's last window padded with zeros."""
    lengths = np.diff(offsets)
    n = -(-lengths // WINDOW)
    out = np.zeros((int(n.sum()), WINDOW), np.uint8)
    if len(data):
        first = np.cumsum(n) - n
        place = np.arange(len(data)) - np.repeat(offsets[:-1] - first * WINDOW, lengths)
        out.reshape(-1)[place] = tk.LOWER[data]
    return out, n


def _sample(batches):
    """Evenly spaced windows of each text: (doc_id, lang, window)."""
    for batch in batches:
        ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        for first, end, data, offsets in tk.chunks(batch.column("text")):
            found, n = windows_of(data, offsets)
            at = np.cumsum(n) - n
            rows = []
            for i in range(end - first):
                take = np.unique(np.linspace(0, n[i] - 1, min(int(n[i]), WINDOWS_PER_TEXT)).astype(int)) if n[i] else []
                rows += [(ids[first + i], langs[first + i], found[at[i] + k].tobytes()) for k in take]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "lang": pa.array(b, pa.string()), "window": pa.array(c, pa.binary())})


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, seed: int = 7, rate: float = 0.02) -> Model:
    """Adam on the softmax loss; gradients of a filter reach only the bytes of its largest response."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c, f = len(languages), FILTERS
    tables = [rng.normal(0, 0.3, (w, 256, f)) for w in WIDTHS]
    for t in tables:
        t[:, 0, :] = 0  # padding says nothing
    bias, out, out_bias = np.zeros(len(WIDTHS) * f), rng.normal(0, 0.2, (len(WIDTHS) * f, c)), np.zeros(c)
    params = [*tables, bias, out, out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            x, y = windows[pick].astype(np.int64), labels[pick]
            best, feats = [], []
            for t in tables:
                w = len(t)
                r = sum(t[k][x[:, k : WINDOW - w + 1 + k]] for k in range(w))
                at = r.argmax(1)
                best.append(at)
                feats.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            raw = np.concatenate(feats, 1) + bias
            h = np.maximum(raw, 0)
            z = h @ out + out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y] -= 1
            p /= len(pick)
            back = (p @ out.T) * (raw > 0)
            grads = []
            for k, t in enumerate(tables):
                g, own = np.zeros_like(t), back[:, k * f : (k + 1) * f]
                for q in range(len(t)):
                    byte = np.take_along_axis(x, best[k] + q, 1)
                    np.add.at(g[q], (byte, np.arange(f)[None, :]), own)
                g[:, 0, :] = 0
                grads.append(g)
            grads += [back.sum(0), h.T @ p, p.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, tables, bias, out, out_bias)


def _train(batches, epochs: int):
    """The pickled model of the sample's windows, which come in order."""
    table = pa.Table.from_batches(list(batches))
    held = table.to_pydict() if table.num_rows else {"doc_id": [], "lang": [], "window": []}
    languages = sorted(set(held["lang"]))
    if not languages:
        return
    at = {x: i for i, x in enumerate(languages)}
    x = np.frombuffer(b"".join(held["window"]), np.uint8).reshape(-1, WINDOW)
    y = np.array([at[v] for v in held["lang"]])
    text = np.unique(np.stack([np.array([d or 0 for d in held["doc_id"]], np.int64), y], 1), axis=0, return_inverse=True)[1].ravel()
    keep = _LETTER_BYTE[x].any(1)
    if keep.any():
        x, y, text = x[keep], y[keep], text[keep]
    back = tk.mix(text.astype(np.uint64)) % np.uint64(HELD_BACK) == 0
    if back.all() or len(set(y[~back].tolist())) < len(languages):
        back[:] = False
    model = train(x[~back], y[~back], languages, epochs)
    n = len(languages)
    if back.any() and n > 1:
        p = model.probabilities(x[back])
        weight = _LETTER_BYTE[x[back]].sum(1) + 1e-3
        _, own = np.unique(text[back], return_inverse=True)
        mean = np.stack([np.bincount(own, p[:, c] * weight) for c in range(n)], 1) / np.bincount(own, weight)[:, None]
        right = mean.argmax(1) == y[back][np.unique(own, return_index=True)[1]]
        if right.any():
            # A third of the way from chance to the lowest score seen: clean texts in two languages stay.
            model.least = float(1 / n + (mean.max(1)[right].min() - 1 / n) / 3)
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def fit(docs: DataFrame, use: Column, epochs: int = 6) -> Model:
    """Train on ``docs(doc_id, text, lang)`` rows where ``use`` holds and text and lang are not null.

    The sample is bounded: about TEXTS_PER_LANGUAGE texts of each language (fewer where that were more
    than TEXTS_OF_ALL together), picked by a hash of their id at a rate that the language's own count sets, and
    WINDOWS_PER_TEXT windows of each. A language none of whose texts is drawn is not learned.
    Without any labelled text the model has no language, and predicts none.
    """
    rows = docs.where(use & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n = counts.count()
    rate = counts.select("lang", (F.lit(float(min(TEXTS_PER_LANGUAGE, TEXTS_OF_ALL // max(1, n)))) / F.col("n")).alias("rate"))
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(20240229)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = rows.join(F.broadcast(rate) if n <= 100_000 else rate, "lang").where(drawn < F.col("rate")).select("doc_id", "lang", "text")
    windows = rows.mapInArrow(_sample, "doc_id long, lang string, window binary")
    made = windows.repartition(1).sortWithinPartitions("doc_id", "lang", "window").mapInArrow(partial(_train, epochs=epochs), "model binary").collect()
    discard(counts)
    if not made:
        return Model([], [np.zeros((w, 256, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), np.zeros((len(WIDTHS) * FILTERS, 0)), np.zeros(0))
    return pickle.loads(made[0].model)


def _labels(column: pa.Array, model: Model) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    names, scores = [], []
    for first, end, data, offsets in tk.chunks(column, 1 << 19):
        found, n = windows_of(data, offsets)
        if len(found) and model.languages:
            p = model.probabilities(found)
            weight = _LETTER_BYTE[found].sum(1) + 1e-3
            total = np.concatenate([[[0.0] * p.shape[1]], np.cumsum(p * weight[:, None], 0)])
            ends = np.cumsum(n)
            sums = total[ends] - total[ends - n]
        else:
            sums = np.zeros((end - first, max(1, len(model.languages))))
        raw = data.tobytes()
        for i in range(end - first):
            own = raw[offsets[i] : offsets[i + 1]]
            if not model.languages or not own or not LETTER.search(own.decode()):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                k = int(sums[i].argmax())
                names.append(model.languages[k])
                scores.append(float(min(1.0, sums[i, k] / sums[i].sum())))
    return names, scores


def _predict(batches, model: Model):
    for batch in batches:
        names, scores = _labels(batch.column("text"), model)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
    trim()


def _keep(batches, model: Model, least: float):
    for batch in batches:
        names, scores = _labels(batch.column("text"), model)
        yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(names, scores, strict=True)], pa.bool_()))
    trim()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).

    Null texts and texts without a letter (Unicode's category L) are ``und`` with score 0; any other is the
    learned language with the highest mean probability, ties to the first by name. Only
    the text is looked at; other columns pass through, except that lang_pred and score replace columns of those names. Empty tables stay empty.
    """
    rows = docs.drop("lang_pred", "score")
    rows = rows.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double"
    return rows.mapInArrow(partial(_predict, model=model), schema)


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a letter and scores no nearer to chance than the model's ``least``, which its held-back texts set."""
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(partial(_keep, model=model, least=model.least), rows.schema)
