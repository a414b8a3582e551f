"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into overlapping passages. A passage is a TF-IDF vector over hashed words,
projected on the leading right singular vectors of passages and benchmark items, which
a distributed randomised SVD finds: tasks multiply their share of the matrix, and one task
orthogonalises a basis of fixed size. Passages whose cosine with an item is high
are candidates, unless too few words of the place are the item's, and so is every place that shares RUN consecutive words with an item, whatever
its cosine: no verbatim item is lost to the basis. A candidate is a leak when the longest common subsequence of words
holds enough of the item within a stretch of text not much longer than it, and enough
of the item's answer (its last words). Paraphrases that keep word order are caught,
and common vocabulary alone is not.

Document frequencies cover every text, the basis is fitted on every passage and every item that has
vectors, and the search covers every passage; nothing is sampled.
Texts are read twice and never shuffled; the passes of the fit reread their terms, two bytes a word,
from the shared folder. What a task holds besides a chunk of text is the basis
and the items' blocks, which it reads from the shared folder; the driver holds neither.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import discard, materialize, new_path, open_fs, release, trim, write_atomic

TERMS = 1 << 15
HALF = 24  # a passage is two halves; the next one starts a half later
RANK, EXTRA = 96, 12
#: All passages together weigh at most as much as so many in the fit, and all items as so many, so that neither drowns the other in large tables.
FIT_PASSAGES, FIT_ITEMS = 20_000, 5_000
FIT_TASKS = 4
#: Words that a pass of the fit takes at once, and groups of rows that are added up side by side, few enough for a core's cache.
FIT_WORDS, GROUPS = 1 << 16, 1 << 8
#: Items count so much more than passages in the fit, for the basis to span them.
ITEM_WEIGHT = 10.0
COSINE, LCS, ANSWER = 0.6, 0.55, 0.5
#: Items with fewer words are found where all of their words stand consecutively, and only there.
LEAST_WORDS = 8
ITEM_BLOCK = 4096
#: Consecutive words that make a place a candidate by themselves.
RUN = 5
CHUNK = 1 << 18
#: Codes of words by which regions are refused before they are verified; words of regions, and regions, that are looked up at once.
CODES, REGION_WORDS, CANDIDATES = 1 << 13, 1 << 15, 1 << 14


def _words(data: np.ndarray, offsets: np.ndarray):
    return tk.words(tk.fold_latin(data), offsets, tk.ALNUM)


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(49)).astype(np.int32)


def _halves(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each half, halves per text); words are counted over the run of texts."""
    n = -(-per_text // HALF)
    begin = np.cumsum(per_text) - per_text
    first = np.repeat(begin, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * HALF
    return first, n


def _passages(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of every passage; a text of up to two halves is one."""
    first, n = _halves(per_text)
    count = np.maximum(n - 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(per_text)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(per_text) - per_text)[text] + k * HALF
    return text, begin, np.minimum(begin + 2 * HALF, np.cumsum(per_text)[text])


def _pack(batches):
    """Each text as the terms of its words, two bytes each."""
    for batch in batches:
        for first, end, data, offsets in tk.chunks(batch.column("text")):
            _, _, hashes, per_text = _words(data, offsets)
            cuts = np.concatenate([[0], 2 * np.cumsum(per_text)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(cuts), pa.py_buffer(terms_of(hashes).astype(np.uint16))])], names=["terms"])
    trim()


def _runs(batch: pa.RecordBatch):
    """(terms, words per text) of runs of texts of about FIT_WORDS words; a longer text is a run of its own."""
    column, n = batch.column("terms").cast(pa.large_binary()), batch.num_rows
    if not n:
        return
    _, cuts, data = column.buffers()
    cuts = np.frombuffer(cuts, np.int64)[column.offset : column.offset + n + 1]
    terms = np.frombuffer(data, np.uint8)[: cuts[-1]].view(np.uint16) if cuts[-1] else np.zeros(0, np.uint16)
    cuts = cuts // 2
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + FIT_WORDS, "right")) - 1)
        yield terms[cuts[lo] : cuts[hi]].astype(np.int64), np.diff(cuts[lo : hi + 1])
        lo = hi


def _pieces(batch: pa.RecordBatch):
    """The same with long texts cut into pieces that share a half, so that each passage lies in one of them."""
    most = max(2, FIT_WORDS // HALF)
    for terms, per_text in _runs(batch):
        if len(per_text) > 1 or len(terms) <= most * HALF:
            yield terms, per_text
            continue
        for half in range(0, -(-len(terms) // HALF) - 1, most - 1):
            own = terms[half * HALF : (half + most) * HALF]
            yield own, np.array([len(own)])


def _frequencies(batches):
    df, texts, passages = np.zeros(TERMS, np.int64), 0, 0
    for batch in batches:
        for terms, per_text in _runs(batch):
            if len(per_text) > 1:
                terms = np.unique(np.repeat(np.arange(len(per_text)), per_text) * TERMS + terms) % TERMS
                df += np.bincount(terms, minlength=TERMS)
            else:
                df += np.bincount(terms, minlength=TERMS) > 0
            texts += len(per_text)
            passages += len(_passages(per_text)[0])
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"term": pa.array(np.concatenate([at, [-1, -2]]).astype(np.int32)), "n": pa.array(np.concatenate([df[at], [texts, passages]]))})
    trim()


def _tfidf(rows: list[np.ndarray], weight: np.ndarray, idf: np.ndarray):
    """(row, term, value) of unit rows times their weight."""
    own = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    key, tf = np.unique(own * TERMS + (np.concatenate(rows) if rows else np.zeros(0, np.int64)), return_counts=True)
    row, term = key // TERMS, key % TERMS
    value = tf * idf[term]
    norm = np.sqrt(np.bincount(row, value * value, len(rows)))
    return row, term, value / np.maximum(norm, 1e-9)[row] * weight[row]


def _sum_rows(keys: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """out[k] += the rows whose key is k; keys ascend."""
    if len(keys):
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        out[keys[at]] += np.add.reduceat(rows, at, axis=0)


def _group_sums(table: np.ndarray, rows: np.ndarray, begin: np.ndarray, size: np.ndarray):
    """(groups, the sum of each one's rows of the table) in blocks, every group once: group i is rows[begin[i] : begin[i] + size[i]], of one row at least.

    A block adds up a row of each of its groups at a time, whole arrays that stay in a core's cache.
    """
    order = np.argsort(-size, kind="stable")
    buffer = np.empty((GROUPS, table.shape[1]), table.dtype)
    for lo in range(0, len(order), GROUPS):
        own = order[lo : lo + GROUPS]
        at, n = begin[own], size[own]
        total = table[rows[at]]
        more = len(own) - np.searchsorted(n[::-1], np.arange(1, int(n[0])), "right")  # groups that have another row
        for k, m in enumerate(more.tolist(), 1):
            np.take(table, rows[at[:m] + k], axis=0, out=buffer[:m], mode="clip")
            total[:m] += buffer[:m]
        yield own, total


def _half_sums(table: np.ndarray, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each half's rows of the table."""
    out = np.empty((len(first), table.shape[1]), table.dtype)
    for own, total in _group_sums(table, terms, first, np.diff(np.append(first, len(terms)))):
        out[own] = total
    return out


def _add_by_key(keys: np.ndarray, table: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """out[k] += the table's rows that ``rows`` names where the key is k; keys ascend. A frequent key's rows are added up in groups of HALF first."""
    while len(keys):
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(begin, len(keys)))
        few = size <= HALF
        for own, total in _group_sums(table, rows, begin[few], size[few]):
            out[keys[begin[few][own]]] += total
        begin, size = begin[~few], size[~few]
        n = -(-size // HALF)
        part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin, size = np.repeat(begin, n) + part * HALF, np.minimum(np.repeat(size, n) - part * HALF, HALF)
        sums = np.empty((len(begin), table.shape[1]), table.dtype)
        for own, total in _group_sums(table, rows, begin, size):
            sums[own] = total
        keys, table, rows = keys[begin], sums, np.arange(len(begin))


def _load(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as file:
        return file.read()


def _basis(uri: str | None, columns: int, seed: int) -> np.ndarray:
    """A pass's basis: what the pass before has left, or at first a random one."""
    if uri is None:
        return np.random.Generator(np.random.PCG64(seed)).normal(size=(TERMS, columns)).astype(np.float32)
    return np.frombuffer(_load(uri), np.float32).reshape(TERMS, -1)


def _blocks(total: np.ndarray):
    for i in range(0, len(total), 1024):
        yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "part": pa.array([total[i : i + 1024].tobytes()], pa.binary())})


def _normal(batches, uri: str | None, columns: int, seed: int, idf: np.ndarray, last: bool):
    """This task's share of A'A times the basis, in blocks of rows; in the last pass of the basis' transpose times that, which is small."""
    basis = _basis(uri, columns, seed)
    total = np.zeros((columns if last else TERMS, columns), np.float32)
    for batch in batches:
        weight, lists = batch.column("weight").to_numpy(), batch.column("terms")
        for lo in range(0, batch.num_rows, 250):
            rows = [np.asarray(x, np.int64) for x in lists[lo : lo + 250].to_numpy(zero_copy_only=False)]
            row, term, value = _tfidf(rows, weight[lo : lo + 250], idf)
            value = value.astype(np.float32)[:, None]
            y = np.zeros((len(rows), basis.shape[1]), np.float32)
            _sum_rows(row, value * basis[term], y)
            if last:
                total += y.T @ y
                continue
            order = np.argsort(term, kind="stable")
            _sum_rows(term[order], value[order] * y[row[order]], total)
    del basis
    yield from _blocks(total)
    del total
    trim()


def _add_passages(terms: np.ndarray, per_text: np.ndarray, table: np.ndarray, idf: np.ndarray, last: bool, weight: float, total: np.ndarray) -> None:
    first, _ = _halves(per_text)
    _, begin, end = _passages(per_text)
    half, size = np.searchsorted(first, begin), end - begin
    two = np.flatnonzero(size > HALF)
    own = np.repeat(np.arange(len(size), dtype=np.uint32), size)  # fewer than 2 ** 17 passages of fewer words
    word = np.arange(len(own)) - np.repeat(np.cumsum(size) - size - begin, size)
    key, tf = np.unique(own * np.uint32(TERMS) + terms.astype(np.uint32)[word], return_counts=True)
    norm = np.sqrt(np.bincount(key // TERMS, (tf * idf[key % TERMS]) ** 2, len(size)))
    scale = (weight / np.maximum(norm, 1e-9)).astype(np.float32)[:, None]
    sums = _half_sums(table, terms, first)
    y = sums[half]
    y[two] += sums[half[two] + 1]
    y *= scale
    if last:
        total += y.T @ y
        return
    y *= scale
    back = np.zeros_like(sums)
    back[half] = y
    back[half[two] + 1] += y[two]
    order = np.argsort(terms.astype(np.uint16), kind="stable")
    half_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(terms))))
    _add_by_key(terms[order], back, half_of[order], total)


def _normal_passages(batches, uri: str | None, columns: int, seed: int, idf: np.ndarray, last: bool, weight: float):
    """The same for all passages of texts of terms: a half's words are added up once for the two passages that hold it."""
    total = np.zeros((columns if last else TERMS, columns), np.float32)
    table = _basis(uri, columns, seed)
    table = table * idf[:, None].astype(np.float32)
    for batch in batches:
        for terms, per_text in _pieces(batch):
            if len(terms):
                _add_passages(terms, per_text, table, idf, last, weight, total)
    del table
    if not last:
        total *= idf[:, None].astype(np.float32)
    yield from _blocks(total)
    del total
    trim()


def _add_parts(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["part"])
    return pd.DataFrame({"block": frame["block"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})


def _next_basis(batches, uri: str | None, columns: int, seed: int, rank: int, last: bool, to: str):
    """Writes the orthonormal basis of the image, or after the last pass its leading ``rank`` directions (Rayleigh-Ritz)."""
    image = np.zeros((columns if last else TERMS, columns), np.float32)
    for batch in batches:
        for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
            x = np.frombuffer(part, np.float32).reshape(-1, columns)
            image[block : block + len(x)] = x
    if last:
        values, turn = np.linalg.eigh(image.astype(np.float64))
        found = _basis(uri, columns, seed) @ turn[:, np.argsort(-values)[:rank]].astype(np.float32)
    else:
        found = np.linalg.qr(image)[0]
    write_atomic(to, np.ascontiguousarray(found, np.float32).tobytes())
    del image, found
    trim()
    yield pa.RecordBatch.from_pydict({"uri": [to]})


def randomised_svd(rows: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA, passes: int = 2, seed: int = 3, texts: DataFrame | None = None, weight: float = 1.0) -> str:
    """URI of a file of the (TERMS, rank) leading right singular vectors of the TF-IDF rows ``rows(weight, terms)``, as 32-bit floats.

    ``texts(terms)``, packed as ``_pack`` does, add all of their passages as rows of that ``weight``.
    A pass is one job over all rows: TERMS * (rank + extra) numbers from each task, of which there are about as many
    as cores, summed by blocks of rows, come to one task that orthogonalises them; a Rayleigh-Ritz step finishes the last.
    """
    spark, uri, schema = rows.sparkSession, None, "block int, part binary"
    for i in range(passes):
        to = new_path(spark, f"basis-{i}")
        own = {"uri": uri, "columns": rank + extra, "seed": seed, "last": i == passes - 1}
        parts = rows.coalesce(FIT_TASKS).mapInArrow(partial(_normal, idf=idf, **own), schema)
        if texts is not None:
            tasks = max(FIT_TASKS, spark.sparkContext.defaultParallelism)
            parts = parts.unionByName(texts.coalesce(tasks).mapInArrow(partial(_normal_passages, idf=idf, weight=weight, **own), schema))
        parts = parts.groupBy("block").applyInPandas(_add_parts, schema)
        parts.repartition(1).mapInArrow(partial(_next_basis, rank=rank, to=to, **own), "uri string").collect()
        uri = to
    return uri


@dataclass
class Items:
    """One block of benchmark items: latent vectors of their pieces, and their words."""

    ids: list[int]
    words: list[list[int]]
    vectors: np.ndarray  # (pieces, rank)
    item_of: np.ndarray
    place: np.ndarray  # a piece's first word in its item
    #: Short items, by their number of words: (keys in order, ids).
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def masks(self) -> list[dict[int, int]]:
        if not hasattr(self, "_masks"):
            self._masks = []
            for words in self.words:
                own: dict[int, int] = {}
                for i, h in enumerate(words):
                    own[h] = own.get(h, 0) | 1 << i
                self._masks.append(own)
        return self._masks

    def sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.words], np.int64)

    def members(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a bit for each item and code: set where a word of the item has that code; those items and codes in order; the item's words of each)."""
        if not hasattr(self, "_members"):
            sizes = self.sizes()
            code = code_of(np.concatenate([np.zeros(0, np.uint64), *(np.array(x, np.uint64) for x in self.words)]))
            at, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * CODES + code, return_counts=True)
            bits = np.zeros(len(sizes) * CODES // 8, np.uint8)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            self._members = bits, at, n
        return self._members

    def enough(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, share: float) -> np.ndarray:
        """Whether so many words of the regions [lo, hi) have a code of the item's, each no oftener than the item, that ``share`` of the item may stand there.

        An equal word has an equal code, so a region that this refuses ``verify`` would refuse too.
        """
        bits, listed, listed_n = self.members()
        need, out = share * self.sizes()[item], np.zeros(len(lo), bool)
        n = np.maximum(hi - lo, 0)
        cuts = np.concatenate([[0], np.cumsum(n)])
        first = 0
        while first < len(lo):
            stop = max(first + 1, int(np.searchsorted(cuts, cuts[first] + REGION_WORDS, "right")) - 1)
            own, at = slice(first, stop), cuts[first : stop + 1] - cuts[first]
            key = codes[np.repeat(lo[own] - at[:-1], n[own]) + np.arange(int(at[-1]))] + np.repeat(item[own] * CODES, n[own])
            found = bits[key >> 3] >> (key & 7).astype(np.uint8) & 1
            seen = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
            many = seen[at[1:]] - seen[at[:-1]] >= need[own]
            word = np.flatnonzero(found.view(bool) & np.repeat(many, n[own]))
            region = np.searchsorted(at, word, "right") - 1
            pair, times = np.unique(region * len(listed) + np.searchsorted(listed, key[word]), return_counts=True)
            region, place = np.divmod(pair, max(1, len(listed)))
            out[own] = np.bincount(region, np.minimum(times, listed_n[place]), stop - first) >= need[own]
            first = stop
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys in order, item, place in the item, flags by the keys' leading bits) of the items' runs of RUN words."""
        if not hasattr(self, "_runs"):
            words = np.concatenate([np.zeros(0, np.uint64), *(np.array(x, np.uint64) for x in self.words)])
            sizes = np.array([len(x) for x in self.words], np.int64)
            item = np.repeat(np.arange(len(sizes)), sizes)
            key = run_keys(words)
            at = np.flatnonzero(item[: len(key)] == item[len(words) - len(key) :])
            at = at[np.argsort(key[at], kind="stable")]
            flags = np.zeros(1 << 20, bool)
            flags[key[at] >> np.uint64(44)] = True
            self._runs = key[at], item[at], at - (np.cumsum(sizes) - sizes)[item[at]], flags
        return self._runs


def code_of(hashes: np.ndarray) -> np.ndarray:
    """A number below CODES for each word."""
    return (hashes >> np.uint64(64 - CODES.bit_length() + 1)).astype(np.int64)


def run_keys(hashes: np.ndarray, run: int = RUN) -> np.ndarray:
    """A key for each ``run`` consecutive words."""
    n = max(0, len(hashes) - run + 1)
    key = hashes[:n].copy()
    for i in range(1, run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i]
    return key


def _run_hits(key: np.ndarray, text_of: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(word of the run, item, word where the item would begin), once for each item and beginning."""
    keys, item, place, flags = items.runs()
    at = np.flatnonzero(flags[key >> np.uint64(44)])
    at = at[text_of[at] == text_of[at + RUN - 1]]
    lo, hi = (np.searchsorted(keys, key[at], side) for side in ("left", "right"))
    n = hi - lo
    at, entry = np.repeat(at, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    if not len(at):
        return []
    rows = np.stack([text_of[at], item[entry], at - place[entry]], 1)
    once = np.unique(rows, axis=0, return_index=True)[1]
    return list(zip(at[once].tolist(), rows[once, 1].tolist(), rows[once, 2].tolist(), strict=True))


def lcs_length(hits: list[int], size: int) -> int:
    """Length of the longest common subsequence, from the match masks of one side's words (bit-parallel)."""
    full = (1 << size) - 1
    v = full
    for m in hits:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def verify(region: list[int], words: list[int], masks: dict[int, int], lcs: float, answer: float) -> tuple[float, float, int, int] | None:
    """(share of the item, share of its answer, first, end) of the best stretch of the region, or None when it is no leak."""
    size = len(words)
    tail = max(3, size // 4)
    hits = list(map(masks.get, region, repeat(0)))
    need = lcs * size
    best = None
    if not hits or len(hits) - hits.count(0) < need:
        return None
    places = [i for i, m in enumerate(hits) if m]
    stretch = 2 * size
    lo = places[0]
    while True:
        own = [i for i in places if lo <= i < lo + stretch]
        if len(own) >= need:
            n = lcs_length([hits[i] for i in own], size)
            if n >= need and (best is None or n > best[0]):
                cut = size - tail
                ending = [hits[i] >> cut for i in own if hits[i] >> cut]
                share = lcs_length(ending, tail) / tail
                if share >= answer or n >= 0.8 * size:
                    best = n, share, own[0], own[-1] + 1
        lo += max(1, size // 2)
        if lo > places[-1]:
            break
    return (best[0] / size, best[1], best[2], best[3]) if best else None


def _leaks(data, offsets, table: np.ndarray, blocks: list[Items], cosine: float, lcs: float, answer: float) -> dict[tuple[int, int], tuple]:
    """{(text, item id): (share, answer share, cosine, first word, end word)} in a run of texts."""
    _, _, hashes, per_text = _words(data, offsets)
    found: dict[tuple[int, int], tuple] = {}
    if not len(hashes):
        return found
    first, n = _halves(per_text)
    sums = _half_sums(table, terms_of(hashes).astype(np.int64), first)
    text, begin, end = _passages(per_text)
    half = np.searchsorted(first, begin)
    two = end > begin + HALF
    x = sums[half]
    x[two] += sums[half[two] + 1]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    starts = np.cumsum(per_text) - per_text
    text_of, key, codes = np.repeat(np.arange(len(per_text)), per_text), run_keys(hashes), code_of(hashes)

    def look(items: Items, j: int, t: int, lo: int, hi: int, cos: float) -> None:
        lo, hi = max(int(starts[t]), lo), min(int(starts[t] + per_text[t]), hi)
        got = verify(hashes[lo:hi].tolist(), items.words[j], items.masks()[j], lcs, answer)
        if got:
            at = t, items.ids[j]
            row = got[0], got[1], cos, lo + got[2] - int(starts[t]), lo + got[3] - int(starts[t])
            if at not in found or row > found[at]:
                found[at] = row

    for items in blocks:
        for size, (keys, ids) in items.short.items():
            own = run_keys(hashes, size)
            lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            at = np.flatnonzero((hi > lo) & (text_of[: len(own)] == text_of[len(hashes) - len(own) :]))
            for w in at.tolist():
                t = int(text_of[w])
                for e in range(int(lo[w]), int(hi[w])):
                    found.setdefault((t, int(ids[e])), (1.0, 1.0, 0.0, w - int(starts[t]), w - int(starts[t]) + size))
        if not items.ids:
            continue
        close = x @ items.vectors.T
        passage, piece = np.nonzero(close >= cosine)
        for i in range(0, len(passage), CANDIDATES):
            p, q = passage[i : i + CANDIDATES], piece[i : i + CANDIDATES]
            j, t, first_word = items.item_of[q], text[p], begin[p] - items.place[q]
            lo = np.maximum(first_word - HALF, starts[t])
            hi = np.minimum(np.maximum(end[p], first_word + items.sizes()[j]) + HALF, starts[t] + per_text[t])
            own = np.flatnonzero(items.enough(codes, lo, hi, j, lcs))
            for at in zip(*(x[own].tolist() for x in (j, t, lo, hi, close[p, q])), strict=True):
                look(items, *at)
        for at, j, first_word in _run_hits(key, text_of, items):
            size = len(items.words[j])
            own = close[np.searchsorted(begin, at, "right") - 1, slice(*np.searchsorted(items.item_of, [j, j + 1]))]
            # From the item's first word, by which a verbatim item is one stretch, and from as far back as a stretch that holds the run can begin.
            for lo in (first_word, at + RUN - 2 * size):
                look(items, j, int(text_of[at]), lo, at + 2 * size, float(own.max()))
    return found


_MODEL: dict[str, tuple[np.ndarray, list[Items]]] = {}


@dataclass(frozen=True)
class Search:
    """Where the projection and the items' blocks lie, and the thresholds."""

    table: str
    blocks: tuple[str, ...]
    cosine: float
    lcs: float
    answer: float

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple]:
        if not self.blocks:
            return {}
        if self.table not in _MODEL:  # a worker holds one
            _MODEL.clear()
            _MODEL[self.table] = np.frombuffer(_load(self.table), np.float32).reshape(TERMS, -1), [pickle.loads(_load(x)) for x in self.blocks]
        return _leaks(data, offsets, *_MODEL[self.table], self.cosine, self.lcs, self.answer)


def _search(batches, search: Search):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        out = []
        for first, _, data, offsets in tk.chunks(batch.column("text"), CHUNK):
            got = search.leaks(data, offsets)
            out += [(ids[first + t], item, *row) for (t, item), row in sorted(got.items())]
        if out:
            d, i, share, tail, cos, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "item_id": pa.array(i, pa.int64()), "lcs": pa.array(share, pa.float64()), "answer": pa.array(tail, pa.float64()), "cosine": pa.array(cos, pa.float64()), "first_word": pa.array(a, pa.int64()), "end_word": pa.array(b, pa.int64())})
    _MODEL.clear()
    trim()


def _keep(batches, search: Search):
    for batch in batches:
        clean = np.ones(batch.num_rows, bool)
        for first, _, data, offsets in tk.chunks(batch.column("text"), CHUNK):
            for t, _ in search.leaks(data, offsets):
                clean[first + t] = False
        yield batch.filter(pa.array(clean))
    _MODEL.clear()
    trim()


def _item_words(batches):
    for batch in batches:
        for first, end, data, offsets in tk.chunks(batch.column("text")):
            _, _, hashes, per_text = _words(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)), pa.array(tk.as_signed(hashes)))
            yield pa.RecordBatch.from_arrays([batch.column("item_id")[first:end], lists], names=["item_id", "words"])


def _hashes_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.asarray(x, np.int64).view(np.uint64) for x in batch.column("words").to_numpy(zero_copy_only=False)]


def _item_terms(batches, weight: float):
    for batch in batches:
        rows = [terms_of(x).tolist() for x in _hashes_of(batch)]
        yield pa.RecordBatch.from_pydict({"weight": pa.array([weight] * len(rows), pa.float64()), "terms": pa.array(rows, pa.list_(pa.int32()))})


def _write_items(batches, table: str, folder: str):
    """A file for each ITEM_BLOCK items: their words and the latent vectors of their pieces."""
    projection = np.frombuffer(_load(table), np.float32).reshape(TERMS, -1)
    ids, words = [], []
    for batch in batches:
        ids += batch.column("item_id").to_pylist()
        words += _hashes_of(batch)
    for lo in range(0, len(ids), ITEM_BLOCK):
        own = list(zip(ids[lo : lo + ITEM_BLOCK], words[lo : lo + ITEM_BLOCK], strict=True))
        long = [(i, w) for i, w in own if len(w) >= LEAST_WORDS]
        short = {}
        for size in sorted({len(w) for _, w in own if len(w) < LEAST_WORDS}):
            few = sorted((int(run_keys(w, size)[0]), i) for i, w in own if len(w) == size)
            short[size] = np.array([k for k, _ in few], np.uint64), np.array([i for _, i in few], np.int64)
        vectors, item_of, place = [], [], []
        for j, (_, w) in enumerate(long):
            size = len(w)
            for at in [0] if size <= 3 * HALF else range(0, size - HALF, 2 * HALF):
                v = projection[terms_of(w[at : at + 2 * HALF] if size > 3 * HALF else w)].sum(0)
                vectors.append(v / max(np.linalg.norm(v), 1e-9))
                item_of.append(j)
                place.append(at)
        items = Items([i for i, _ in long], [w.tolist() for _, w in long], np.array(vectors, np.float32).reshape(len(vectors), projection.shape[1]), np.array(item_of, np.int64), np.array(place, np.int64), short)
        uri = f"{folder}/{TaskContext.get().partitionId()}-{lo // ITEM_BLOCK}"
        write_atomic(uri, pickle.dumps(items))
        yield pa.RecordBatch.from_pydict({"uri": [uri]})


def _scaled(batches, idf: np.ndarray, basis: str, to: str):
    """The projection: the basis, each term by its weight."""
    for batch in batches:
        if batch.num_rows:
            write_atomic(to, (idf[:, None] * np.frombuffer(_load(basis), np.float32).reshape(TERMS, -1)).astype(np.float32).tobytes())
        yield batch


def _fit(docs: DataFrame, benchmark: DataFrame, cosine: float, lcs: float, answer: float) -> Search:
    """Fits the basis and writes the projection and the items' blocks, ITEM_BLOCK items a file."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    asked = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = materialize(asked.mapInArrow(_item_words, "item_id long, words array<long>").where(F.size("words") > 0), "items")
    n_items = items.count()
    if not n_items:
        return Search("", (), cosine, lcs, answer)

    packed = materialize(texts.mapInArrow(_pack, "terms binary"), "terms")
    counted = packed.mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS rows at most
    df = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist(), strict=True))
    n_texts, n_passages = df.pop(-1, 0), df.pop(-2, 0)
    idf = np.zeros(TERMS)
    idf[list(df)] = list(df.values())
    idf = np.log((n_texts + 1) / (idf + 1)) + 1e-3

    long = items.where(F.size("words") >= LEAST_WORDS)
    rows = long.mapInArrow(partial(_item_terms, weight=ITEM_WEIGHT * min(1.0, FIT_ITEMS / n_items) ** 0.5), "weight double, terms array<int>")
    basis = randomised_svd(rows, idf, texts=packed, weight=min(1.0, FIT_PASSAGES / max(1, n_passages)) ** 0.5)
    discard(packed)
    table, folder = new_path(spark, "projection"), new_path(spark, "item-blocks")
    spark.range(1).repartition(1).mapInArrow(partial(_scaled, idf=idf, basis=basis, to=table), "id long").collect()
    blocks = items.repartition(-(-n_items // ITEM_BLOCK), "item_id").sortWithinPartitions("item_id").mapInArrow(partial(_write_items, table=table, folder=folder), "uri string").collect()
    discard(items)
    release(spark)
    return Search(table, tuple(sorted(r.uri for r in blocks)), cosine, lcs, answer)


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, lcs, answer, cosine, first_word, end_word): each row of ``docs(doc_id, text)`` with each item it leaks, at its best place.

    lcs and answer are shares of the item's words and of its last words that stand, in
    order, in the words [first_word, end_word). Words are runs of ASCII letters and digits
    and of bytes of other characters, A-Z and accented Latin-1 capitals lower-cased. Null and empty texts leak nothing. An item of
    fewer than LEAST_WORDS words is found where all of them stand consecutively, with cosine 0; an item without words or id
    is not searched; an item_id with several texts is searched by each. Repeated rows are each reported. Other columns
    are not read. Empty tables give an empty result.
    """
    search = _fit(docs, benchmark, cosine, lcs, answer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_search, search=search), "doc_id long, item_id long, lcs double, answer double, cosine double, first_word long, end_word long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER) -> DataFrame:
    """The rows of ``docs`` (all columns) in which ``find_leaks`` finds nothing; no join, no shuffle."""
    search = _fit(docs, benchmark, cosine, lcs, answer)
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(partial(_keep, search=search), rows.schema)
