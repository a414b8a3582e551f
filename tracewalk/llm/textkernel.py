"""Columnar text kernels in numpy: words, 64-bit word hashes and shingles of whole Arrow batches.

A batch of texts is one byte buffer with offsets. Words are runs of bytes that a
256-entry table admits, so every step is a vector operation and no Python object
is made per word. Hashes are polynomial prefix hashes modulo 2**64 over random
byte codes, finished by a mixer; two different words agree with probability about
2**-64. Work space is bounded by ``SEGMENT`` bytes whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: dict[str, np.ndarray] = {}


def _table(admit) -> np.ndarray:
    return np.array([bool(admit(b)) for b in range(256)])


#: Word bytes: anything but space and TAB..CR.
NON_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions below n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SEGMENT + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.ones(size, np.uint64)
            filled, step = 1, base
            while filled < size:  # doubling: p[filled:2*filled] = p[:filled] * base**filled
                take = min(filled, size - filled)
                p[filled : filled + take] = p[:take] * U64(step)
                filled += take
                step = step * step % (1 << 64)
            _POWERS[name] = p
    return _POWERS["up"], _POWERS["down"]


def chunks(texts: pa.Array | pa.ChunkedArray, max_bytes: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``max_bytes``; a longer text is a run of its own. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        end = min(max(end, first + 1), n)
        lo, hi = offsets[first], offsets[end]
        yield first, end, raw[lo:hi], offsets[first : end + 1] - lo
        first = end


def _runs(data: np.ndarray, offsets: np.ndarray, admit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of admitted bytes; a run never crosses from one text to the next."""
    inside = admit[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the byte spans [start, end), of which none may lie across a multiple cut of ``segments``."""
    codes = _CODES[LOWER] if lower else _CODES
    out = np.empty(len(starts), np.uint64)
    k, n = 0, len(starts)
    while k < n:
        base = int(starts[k])
        stop = int(np.searchsorted(ends, base + SEGMENT, "right"))
        stop = max(stop, k + 1)
        hi = int(ends[stop - 1])
        up, down = _powers(hi - base + 1)
        prefix = np.empty(hi - base + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(codes[data[base:hi]] * up[: hi - base], out=prefix[1:])
        s, e = starts[k:stop] - base, ends[k:stop] - base
        out[k:stop] = (prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
        k = stop
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, admit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, words per text) of a run of texts; A-Z count as lower case."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts, ends = _runs(data, offsets, admit)
    per_text = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, span_hashes(data, starts, ends), per_text


def shingle_sets(hashes: np.ndarray, per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes ascending within each text, distinct shingles per text).

    A text with fewer than k words, but some, has one shingle of all its words; one without words has none.
    """
    n_texts = len(per_text)
    ends = np.cumsum(per_text)
    begins = ends - per_text
    n = len(hashes)
    whole = per_text >= k
    text_of = np.repeat(np.arange(n_texts), np.where(whole, per_text - k + 1, 0))
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            rolled = mix(rolled + hashes[i : n - k + 1 + i] * U64(2 * i + 3))
        within = np.arange(len(text_of)) - np.repeat(np.cumsum(np.where(whole, per_text - k + 1, 0)) - np.where(whole, per_text - k + 1, 0), np.where(whole, per_text - k + 1, 0))
        found = rolled[begins[text_of] + within]
    else:
        found = np.zeros(0, np.uint64)
    short = np.flatnonzero((per_text > 0) & ~whole)
    if len(short):
        own = np.full(len(short), U64(0xA5A5A5A5))
        for i in range(k - 1):
            has = per_text[short] > i
            own[has] = mix(own[has] + hashes[begins[short[has]] + i] * U64(2 * i + 3) + U64(i))
        found, text_of = np.concatenate([found, own]), np.concatenate([text_of, short])
    order = np.lexsort((found, text_of))
    found, text_of = found[order], text_of[order]
    if len(found):
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:] != found[:-1]) | (text_of[1:] != text_of[:-1])
        found, text_of = found[fresh], text_of[fresh]
    return found, np.bincount(text_of, minlength=n_texts)


def fold_latin(data: np.ndarray) -> np.ndarray:
    """A copy in which the accented capitals of Latin-1 (two bytes, the first 0xC3) are small; with ``words`` this folds case in Western languages."""
    out = data.copy()
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
