"""License scans: exact base phrases, and short notices with a few errors.

A notice of L characters with at most e errors (insertions, deletions, substitutions)
holds at least one of its e + 1 pieces exactly: the pigeonhole. So exact searches for the
pieces, over texts normalised to words with one space between, locate candidates, and the
``regex`` library's bounded-error matching verifies the neighbourhood of each and reports
span and edits. Base phrases are found by the hashes of consecutive words, all places.

Texts are scanned whole where they are read: no shuffle, and beside some ten bytes for each
byte of the longest text, work space of one slice of words.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

U64 = np.uint64
#: Words that are normalised and searched at a time.
SLICE_WORDS = 150_000

#: Phrases whose words stand consecutively, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices, their labels and the most errors that still count.
NOTICES = (
    ("licensed under the apache license", "apache", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("creative commons zero", "cc0", 2),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "reserved", 2),
    ("without warranty of any kind", "no-warranty", 2),
    ("may not be reproduced without permission", "no-copying", 4),
)


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int

    def seeds(self) -> list[tuple[bytes, int]]:
        """(piece, its place) of errors + 1 pieces of nearly equal length."""
        raw = self.text.encode()
        cuts = [round(i * len(raw) / (self.errors + 1)) for i in range(self.errors + 2)]
        return [(raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]

    @property
    def pattern(self):
        return _pattern(self.text, self.errors)


@lru_cache(maxsize=4096)
def _pattern(text: str, errors: int):
    return regex.compile(rb"(?b)(?:" + regex.escape(text.encode(), special_only=True) + rb"){e<=" + str(errors).encode() + rb"}")


def normalise(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(words with one space before and after each, place of each word)."""
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - lengths
    out = np.full(int(lengths.sum()) + len(lengths) + 1, 0x20, np.uint8)
    total = int(lengths.sum())
    at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at + np.repeat(places, lengths)] = tk.LOWER[data[at + np.repeat(starts, lengths)]]
    return out.tobytes(), places


def fuzzy_spans(raw: bytes, notices: tuple[Notice, ...], begins: list[int] | None = None) -> list[tuple[int, int, str, int, int]]:
    """(start, end, label, edits, notice length) of verified notices, whole words only, in a normalised run of words.

    ``begins`` holds the place of the space before each text of the run. A text is searched on its own: from that
    space to the one after its last word, which is also the next text's.
    """
    begins = begins or [0]
    ends = [*(x + 1 for x in begins[1:]), len(raw)]
    out = []
    for notice in notices:
        places: set[tuple[int, int]] = set()
        for piece, at in notice.seeds():
            i = raw.find(piece)
            while i >= 0:
                t = bisect_right(begins, i) - 1
                if i + len(piece) <= ends[t]:
                    places.add((t, i - at))
                if t and i + len(piece) <= ends[t - 1]:  # the space between two texts
                    places.add((t - 1, i - at))
                i = raw.find(piece, i + 1)
        done, own = -1, -1
        for t, p in sorted(places):
            e = notice.errors
            if t != own:
                done, own = -1, t
            if p < done:
                continue
            lo = max(begins[t], p - e - 1)
            near = raw[lo : min(ends[t], p + len(notice.text) + e + 1)]
            m = notice.pattern.search(near)
            if m:
                edits = sum(m.fuzzy_counts)
                out.append((lo + m.start(), lo + m.end(), notice.label, edits, len(notice.text)))
                done = lo + m.end() - e
    return out


def _fuzzy_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text_of: np.ndarray, notices: tuple[Notice, ...]):
    """(first word, last word, label, edits, notice length), a slice of words at a time with an overlap that no notice exceeds."""
    over = max((len(x.text) + x.errors for x in notices), default=0)
    for lo in range(0, len(starts), SLICE_WORDS):
        s, e = starts[lo : lo + SLICE_WORDS + over], ends[lo : lo + SLICE_WORDS + over]
        raw, places = normalise(data, s, e)
        own = text_of[lo : lo + len(s)]
        begins = places[np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])] - 1
        for i, j, label, edits, length in fuzzy_spans(raw, notices, begins.tolist()):
            # A separating space that the bounded match took along belongs to no word.
            w = int(np.searchsorted(places, i + (raw[i : i + 1] == b" "), "right")) - 1
            z = int(np.searchsorted(places, j - 1, "right")) - 1
            if 0 <= w < SLICE_WORDS:
                yield lo + w, lo + max(w, z), label, edits, length


def _scan(batches, notices: tuple[Notice, ...], base: tuple[tuple[str, str], ...], span_column: bool):
    wanted = []
    for phrase, label in base:
        raw = phrase.encode()
        arr = np.frombuffer(raw, np.uint8)
        _, _, h, _ = tk.words(arr, np.array([0, len(arr)]), tk.ALNUM)
        wanted.append((h, label))
    labels = sorted({x for _, x in wanted} | {n.label for n in notices})
    for batch in batches:
        cols: dict[str, list] = {x: [] for x in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for first, end, data, offsets in tk.chunks(batch.column("text")):
            n = end - first
            starts, ends, hashes, per_text = tk.words(data, offsets, tk.ALNUM)
            text_of = np.repeat(np.arange(n), per_text)
            begin = np.cumsum(per_text) - per_text
            n_base = np.zeros(n, np.int64)
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base_of: list[set[str]] = [set() for _ in range(n)]
            all_of: list[set[str]] = [set() for _ in range(n)]
            best = np.zeros(n)
            spans: list[list[str]] = [[] for _ in range(n)]
            for h, label in wanted:
                k = len(h)
                if len(hashes) < k:
                    continue
                hit = hashes[: len(hashes) - k + 1] == h[0]
                for i in range(1, k):
                    hit &= hashes[i : len(hashes) - k + 1 + i] == h[i]
                at = np.flatnonzero(hit)
                at = at[text_of[at] == text_of[at + k - 1]]
                who, word = text_of[at], at - begin[text_of[at]]
                np.add.at(n_base, who, 1)
                np.minimum.at(low, who, word)
                np.maximum.at(high, who, word)
                for i in np.unique(who).tolist():
                    base_of[i].add(label)
                    all_of[i].add(label)
                    best[i] = 1.0
                if span_column:
                    for i, w in zip(who.tolist(), word.tolist(), strict=True):
                        spans[i].append(f"{w}:{w + k}:{label}:0")
            for w, z, label, edits, length in _fuzzy_words(data, starts, ends, text_of, notices):
                i = int(text_of[w])
                all_of[i].add(label)
                best[i] = max(best[i], 1 - edits / length)
                if span_column:
                    spans[i].append(f"{w - int(begin[i])}:{z + 1 - int(begin[i])}:{label}:{edits}")
            cols["n_words"] += per_text.tolist()
            cols["n_base"] += n_base.tolist()
            cols["first_word"] += [x if c else None for x, c in zip(low.tolist(), n_base.tolist(), strict=True)]
            cols["last_word"] += [x if c else None for x, c in zip(high.tolist(), n_base.tolist(), strict=True)]
            cols["base_labels"] += [",".join(sorted(x)) for x in base_of]
            cols["labels"] += [",".join(x for x in labels if x in s) for s in all_of]
            cols["score"] += best.tolist()
            cols["spans"] += [",".join(x) for x in spans]
        types = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string(), "spans": pa.string()}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, types.get(k, pa.int64())) for k, v in cols.items())], names=["doc_id", *cols])


def scan_licenses(docs: DataFrame, notices=NOTICES, base=BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of ``docs(doc_id, text)``.

    Words are runs of ASCII letters and digits and of bytes of other characters, A-Z
    lower-cased. spans lists first word, end word, label and edits of every place, base
    phrases first. score is 1 for a base phrase, else the best share of a notice's
    characters that stand unedited, else 0. Null and empty texts have no words and empty labels;
    repeated rows and null ids keep their rows; other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = tuple(Notice(*x) for x in notices)
    return rows.mapInArrow(partial(_scan, notices=made, base=tuple(base), span_column=True), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
