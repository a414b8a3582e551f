import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewalk.llm import textkernel as tk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\n.é中\x00\x7f-", max_size=40)), max_size=12)


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@settings(deadline=None, max_examples=150)
@given(TEXTS, st.integers(1, 60))
def test_words_are_the_regex_words(texts, size):
    for admit, rx in ((tk.NON_SPACE, r"[^\x20\x09-\x0D]+"), (tk.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for first, end, data, offsets in tk.chunks(pa.array(texts, pa.string()), size):
            starts, ends, hashes, n = tk.words(data, offsets, admit)
            got = [data[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]
            assert [lower(w) for w in got] == [w for t in texts[first:end] for w in re.findall(rx, lower(t or ""))]
            assert n.tolist() == [len(re.findall(rx, lower(t or ""))) for t in texts[first:end]]
            for w, h in zip(got, hashes.tolist(), strict=True):
                assert seen.setdefault(lower(w), h) == h
        assert len(set(seen.values())) == len(seen)


@settings(deadline=None, max_examples=100)
@given(TEXTS, st.integers(1, 5))
def test_shingle_sets(texts, k):
    chunks = list(tk.chunks(pa.array(texts, pa.string())))
    if not chunks:
        return
    _, _, data, offsets = chunks[0]
    _, _, hashes, n = tk.words(data, offsets, tk.NON_SPACE)
    found, sizes = tk.shingle_sets(hashes, n, k)
    want = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        want.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    assert sizes.tolist() == [len(x) for x in want]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    own = [set(found[cuts[i] : cuts[i + 1]].tolist()) for i in range(len(want))]
    for i in range(len(want)):
        for j in range(len(want)):
            assert len(own[i] & own[j]) == len(want[i] & want[j])


def test_long_texts_hash_alike_in_any_segment():
    text = " ".join(f"w{i}" for i in range(400_000))
    (_, _, data, offsets) = next(tk.chunks(pa.array([text])))
    _, _, h, n = tk.words(data, offsets, tk.NON_SPACE)
    assert n[0] == 400_000 and len(np.unique(h)) == 400_000
    (_, _, d2, o2) = next(tk.chunks(pa.array(["w399999 w0"])))
    assert tk.words(d2, o2, tk.NON_SPACE)[2].tolist() == [h[-1], h[0]]
