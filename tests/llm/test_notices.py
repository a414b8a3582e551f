import random
import re

import regex

from llmdata import SF
from tracewalk.llm import notices as nt

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_base(t):
    w, found = words(t), []
    for phrase, label in nt.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    return [r for r in sorted(nt.scan_licenses(df).collect(), key=lambda r: r.doc_id)]


def check_base(rows, texts):
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base) and (r.score > 0) == bool(r.labels)


def test_base_places_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = nt.scan_licenses(docs).collect()
    assert len(rows) == len(texts)
    check_base(rows, texts)


def test_fuzzy_matches_agree_with_brute_force(spark):
    """The library over each whole normalised text, without seeds."""
    rng, texts = random.Random(3), []
    for _ in range(300):
        phrase = list(rng.choice(nt.NOTICES)[0])
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(phrase))
            rng.choice([lambda i=i: phrase.pop(i), lambda i=i: phrase.insert(i, rng.choice("abcxyz")), lambda i=i: phrase.__setitem__(i, rng.choice("abcxyz"))])()
        texts.append(" ".join([*(rng.choice(["alpha", "beta", "the"]) for _ in range(rng.randint(0, 5))), "".join(phrase).upper() if rng.random() < 0.3 else "".join(phrase), "omega"]))
    got = scan(spark, texts)
    missed = 0
    for r in got:
        flat = " " + " ".join(words(texts[r.doc_id])) + " "
        for text, label, errors in nt.NOTICES:
            m = regex.search(f"(?b)(?:{regex.escape(text, special_only=True)}){{e<={errors}}}", flat)
            if m:
                assert label in r.labels.split(","), (texts[r.doc_id], label)
            elif label in r.labels.split(",") and not any(regex.search(f"(?b)(?:{regex.escape(x[0], special_only=True)}){{e<={x[2]}}}", flat) for x in nt.NOTICES if x[1] == label):
                missed += label not in r.base_labels.split(",")
    assert not missed
    assert sum(bool(r.labels) for r in got) > 100


def test_spans_say_where(spark):
    (r,) = scan(spark, ["Some code. Licenced under the Apache Licence, see there. (c) all rights reserved"])
    assert r.base_labels == "reserved" and "apache" in r.labels
    assert "2:7:apache:2" in r.spans.split(",") and "10:13:reserved:0" in r.spans.split(",")


def test_slices_of_words(spark, monkeypatch):
    raw = ("filler " * 500 + "licensed under the apache license " + "more " * 500).strip()
    made = tuple(nt.Notice(*x) for x in nt.NOTICES)
    for size in (7, 100, 501, 5000):
        monkeypatch.setattr(nt, "SLICE_WORDS", size)
        out = list(nt._scan([_batch([raw])], made, nt.BASE, True))
        assert out[0].column("labels").to_pylist() == ["apache"] and out[0].column("spans").to_pylist() == ["500:505:apache:0"]


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def test_notices_do_not_run_across_texts(spark):
    assert [r.labels for r in scan(spark, ["all rights", "reserved", "general public", "license"])] == [""] * 4


def test_odd_rows(spark, odd_docs, no_docs):
    rows = nt.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.labels == "" and r.n_base == 0 and r.first_word is None for r in rows)
    assert {r.n_words for r in rows if r.doc_id == 5} == {180_000}
    assert nt.scan_licenses(no_docs).count() == 0


def test_notices_cut_short_at_a_text_s_ends_do_not_depend_on_the_texts_beside_it():
    made = tuple(nt.Notice(*x) for x in nt.NOTICES)
    cut = ["foo all rights reserv", "mozilla public licen", "l rights reserved", "ative commons zero then more", "zilla public license"]
    beside = ["of things", "ed things", "de y", "se e", "al", "the cre", "mo", "all rights reserved", ""]
    columns = ("labels", "score", "spans", "n_words")

    def rows(texts):
        (out,) = nt._scan([_batch(texts)], made, nt.BASE, True)
        return list(zip(*(out.column(c).to_pylist() for c in columns), strict=True))

    alone = {t: rows([t])[0] for t in cut + beside}
    assert alone["foo all rights reserv"][0] == "reserved" and alone["mozilla public licen"][0] == "mpl"
    for t in cut:
        for x in beside + cut:
            assert rows([x, t, x]) == [alone[x], alone[t], alone[x]]
