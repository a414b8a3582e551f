import numpy as np
from pyspark.sql import functions as F

from tracewalk.llm import byte_cnn as bc
from tracewalk.llm import textkernel as tk
from tracewalk.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op8_byte_cnn"](spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(rows) == docs.count() and len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    one = bc.fit(docs, ~held, epochs=1)
    two = bc.fit(docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s")), ~held, epochs=1)
    assert one.languages == two.languages and all(np.array_equal(a, b) for a, b in zip([*one.tables, one.out], [*two.tables, two.out], strict=True))


def test_tables_of_pairs_are_the_convolution():
    rng = np.random.default_rng(1)
    model = bc.train(rng.integers(97, 123, (80, bc.WINDOW)).astype(np.uint8), np.arange(80) % 2, ["a", "b"], epochs=1)
    x = rng.integers(0, 256, (5, bc.WINDOW)).astype(np.uint8)
    want = []
    for t in model.tables:
        w = len(t)
        want.append(sum(t[k][x[:, k : bc.WINDOW - w + 1 + k]] for k in range(w)).max(1))
    assert np.allclose(model.features(x), np.maximum(np.concatenate(want, 1) + model.bias, 0), atol=1e-4)


def test_letters_are_of_category_l(spark):
    import unicodedata

    model = bc.train(np.full((4, bc.WINDOW), 97, np.uint8), np.arange(4) % 2, ["a", "b"], epochs=1)
    texts = ["² ½ ³", "Ⅷ ⅻ", "1 2 _", "ª", "中", "¹a", "٣", "ǅ"]
    rows = bc.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    assert {r.text: r.lang_pred == "und" for r in rows} == {t: not any(unicodedata.category(c)[0] == "L" for c in t) for t in texts}


def test_a_query_agrees_with_brute_force(spark):
    """Every text window by window, filter by filter, with the model that the query fits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = bc.fit(docs, ~held)
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op8_byte_cnn"](spark, "/root/testdata/sf0.001").collect()}
    for r in docs.orderBy(F.length("text")).limit(60).collect():
        raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "").encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id] == ("und", 0)
            continue
        total = np.zeros(len(model.languages))
        for at in range(0, len(raw), bc.WINDOW):
            x = np.frombuffer(raw[at : at + bc.WINDOW].ljust(bc.WINDOW, b"\0"), np.uint8)
            h = np.concatenate([np.max([sum(t[k][x[i + k]] for k in range(len(t))) for i in range(bc.WINDOW - len(t) + 1)], axis=0) for t in model.tables])
            z = np.maximum(h + model.bias, 0) @ model.out + model.out_bias
            p = np.exp(z - z.max())
            letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for b in x.tolist())
            total += p / p.sum() * (letters + 1e-3)
        name, score = got[r.doc_id]
        assert name == model.languages[int(total.argmax())] and abs(score - total.max() / total.sum()) < 1e-3


def test_columns_that_clash_keep_their_values(spark, odd_docs):
    model = bc.fit(odd_docs, F.lit(True), epochs=1)
    kept = bc.keep_recognised(odd_docs, model)
    assert kept.columns == odd_docs.columns
    whole = [tuple(r) for r in odd_docs.collect()]
    assert kept.count() and all(tuple(r) in whole for r in kept.collect())


def test_windows_cover_every_byte():
    import pyarrow as pa

    texts = ["a" * 600, "", "B" * 256, "é"]
    (_, _, data, offsets) = next(tk.chunks(pa.array(texts)))
    found, n = bc.windows_of(data, offsets)
    assert n.tolist() == [3, 0, 1, 1] and (found != 0).sum() == 600 + 256 + 2 and (found[3] == ord("b")).all()


def test_odd_rows(odd_docs, no_docs):
    model = bc.fit(odd_docs, F.lit(True), epochs=1)
    rows = bc.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (r.score == 0) == (not letters)
    assert {r.source for r in rows if r.doc_id == 5} == {"a"}
    none = bc.fit(no_docs, F.lit(True))
    assert none.languages == [] and bc.predict(no_docs, none).count() == 0
    assert {r.lang_pred for r in bc.predict(odd_docs, none).collect()} == {"und"}
