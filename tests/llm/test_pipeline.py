import corpus_pipeline as cp
from llmdata import SF
from test_bitplanes import expected
from test_parity_join import brute

from tracewalk.llm import decontaminate


def test_stages_agree_with_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, SF)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= before.keys()
        if k == 0:
            assert kept[name] == {d for d, t in texts.items() if any(c.isalpha() for c in t or "")}
        if k == 1:
            groups = brute(list(before.items()), 5, 80)
            assert kept[name] == {d for d, (_, c) in groups.items() if c == d}
        if k == 2:
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 10]
            assert kept[name] == {d for d, t in before.items() if not any(b in t for b in items)}
        if k == 3:
            assert 0 < len(kept[name]) < len(before)
        if k == 4:
            got = sorted(tuple(r) for r in docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
            assert got == expected(list(before.items()))


def test_run_is_its_stages_and_odd_tables_pass(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    got = {r.doc_id for r in cp.run(spark, f"{tmp_path}/odd").collect()}
    assert got <= {1, 2, 5, 7, None} and not got & {3, 4, 6, 8}
    assert cp.ORACLE_SQL is None


def test_leaks_stage_fits_its_basis_on_every_document(spark, monkeypatch, tmp_path):
    """Were the basis fitted on as few rows as these weigh, paraphrases without a run of five words would stay."""
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", 1)
    monkeypatch.setattr(decontaminate, "FIT_ITEMS", 1)
    items = [[f"i{i}w{k}" for k in range(32)] for i in range(40)]
    clean = [(i, " ".join(f"c{(i * 7 + k * 3) % 500}" for k in range(60))) for i in range(100)]
    leaks = [(1000 + i, " ".join(x for k, w in enumerate(words) for x in ([w, "moreover"] if k % 4 == 3 else [w]))) for i, words in enumerate(items)]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(clean + leaks, "doc_id long, text string")
    kept = cp.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in clean]
