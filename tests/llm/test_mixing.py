import pytest
from pyspark.sql import functions as F

from compare import duck, same
from llmdata import SF
from tracewalk.llm import mixing
from tracewalk.llm.queries import QUERIES, SQL


def test_query_agrees_with_sql(spark):
    assert same(QUERIES["op2_raked_mix"](spark, SF), duck(SF), SQL["op2_raked_mix"]) == 200


def test_raked_cells_meet_all_targets(spark):
    rows = [(s, x, t, 10 + 7 * i + 3 * j + k) for i, s in enumerate("abc") for j, x in enumerate("xy") for k, t in enumerate("pq")]
    targets = {"source": {"a": 1, "b": 2, "c": 5}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 3, "q": 1}}
    out = mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), targets, rounds=30)
    total = sum(r[3] for r in rows)
    for d, shares in targets.items():
        got = {r[0]: r.w for r in out.groupBy(d).agg(F.sum("w").alias("w")).collect()}
        for k, v in shares.items():
            assert got[k] / total == pytest.approx(v / sum(shares.values()), abs=1e-6)


def test_expected_tokens_are_the_budget(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for rate in (0.1, 0.5, 0.9):
        r = mixing.mix(docs, rate).agg(F.sum(F.col("mix_tokens") * F.col("mix_prob")).alias("e"), F.sum("mix_tokens").alias("t"), F.max("mix_prob").alias("m"), F.min("mix_prob").alias("l")).first()
        assert r.e == pytest.approx(rate * r.t, rel=1e-6) and r.m <= 1 and r.l >= 0


def test_a_value_without_target_is_left_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs, 0.5, {"lang": {"en": 1.0}})
    assert out.where("mix_lang <> 'en' and mix_sampled").count() == 0 and out.where("mix_sampled").count() > 0


def test_own_topic_column(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r[0] for r in mixing.mix(docs, topic=F.col("source")).select("mix_topic").distinct().collect()} == {r[0] for r in docs.select("source").distinct().collect()}


def test_sampling_is_a_function_of_the_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (sorted(r[0] for r in mixing.mix(x).where("mix_sampled").select("doc_id").collect()) for x in (docs, docs.repartition(9)))
    assert a == b


def test_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs, 1.0).collect()
    assert len(out) == odd_docs.count()
    assert all(not r.mix_sampled and r.mix_prob == 0 for r in out if not (r.text or "").strip())
    assert all(r.mix_sampled for r in out if (r.text or "").strip())
    assert {r.mix_lang for r in out if r.lang is None} == {mixing.MISSING}
    empty = mixing.mix(no_docs)
    assert empty.count() == 0 and "mix_sampled" in empty.columns


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sample_keeps_columns_that_clash(spark):
    rows = [(i, f"word {i} " * (i % 7 + 1), "en" if i % 3 else None, f"s{i % 4}", str(i), 7.0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Mix_Prob string, score double")
    kept = mixing.sample(docs, rate=0.5)
    assert kept.columns == docs.columns
    got = {tuple(r) for r in kept.collect()}
    assert 0 < len(got) < 200 and got <= set(rows)
