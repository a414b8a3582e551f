"""Retrieval: BM25 over an inverted table, exact vector search, and reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HybridConfig:
    """How many results each retriever gives, how many are kept, and the rank constant of the fusion."""

    top_k_lexical: int = 10
    top_k_vector: int = 10
    final_top_k: int = 5
    rrf_k: int = 60
    k1: float = 1.2
    b: float = 0.75


def matches_all(filters: Mapping[str, Any] | None) -> Column:
    """Metadata filters: every named column equals its value, or one of its values; None asks for null."""
    own = []
    for name, value in (filters or {}).items():
        own.append(F.col(name).isNull() if value is None else F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return reduce(lambda a, b: a & b, own, F.lit(True))


def word_list(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, lower-cased A-Z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, length, term, tf): the inverted table of a text column."""
    listed = docs.select(key, word_list(F.col(text)).alias("words"))
    return listed.select(key, F.size("words").alias("length"), F.explode("words").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, config: HybridConfig = HybridConfig(), filters: Mapping[str, Any] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) for ``queries(query_id, text)`` over ``docs(doc_id, text, ...)``.

    Only terms that some query has are kept, by a semi-join before anything is counted per term; scores
    add up in one aggregation and the k best of each query are cut per task before they meet.
    """
    docs = docs.where(matches_all(filters))
    asked = queries.select("query_id", F.explode(F.array_distinct(word_list(F.col("text")))).alias("term"))
    sizes = docs.select(F.size(word_list(F.col("text"))).alias("length")).agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    held = postings(docs, "doc_id", "text").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    n_docs, mean_length = sizes.select("n_docs").scalar(), sizes.select("mean_length").scalar()
    idf = df.select("term", mean_length.alias("mean_length"), F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weigh = F.col("idf") * F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("length") / F.col("mean_length")))
    scored = held.join(F.broadcast(idf), "term").select("doc_id", "term", weigh.alias("w"))
    total = scored.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return ranked(total, "query_id", k)


def ranked(scores: DataFrame, by: str, k: int, key: str = "doc_id") -> DataFrame:
    own = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, most_queries: int = 10_000) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine of ``queries(query_id, vector)`` with every row of ``vectors(doc_id, vector)``.

    The stated query set is broadcast when it has at most ``most_queries`` rows (a few MB); more are refused, to be asked in blocks.
    """
    n = queries.limit(most_queries + 1).count()
    if n > most_queries:
        raise ValueError("ask in blocks of queries")
    q = queries.select("query_id", F.col("vector").alias("q"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("qn"))
    c = vectors.select("doc_id", F.col("vector").alias("c"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("cn"))
    met = c.join(F.broadcast(q), (F.col("qn") > 0) & (F.col("cn") > 0) & (F.size("q") == F.size("c")))
    return ranked(met.select("query_id", "doc_id", F.round(dot(F.col("q"), F.col("c")) / (F.col("qn") * F.col("cn")), 6).alias("score")), "query_id", k)


def reciprocal_rank_fusion(lists: list[DataFrame], config: HybridConfig = HybridConfig()) -> DataFrame:
    """(query_id, doc_id, score, rank): ranks of several retrievers, added up as 1 / (rrf_k + rank)."""
    both = reduce(DataFrame.unionByName, (x.select("query_id", "doc_id", (1 / (F.lit(config.rrf_k) + F.col("rank"))).alias("part")) for x in lists))
    return ranked(both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score")), "query_id", config.final_top_k)
