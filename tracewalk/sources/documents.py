"""Documents, chunks, question logs and evaluation sets as tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewalk.operators.search import HybridConfig, bm25, matches_all, reciprocal_rank_fusion, vector_search
from tracewalk.sources.graph import last_wins


def chunk_lines(docs: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, position, text): the lines of each document that hold anything."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "text"))
    return lines.where(F.length(F.trim("text")) > 0).select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("position").cast("string")).alias("chunk_id"), "doc_id", "position", "text")


@dataclass
class DocumentStore:
    """Documents (doc_id, text, metadata columns) and their chunks; an upsert is a new table in which the last write of an id wins."""

    documents: DataFrame
    chunks: DataFrame

    @classmethod
    def over(cls, documents: DataFrame) -> DocumentStore:
        return cls(documents, chunk_lines(documents))

    def upsert_documents(self, new: DataFrame) -> DocumentStore:
        return DocumentStore(_upsert(self.documents, new, "doc_id"), self.chunks)

    def upsert_chunks(self, new: DataFrame) -> DocumentStore:
        return DocumentStore(self.documents, _upsert(self.chunks, new, "chunk_id"))

    def get_document(self, doc_id: Any) -> DataFrame:
        return self.documents.where(F.col("doc_id") == F.lit(doc_id))

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == F.lit(chunk_id))

    def iter_chunks(self, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return self.chunks.where(matches_all(filters))


def _upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    both = old.withColumn("_seq", F.lit(0).cast("long")).unionByName(new.select(*old.columns).withColumn("_seq", F.monotonically_increasing_id() + 1))
    return last_wins(both, key, "_seq").drop("_seq")


@dataclass
class LexicalIndex:
    chunks: DataFrame

    def search(self, queries: DataFrame, k: int, filters: Mapping[str, Any] | None = None, config: HybridConfig = HybridConfig()) -> DataFrame:
        return bm25(queries, self.chunks, k, config, filters)


@dataclass
class VectorIndex:
    vectors: DataFrame

    def search(self, queries: DataFrame, k: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return vector_search(queries, self.vectors.where(matches_all(filters)), k)


def hybrid_search(text_queries: DataFrame, vector_queries: DataFrame, lexical: LexicalIndex, vectors: VectorIndex, config: HybridConfig = HybridConfig()) -> DataFrame:
    return reciprocal_rank_fusion([lexical.search(text_queries, config.top_k_lexical, config=config), vectors.search(vector_queries, config.top_k_vector)], config)


def question_log(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn of ``turns(conv_id, turn, role, text)`` with the first turn after it, where that is the assistant's."""
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"], "left")


def evaluate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, n_found, n_expected, hits, precision, recall) of ``found(query_id, doc_id)`` against ``expected``."""
    got, want = found.select("query_id", "doc_id").distinct(), expected.select("query_id", "doc_id").distinct()
    both = got.withColumn("f", F.lit(1)).join(want.withColumn("e", F.lit(1)), ["query_id", "doc_id"], "full_outer")
    own = both.groupBy("query_id").agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n_found"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_expected"), F.coalesce(F.sum(F.col("f") * F.col("e")), F.lit(0)).alias("hits"))
    return own.withColumns({"precision": F.round(F.try_divide("hits", "n_found"), 6), "recall": F.round(F.try_divide("hits", "n_expected"), 6)})


class TelemetryLog:
    """An append-only table of questions, answers and seconds."""

    SCHEMA = "question string, answer string, seconds double"

    def __init__(self, path: str):
        self.path = path

    def append(self, entries: DataFrame) -> None:
        entries.select("question", "answer", F.col("seconds").cast("double").alias("seconds")).write.mode("append").parquet(self.path)

    def read(self, spark) -> DataFrame:
        return spark.read.schema(self.SCHEMA).parquet(self.path)
