"""Seams for models that are not shipped: embeddings, completions, and extraction of graph records from text.

A provider is any object with the method named; it is pickled to the executors and
called with batches, one Arrow batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

from tracewalk.functions.text import canonical_json

from .graph import EDGE_SCHEMA, NODE_SCHEMA, FactGraph


class EmbeddingProvider(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class CompletionProvider(Protocol):
    def complete(self, prompt: str) -> str: ...


class EntityExtractor(Protocol):
    """Node records (node_id, node_type, properties) of one chunk (a dict of its columns)."""

    def extract(self, chunk: dict[str, Any]) -> Sequence[dict[str, Any]]: ...


class RelationExtractor(Protocol):
    """Edge records (edge_id, src_id, dst_id, relation, properties) of one chunk and its entities."""

    def extract(self, chunk: dict[str, Any], entities: Sequence[dict[str, Any]]) -> Sequence[dict[str, Any]]: ...


class IntentHandler(Protocol):
    """Takes over questions of its own: builds a graph query, says what its rows mean and whether they suffice."""

    def can_handle(self, question: str) -> bool: ...
    def build(self, question: str, graph: Any) -> DataFrame: ...
    def summarize(self, rows: Sequence[dict[str, Any]]) -> str: ...
    def is_satisfied(self, rows: Sequence[dict[str, Any]]) -> bool: ...


def answer_by_intent(question: str, graph: Any, handlers: Sequence[IntentHandler], most: int = 1000) -> str | None:
    """The first handler that takes the question and is satisfied with at most ``most`` rows; None where there is none."""
    for h in handlers:
        if h.can_handle(question):
            rows = [r.asDict() for r in h.build(question, graph).limit(most).collect()]
            if h.is_satisfied(rows):
                return h.summarize(rows)
    return None


def embed_column(df: DataFrame, provider: EmbeddingProvider, text: str = "text", out: str = "vector") -> DataFrame:
    """``df`` with the provider's vectors of a text column; null texts are embedded as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [[float(x) for x in v] for v in provider.embed(b[text].fillna("").tolist())]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{out}` array<float>")


def complete_column(df: DataFrame, provider: CompletionProvider, prompt: str = "prompt", out: str = "completion") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: [provider.complete(p) for p in b[prompt].fillna("")]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, `{out}` string")


def extract_graph(chunks: DataFrame, entities: EntityExtractor, relations: RelationExtractor) -> FactGraph:
    """A graph of what two extractors find in ``chunks``; of one id, one record stays."""

    def rows(kind: str, names: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for chunk in b.to_dict("records"):
                    found = list(entities.extract(chunk))
                    for r in found if kind == "nodes" else relations.extract(chunk, found):
                        out.append([r.get(n) for n in names[:-1]] + [canonical_json(r.get("properties") or {})])
                yield pd.DataFrame(out, columns=names)

        return run

    spark = chunks.sparkSession
    node_names, edge_names = (["node_id", "node_type", "properties"], ["edge_id", "src_id", "dst_id", "relation", "properties"])
    nodes = chunks.mapInPandas(rows("nodes", node_names), NODE_SCHEMA)
    edges = chunks.mapInPandas(rows("edges", edge_names), EDGE_SCHEMA)
    empty = FactGraph(spark, spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
    return empty.upsert_nodes(nodes).upsert_edges(edges)
