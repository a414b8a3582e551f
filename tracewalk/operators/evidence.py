"""What a set of walks proves: the nodes and edges on it, facts, provenance and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewalk.functions.text import symbol
from tracewalk.plans.ir import Step
from tracewalk.sources.graph import Graph

from .traverse import node_id_of

# Properties that name where a record came from.
PROVENANCE_KEYS = ("provenance_references", "provenance", "evidence_ref", "evidence_id", "source_ref", "source_id", "source_doc_ids", "source_chunk_ids")


def provenance_column(properties: Column, fallback: Column) -> Column:
    """Sorted distinct references under the provenance keys of a JSON object, single or listed; the fallback where there is none."""
    bag = F.from_json(properties, "map<string,string>")

    def refs(key: str) -> Column:
        raw = F.trim(F.element_at(bag, F.lit(key)))
        many = F.from_json(raw, "array<string>")
        return F.when(raw.startswith("["), F.coalesce(many, F.array())).otherwise(F.array(raw))

    found = F.array_compact(F.flatten(F.array(*(refs(k) for k in PROVENANCE_KEYS))))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def evidence_edges(graph: Graph, paths: DataFrame, steps: Sequence[Step], anchor_type: str) -> DataFrame:
    """(request_id, hop, edge_id, source_id, relation, target_id, direction, walk columns): one row for each walk and hop."""
    kinds = [symbol(anchor_type), *(s.there for s in steps)]
    hops = []
    for i, s in enumerate(steps, 1):
        here, there = node_id_of(graph, kinds[i - 1], f"n{i - 1}"), node_id_of(graph, kinds[i], f"n{i}")
        out = symbol(s.direction) == "OUT"
        hops.append(F.struct(F.lit(i).alias("hop"), F.col(f"e{i}").alias("edge_id"), (here if out else there).alias("source_id"), F.lit(symbol(s.relation)).alias("relation"), (there if out else here).alias("target_id"), F.lit(symbol(s.direction)).alias("direction")))
    return paths.select("request_id", F.explode(F.array(*hops)).alias("x")).select("request_id", "x.*")


def evidence_nodes(graph: Graph, paths: DataFrame, steps: Sequence[Step], anchor_type: str) -> DataFrame:
    """(request_id, node_id, node_type), each node once."""
    kinds = [symbol(anchor_type), *(s.there for s in steps)]
    on = [F.struct(node_id_of(graph, k, f"n{i}").alias("node_id"), F.lit(k).alias("node_type")) for i, k in enumerate(kinds)]
    return paths.select("request_id", F.explode(F.array(*on)).alias("x")).select("request_id", "x.*").distinct()


def hop_cardinality(edges: DataFrame) -> DataFrame:
    """(request_id, hop, n): evidence rows of each hop."""
    return edges.groupBy("request_id", "hop").agg(F.count("*").alias("n"))


def typed_facts(edges: DataFrame) -> DataFrame:
    """(request_id, subject, predicate, object, edge_id): evidence edges as facts, each once."""
    return edges.select("request_id", F.col("source_id").alias("subject"), F.col("relation").alias("predicate"), F.col("target_id").alias("object"), "edge_id").distinct()


def result_graph(graph, edges: DataFrame, relation: str) -> DataFrame:
    """The edges of a relation that are in evidence, as the graph has them."""
    return graph.edges(relation).join(edges.select("edge_id").distinct(), "edge_id", "left_semi")
