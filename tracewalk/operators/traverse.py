"""Bounded typed walks as chains of equi-joins.

Anchors come as a table (request_id, key), so one question and a million are one plan. A
walk's rows carry the keys n0..nk and edge ids e1..ek; walks may revisit nodes, and
parallel edges are different walks. Order is by the edge ids, in code-point order.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewalk.functions.text import symbol
from tracewalk.plans.ir import WILDCARDS, Step
from tracewalk.sources.graph import Graph


class WalkError(RuntimeError):
    """A walk that its plan forbids; the message is a reason code."""


def anchors_of(graph: Graph, kind: str) -> DataFrame:
    """Every node of a type as an anchor of its own request, named by its key."""
    return graph.nodes(kind).select(F.col("key").alias("request_id"), F.col("key").alias("n0"))


def anchor(graph: Graph, kind: str, node_id: str, request_id: str = "q") -> DataFrame:
    """One anchor; the filter is on the native key and reaches the scan."""
    rows = graph.nodes(None if symbol(kind) in WILDCARDS else kind)
    key = graph.key(kind, node_id) if symbol(kind) not in WILDCARDS else node_id
    own = F.col("key") if symbol(kind) not in WILDCARDS else F.col("node_id")
    return rows.where(own == F.lit(key)).select(F.lit(request_id).alias("request_id"), F.col("key").alias("n0"))


def expand(paths: DataFrame, graph: Graph, step: Step, hop: int, anchor_key: Any = None) -> DataFrame:
    """Paths one hop longer. Edges whose far end is no node of the reached type lead nowhere.

    ``anchor_key``, for a first hop from one anchor, is repeated as a filter on the edges so that it is pushed into their scan.
    """
    out = symbol(step.direction) == "OUT"
    if not out and symbol(step.direction) != "IN":
        raise WalkError("relation_direction_unsupported")
    edges = graph.edges(step.relation).select(F.col("src" if out else "dst").alias("here"), F.col("dst" if out else "src").alias(f"n{hop}"), F.col("edge_id").alias(f"e{hop}"))
    if anchor_key is not None:
        edges = edges.where(F.col("here") == F.lit(anchor_key))
    reached = graph.nodes(None if step.there in WILDCARDS else step.there).select(F.col("key").alias("there"))
    walked = paths.join(edges, paths[f"n{hop - 1}"] == edges["here"]).drop("here")
    return walked.join(reached, F.col(f"n{hop}") == F.col("there"), "left_semi")


def walk(graph: Graph, anchors: DataFrame, steps: Sequence[Step], anchor_key: Any = None) -> DataFrame:
    """All walks along the steps: request_id, n0, e1, n1, ..."""
    paths = anchors
    for hop, step in enumerate(steps, 1):
        paths = expand(paths, graph, step, hop, anchor_key if hop == 1 else None)
    return paths


def hops_of(paths: DataFrame) -> int:
    return sum(c[0] == "e" and c[1:].isdigit() for c in paths.columns)


def path_order(paths: DataFrame) -> list:
    """Columns that order walks totally: edge ids, then keys."""
    k = hops_of(paths)
    return [F.col(f"e{i}") for i in range(1, k + 1)] + [F.col(f"n{i}") for i in range(k + 1)]


def limit_per_request(paths: DataFrame, most: int) -> DataFrame:
    """The first ``most`` walks of each request, with their rank.

    A group limit runs before the shuffle, so each task hands on at most ``most`` rows of a request.
    """
    own = Window.partitionBy("request_id").orderBy(*path_order(paths))
    return paths.withColumn("path_rank", F.row_number().over(own)).where(F.col("path_rank") <= most)


def limit_walks(paths: DataFrame, most: int) -> DataFrame:
    """The same for a single request: a top-k, without a window."""
    return paths.orderBy(*path_order(paths)).limit(most)


def fan_out(graph: Graph, anchors: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """(request_id, hop, walks): the walks that exist at each hop, before any limit."""
    out, paths = None, anchors
    for hop, step in enumerate(steps, 1):
        paths = expand(paths, graph, step, hop)
        own = paths.groupBy("request_id").agg(F.count("*").alias("walks")).select("request_id", F.lit(hop).alias("hop"), "walks")
        out = own if out is None else out.unionByName(own)
    return out


def cap_violations(graph: Graph, anchors: DataFrame, steps: Sequence[Step], cap: int) -> DataFrame:
    """Requests and hops with more walks than the cap; for a single question that is an error."""
    return fan_out(graph, anchors, steps).where(F.col("walks") > cap)


def checked_walk(graph: Graph, anchors: DataFrame, steps: Sequence[Step], cap: int, anchor_key: Any = None) -> DataFrame:
    """A single request's walks, after a probe of each hop that stops at cap + 1 rows. Raises WalkError beyond the cap."""
    paths = anchors
    for hop, step in enumerate(steps, 1):
        paths = expand(paths, graph, step, hop, anchor_key if hop == 1 else None)
        if paths.limit(cap + 1).count() > cap:
            raise WalkError("cardinality_cap_exceeded")
    return paths


def result_rows(graph: Graph, paths: DataFrame, steps: Sequence[Step], anchor_type: str) -> DataFrame:
    """Walks as rows: the node reached, by id, type and name, its properties, and the walk's ids joined with '>'."""
    kinds = [symbol(anchor_type), *(s.there for s in steps)]
    last = len(steps)
    ends = graph.nodes(None if kinds[last] in WILDCARDS else kinds[last]).select(F.col("key").alias("end_key"), "node_id", "node_type", "name", "properties")
    out = paths.join(ends, F.col(f"n{last}") == F.col("end_key"))
    ids = [F.concat(F.lit(_prefix(graph, k)), F.col(f"n{i}").cast("string")) for i, k in enumerate(kinds)]
    edges = [F.col(f"e{i}") for i in range(1, last + 1)]
    return out.withColumns({"path_nodes": F.concat_ws(">", *ids), "path_edges": F.concat_ws(">", *edges) if edges else F.lit(""), "relation": F.lit(symbol(steps[-1].relation) if steps else "")}).drop("end_key")


def _prefix(graph: Graph, kind: str) -> str:
    return graph.node_map(kind).prefix if hasattr(graph, "node_map") else ""


def node_id_of(graph: Graph, kind: str, column: str):
    return F.concat(F.lit(_prefix(graph, kind)), F.col(column).cast("string"))
