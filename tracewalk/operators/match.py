"""Required subgraphs: does the evidence of a request hold a pattern of typed nodes and edges?

A pattern is joined edge by edge. Aliases are bound injectively, and every binding is
tried, since a join is all of them; the least witness is reported.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewalk.functions.text import symbol


@dataclass(frozen=True)
class PatternNode:
    alias: str
    node_type: str = ""
    node_id: str = ""


@dataclass(frozen=True)
class PatternEdge:
    source: str
    relation: str
    target: str


@dataclass(frozen=True)
class Pattern:
    name: str
    nodes: tuple[PatternNode, ...]
    edges: tuple[PatternEdge, ...]


def pattern_of_walk(name: str, anchor_type: str, steps: Sequence, anchor_id: str = "") -> Pattern:
    """The pattern that a plan's steps prove: one alias for each place on the walk."""
    nodes = [PatternNode("a0", symbol(anchor_type), anchor_id)]
    edges = []
    for i, s in enumerate(steps, 1):
        nodes.append(PatternNode(f"a{i}", s.there))
        a, b = (f"a{i - 1}", f"a{i}") if symbol(s.direction) == "OUT" else (f"a{i}", f"a{i - 1}")
        edges.append(PatternEdge(a, symbol(s.relation), b))
    return Pattern(name, tuple(nodes), tuple(edges))


def match_pattern(edges: DataFrame, nodes: DataFrame, pattern: Pattern) -> DataFrame:
    """(request_id, one column for each alias) of every way the pattern fits.

    ``edges(request_id, source_id, relation, target_id)`` and ``nodes(request_id, node_id, node_type)``.
    """
    out = None
    for e in pattern.edges:
        own = edges.where(F.col("relation") == symbol(e.relation)).select("request_id", F.col("source_id").alias(e.source), F.col("target_id").alias(e.target)).distinct()
        out = own if out is None else out.join(own, ["request_id", *(c for c in (e.source, e.target) if c in out.columns)])
    for n in pattern.nodes:
        fits = nodes.select("request_id", F.col("node_id").alias(n.alias), "node_type").where((F.col("node_type") == symbol(n.node_type)) if n.node_type and symbol(n.node_type) not in ("ENTITY", "ANY") else F.lit(True))
        if n.node_id:
            fits = fits.where(F.col(n.alias) == n.node_id)
        fits = fits.drop("node_type").distinct()
        out = fits if out is None else out.join(fits, ["request_id", n.alias] if n.alias in out.columns else "request_id")
    names = [n.alias for n in pattern.nodes]
    apart = [F.col(a) != F.col(b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return out.where(reduce(lambda a, b: a & b, apart)) if apart else out


def proofs(matches: DataFrame, names: Sequence[str]) -> DataFrame:
    """(request_id, n_proofs, witness): how many bindings each request has, and the least, joined with '>'."""
    return matches.groupBy("request_id").agg(F.count("*").alias("n_proofs"), F.min(F.concat_ws(">", *names)).alias("witness"))
