"""Property graphs as tables.

A graph offers ``nodes(type)`` and ``edges(relation)`` with native keys, so a filter on
an anchor reaches the Parquet scan; text ids are made in the last projection alone.
``FactGraph`` holds generic node and edge records; ``StarGraph`` maps relations onto the
key columns of ordinary tables, without copying them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewalk.functions.text import canonical_json, filled, label_key, label_key_column, symbol

NODE_SCHEMA = "node_id string, node_type string, properties string"
EDGE_SCHEMA = "edge_id string, src_id string, dst_id string, relation string, properties string"

# The names that records may use for a field, first one first.
NODE_FIELDS = {"node_id": ("node_id", "id"), "node_type": ("node_type", "type")}
EDGE_FIELDS = {"edge_id": ("edge_id", "id"), "src_id": ("src_id", "source_id", "source"), "dst_id": ("dst_id", "target_id", "target"), "relation": ("relation", "relation_type")}
NAME_KEYS = ("name", "display_name", "label")


class Graph(Protocol):
    """nodes: (key, node_id, node_type, name, properties); edges: (src, dst, edge_id, relation, properties)."""

    spark: SparkSession

    def nodes(self, kind: str | None = None) -> DataFrame: ...
    def edges(self, relation: str) -> DataFrame: ...
    def key(self, kind: str, node_id: str) -> Any: ...
    def candidates(self, mention: str, kind: str | None) -> list: ...


def _first(df: DataFrame, options: tuple[str, ...]) -> Column:
    have = [filled(F.col(c)) for c in options if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _properties(df: DataFrame) -> Column:
    if "properties" not in df.columns:
        return F.lit("{}")
    kind = df.schema["properties"].dataType.typeName()
    text = F.col("properties") if kind == "string" else F.to_json("properties")
    return F.coalesce(text, F.lit("{}"))


def coerce_nodes(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Node records under any accepted field names, with the columns ``keep``; those without id or type are dropped."""
    own = [_first(df, v).alias(k) for k, v in NODE_FIELDS.items()]
    return df.select(*own, _properties(df).alias("properties"), *keep).where("node_id is not null and node_type is not null")


def surrogate_edge_id(relation: Column, source: Column, target: Column) -> Column:
    """SHA-256 of the canonical JSON of an edge's ends, as ``fingerprint`` makes it on the driver for ASCII values."""
    return F.sha2(F.to_json(F.struct(relation.alias("relation"), source.alias("source"), target.alias("target"))), 256)


def coerce_edges(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Edge records under any accepted field names; without an end or relation they are dropped, without an id they get one from their ends."""
    own = [_first(df, v).alias(k) for k, v in EDGE_FIELDS.items()]
    out = df.select(*own, _properties(df).alias("properties"), *keep).where("src_id is not null and dst_id is not null and relation is not null")
    return out.withColumn("edge_id", F.coalesce("edge_id", surrogate_edge_id(F.col("relation"), F.col("src_id"), F.col("dst_id"))))


def last_wins(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The row with the highest order of each key. An aggregate that combines before the shuffle: a key written a billion times is no hot task."""
    keys, orders = ([key] if isinstance(key, str) else key), ([order] if isinstance(order, str) else order)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*orders)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, *(f"row.{c}" for c in rest)).select(*df.columns)


def display_name(properties: Column, node_id: Column) -> Column:
    return F.coalesce(*(filled(F.get_json_object(properties, f"$.{k}")) for k in NAME_KEYS), node_id)


@dataclass
class FactGraph:
    """A graph of generic records: ids are the keys."""

    spark: SparkSession
    node_table: DataFrame
    edge_table: DataFrame

    @classmethod
    def from_facts(cls, spark: SparkSession, facts: Mapping[str, Any]) -> FactGraph:
        """From {"nodes": [...], "edges": [...]} of dicts; records are coerced and the last of an id wins."""

        def table(rows, fields, schema):
            made = [tuple(next((str(r[a]) for a in aliases if r.get(a) not in (None, "")), None) for aliases in fields.values()) + (canonical_json(r.get("properties") or {}), i) for i, r in enumerate(rows or ())]
            return spark.createDataFrame(made, schema + ", seq long")

        nodes = table(facts.get("nodes"), NODE_FIELDS, NODE_SCHEMA)
        edges = table(facts.get("edges"), EDGE_FIELDS, EDGE_SCHEMA)
        graph = cls(spark, spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))
        return graph.upsert_nodes(nodes).upsert_edges(edges)

    @staticmethod
    def _upsert(old: DataFrame, new: DataFrame, coerce, key: str) -> DataFrame:
        if "seq" not in new.columns:
            new = new.withColumn("seq", F.monotonically_increasing_id())
        both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(coerce(new, ("seq",)).withColumn("seq", F.col("seq").cast("long")))
        return last_wins(both, key, "seq").drop("seq")

    def upsert_nodes(self, new: DataFrame) -> FactGraph:
        """A graph with these records put over the old ones; of one id, the highest ``seq`` (else the last row) wins."""
        return FactGraph(self.spark, self._upsert(self.node_table, new, coerce_nodes, "node_id"), self.edge_table)

    def upsert_edges(self, new: DataFrame) -> FactGraph:
        return FactGraph(self.spark, self.node_table, self._upsert(self.edge_table, new, coerce_edges, "edge_id"))

    def cached(self) -> FactGraph:
        """The same graph, kept in executors' memory and disk for repeated questions."""
        return FactGraph(self.spark, self.node_table.persist(), self.edge_table.persist())

    def query(self) -> tuple[DataFrame, DataFrame]:
        """All nodes and all edges."""
        return self.node_table, self.edge_table

    def nodes(self, kind: str | None = None) -> DataFrame:
        rows = self.node_table if kind is None else self.node_table.where(F.upper("node_type") == symbol(kind))
        return rows.select(F.col("node_id").alias("key"), "node_id", F.upper("node_type").alias("node_type"), display_name(F.col("properties"), F.col("node_id")).alias("name"), "properties")

    def edges(self, relation: str) -> DataFrame:
        rows = self.edge_table.where(F.upper("relation") == symbol(relation))
        return rows.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "edge_id", F.upper("relation").alias("relation"), "properties")

    def key(self, kind: str, node_id: str) -> str:
        return node_id

    def candidates(self, mention: str, kind: str | None) -> list:
        wanted = label_key(mention)
        rows = self.nodes(kind if kind and symbol(kind) not in ("ENTITY", "ANY") else None)
        labels = [label_key_column(F.col("node_id")), *(label_key_column(F.get_json_object("properties", f"$.{k}")) for k in NAME_KEYS)]
        exact = (labels[0] == wanted) | F.coalesce(labels[1] == wanted, F.lit(False))
        some = reduce(lambda a, b: a | b, (F.coalesce(x == wanted, F.lit(False)) for x in labels))
        return [tuple(r) for r in rows.where(some).select("node_id", "node_type", "name", F.when(exact, 1.0).otherwise(0.9)).orderBy("node_type", "node_id").limit(MOST_CANDIDATES).collect()]


#: A mention that this many entities share is ambiguous whatever the rest are.
MOST_CANDIDATES = 50


@dataclass(frozen=True)
class NodeMap:
    """An entity type as a table: its key, its label, and the columns that are properties."""

    kind: str
    table: str
    key: str
    label: str | None = None
    properties: tuple[str, ...] = ()
    distinct: bool = False

    @property
    def prefix(self) -> str:
        return self.kind.lower() + "-"


@dataclass(frozen=True)
class EdgeMap:
    """A relation as a table: the columns of its ends, and an expression that tells its edges apart."""

    relation: str
    source_type: str
    target_type: str
    table: str
    src: str
    dst: str
    edge_id: str  # SQL
    properties: tuple[str, ...] = ()


@dataclass
class StarGraph:
    """A graph over the tables of a directory, read as they are."""

    spark: SparkSession
    folder: str
    node_maps: tuple[NodeMap, ...]
    edge_maps: tuple[EdgeMap, ...]
    _tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def node_map(self, kind: str) -> NodeMap:
        return next(m for m in self.node_maps if m.kind == symbol(kind))

    def edge_map(self, relation: str) -> EdgeMap:
        return next(m for m in self.edge_maps if m.relation == symbol(relation))

    def nodes(self, kind: str | None = None) -> DataFrame:
        if kind is None:
            return reduce(DataFrame.unionByName, (self.nodes(m.kind).withColumn("key", F.col("key").cast("string")) for m in self.node_maps))
        m = self.node_map(kind)
        rows = self.table(m.table)
        if m.distinct:
            rows = rows.select(m.key).distinct()
        node_id = F.concat(F.lit(m.prefix), F.col(m.key).cast("string"))
        name = F.coalesce(filled(F.col(m.label)), node_id) if m.label else node_id
        props = F.to_json(F.struct(*m.properties)) if m.properties else F.lit("{}")
        return rows.select(F.col(m.key).alias("key"), node_id.alias("node_id"), F.lit(m.kind).alias("node_type"), name.alias("name"), props.alias("properties"), *(F.col(c) for c in m.properties))

    def edges(self, relation: str) -> DataFrame:
        m = self.edge_map(relation)
        props = F.to_json(F.struct(*m.properties)) if m.properties else F.lit("{}")
        return self.table(m.table).select(F.col(m.src).alias("src"), F.col(m.dst).alias("dst"), F.expr(m.edge_id).alias("edge_id"), F.lit(m.relation).alias("relation"), props.alias("properties"))

    def key(self, kind: str, node_id: str) -> int | str | None:
        m = self.node_map(kind)
        own = node_id.removeprefix(m.prefix)
        return int(own) if own.lstrip("-").isdigit() else None

    def candidates(self, mention: str, kind: str | None) -> list:
        wanted = label_key(mention)
        kinds = [kind] if kind and symbol(kind) not in ("ENTITY", "ANY") else [m.kind for m in self.node_maps]
        found = []
        for k in kinds:
            rows = self.nodes(k).where((label_key_column(F.col("name")) == wanted) | (label_key_column(F.col("node_id")) == wanted))
            found += [(r.node_id, symbol(k), r.name, 1.0) for r in rows.select("node_id", F.col("name").alias("name")).orderBy("node_id").limit(MOST_CANDIDATES).collect()]
        return sorted(found, key=lambda x: (-x[3], x[1], x[0]))


def commerce(spark: SparkSession, folder: str) -> StarGraph:
    """The graph of the driver's star schema."""
    line = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))"
    return StarGraph(
        spark,
        folder,
        (
            NodeMap("REGION", "region", "r_regionkey", "r_name"),
            NodeMap("NATION", "nation", "n_nationkey", "n_name"),
            NodeMap("CUSTOMER", "customer", "c_custkey", "c_name", ("c_mktsegment",)),
            NodeMap("SUPPLIER", "supplier", "s_suppkey", "s_name"),
            NodeMap("PART", "part", "p_partkey", "p_name", ("p_brand", "p_type")),
            NodeMap("ORDER", "orders", "o_orderkey", None, ("o_orderdate", "o_orderstatus")),
            NodeMap("USER", "events", "user_id", None, (), True),
            NodeMap("EVENT", "events", "event_id", None, ("ts", "event_type")),
        ),
        (
            EdgeMap("IN_REGION", "NATION", "REGION", "nation", "n_nationkey", "n_regionkey", "cast(n_nationkey as string)"),
            EdgeMap("LOCATED_IN", "CUSTOMER", "NATION", "customer", "c_custkey", "c_nationkey", "cast(c_custkey as string)"),
            EdgeMap("BASED_IN", "SUPPLIER", "NATION", "supplier", "s_suppkey", "s_nationkey", "cast(s_suppkey as string)"),
            EdgeMap("PLACED", "CUSTOMER", "ORDER", "orders", "o_custkey", "o_orderkey", "cast(o_orderkey as string)"),
            EdgeMap("INCLUDES", "ORDER", "PART", "lineitem", "l_orderkey", "l_partkey", line),
            EdgeMap("FULFILLED_BY", "ORDER", "SUPPLIER", "lineitem", "l_orderkey", "l_suppkey", line),
            EdgeMap("EMITTED", "USER", "EVENT", "events", "user_id", "event_id", "cast(event_id as string)"),
        ),
    )
