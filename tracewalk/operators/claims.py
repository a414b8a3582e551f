"""Claims as a table: subject, predicate, object, polarity, status, and where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLAIM_KEY = ["request_id", "subject", "predicate", "object", "polarity", "status"]


def edge_claims(edges: DataFrame, names: DataFrame) -> DataFrame:
    """One affirmed claim for each evidence edge, with names for ids where ``names(node_id, name)`` has them."""
    src, dst = names.select(F.col("node_id").alias("source_id"), F.col("name").alias("source_name")), names.select(F.col("node_id").alias("target_id"), F.col("name").alias("target_name"))
    out = edges.join(src, "source_id", "left").join(dst, "target_id", "left")
    return out.select("request_id", F.coalesce("source_name", "source_id").alias("subject"), F.col("relation").alias("predicate"), F.coalesce("target_name", "target_id").alias("object"), F.lit("AFFIRM").alias("polarity"), F.lit("KNOWN").alias("status"), F.col("edge_id").alias("provenance"))


def is_a_claims(nodes: DataFrame) -> DataFrame:
    """One claim for each node (request_id, node_id, node_type, name)."""
    return nodes.select("request_id", F.col("name").alias("subject"), F.lit("IS_A").alias("predicate"), F.col("node_type").alias("object"), F.lit("AFFIRM").alias("polarity"), F.lit("KNOWN").alias("status"), F.col("node_id").alias("provenance"))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """Each claim once, with its first provenance and how often it was made."""
    return claims.groupBy(*CLAIM_KEY).agg(F.min("provenance").alias("provenance"), F.count("*").alias("n"))


def claim_order() -> list:
    """Known before unknown, affirmed before denied, then by predicate, subject and object."""
    return [F.when(F.col("status") == "KNOWN", 0).otherwise(1), F.when(F.col("polarity") == "AFFIRM", 0).otherwise(1), "predicate", "subject", "object"]
