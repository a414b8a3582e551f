"""Existence and absence, as semi- and anti-joins over all requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth(found: Column, closed: bool) -> Column:
    """TRUE where found; else FALSE in a closed world and UNKNOWN in an open one."""
    return F.when(found, "TRUE").otherwise("FALSE" if closed else "UNKNOWN")


def exists(anchors: DataFrame, paths: DataFrame, closed: bool) -> DataFrame:
    """(request_id, truth) of every anchor: does it have any walk?"""
    some = paths.select("request_id").distinct().withColumn("found", F.lit(True))
    return anchors.select("request_id").join(some, "request_id", "left").select("request_id", truth(F.coalesce("found", F.lit(False)), closed).alias("truth"))


def negatives(anchors: DataFrame, paths: DataFrame) -> DataFrame:
    """Anchors that have no walk."""
    return anchors.join(paths.select("request_id"), "request_id", "left_anti")


def boolean_targets(targets: DataFrame, paths: DataFrame, last: str, closed: bool) -> DataFrame:
    """(request_id, target, truth) of ``targets(request_id, target)``: does a walk of the request end there?"""
    ends = paths.select("request_id", F.col(last).alias("target")).distinct().withColumn("found", F.lit(True))
    return targets.join(ends, ["request_id", "target"], "left").select("request_id", "target", truth(F.coalesce("found", F.lit(False)), closed).alias("truth"))


def ambiguous(candidates: DataFrame, key: str = "label_key") -> DataFrame:
    """(key, best_score, n, first_id): mentions that several entities match equally well.

    ``candidates(key, node_id, node_type, score)``. Counts combine before the shuffle, so a label that a third of all entities share is no hot task.
    """
    by = candidates.groupBy(key, "score").agg(F.count_distinct("node_type", "node_id").alias("n"), F.min(F.struct("node_type", "node_id")).alias("first"))
    best = by.groupBy(key).agg(F.max_by(F.struct("score", "n", "first"), F.col("score")).alias("x"))
    return best.where("x.n > 1").select(key, F.col("x.score").alias("best_score"), F.col("x.n").alias("n"), F.col("x.first.node_id").alias("first_id"))
