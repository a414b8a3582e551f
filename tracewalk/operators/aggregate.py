"""Counts, rankings and groups of walks, per request, before any result limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .traverse import path_order


def count_walks(paths: DataFrame, node: str) -> DataFrame:
    """(request_id, n_paths, n_nodes): walks, and distinct nodes in column ``node``."""
    return paths.groupBy("request_id").agg(F.count("*").alias("n_paths"), F.count_distinct(node).alias("n_nodes"))


def date_key(df: DataFrame, keys: tuple[str, ...]) -> Column:
    """The first of the keys that is not null, as it is typed."""
    return F.coalesce(*(F.col(k) for k in keys))


def top_by_date(paths: DataFrame, date: Column, n: int) -> DataFrame:
    """The n walks with the latest date of each request, ties by walk order, without dates last; with date_rank."""
    own = Window.partitionBy("request_id").orderBy(date.desc_nulls_last(), *path_order(paths))
    return paths.withColumn("date_rank", F.row_number().over(own)).where(F.col("date_rank") <= n)


def latest_by_date(paths: DataFrame, date: Column) -> DataFrame:
    return top_by_date(paths, date, 1).drop("date_rank")


def group_by_max(paths: DataFrame, group: str) -> DataFrame:
    """(request_id, group, n): the group with the most walks, ties to the smaller group. Two aggregations, no window."""
    counts = paths.groupBy("request_id", group).agg(F.count("*").alias("n"))
    best = counts.groupBy("request_id").agg(F.max_by(F.struct("n", group), F.struct(F.col("n"), -F.col(group))).alias("x"))
    return best.select("request_id", f"x.{group}", "x.n")


def roll_up(units: list[DataFrame]) -> DataFrame:
    """Per-hop counts of several units, added up by request and hop."""
    both = units[0]
    for u in units[1:]:
        both = both.unionByName(u)
    return both.groupBy("request_id", "hop").agg(F.sum("n").alias("n"))


def union_units(units: list[DataFrame]) -> DataFrame:
    """Rows of a composite's units, with unit_id u1, u2, ... and unit_ordinal."""
    out = None
    for i, u in enumerate(units, 1):
        own = u.withColumns({"unit_id": F.lit(f"u{i}"), "unit_ordinal": F.lit(i)})
        out = own if out is None else out.unionByName(own)
    return out
