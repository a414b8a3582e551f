"""Connected components of a link table, by alternating large-star and small-star steps.

Links never meet on the driver. Each step takes a minimum per node (combined
before the shuffle) and joins it back, so a node with very many links is a skewed
join that AQE splits, not a group in one task. Every step's result is written to
the shared folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the links (in the given order) that join two trees: a spanning forest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)].tolist(), at[len(a) :].tolist()
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    keep = np.zeros(len(a), bool)
    for i, (u, v) in enumerate(zip(x, y, strict=True)):
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
            keep[i] = True
    return keep


def _contract(batches):
    """Links of a partition, batch by batch, to links of each node with its tree's least node."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = list(range(len(nodes)))

        def find(i, root=root):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for u, v in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        top = np.fromiter((find(i) for i in range(len(nodes))), np.int64, len(nodes))
        own = top != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[top[own]])], names=["a", "b"])


def connected_components(links: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) of every node of ``links(a, b)``; root is the least node reachable. Loops and repeats are harmless; an empty table gives an empty one."""
    pairs = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    # Contract within partitions first: most of a group's links are gone before any shuffle.
    now = materialize(pairs.mapInArrow(_contract, "a long, b long"), f"{label}-0")
    step = 0
    while True:
        step += 1
        both = now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        ways = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        small = small.select("x.a", "x.b").where("a <> b").distinct()
        after = materialize(small, f"{label}-{step}")
        # Done when every node points at one root, and no root points anywhere.
        open_ = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").unionByName(after.select(F.col("b").alias("a")).distinct().join(after.select("a").distinct(), "a", "left_semi"))
        done = open_.isEmpty()
        discard(now)
        now = after
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
