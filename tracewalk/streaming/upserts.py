"""Graph tables kept up to date by a stream.

Each micro-batch is appended as one folder named by its id, so a batch that is run again
replaces itself; a reader folds the log, and the last write of an id wins. Compaction
rewrites the log's folds into one base folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewalk.sources.graph import EDGE_SCHEMA, NODE_SCHEMA, FactGraph, coerce_edges, coerce_nodes, last_wins


class GraphLog:
    """A folder with ``nodes`` and ``edges`` logs, partitioned by batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def put_nodes(self, rows: DataFrame, batch: int) -> None:
        self._write(coerce_nodes(rows.withColumn("seq", F.monotonically_increasing_id()), ("seq",)), "nodes", batch)

    def put_edges(self, rows: DataFrame, batch: int) -> None:
        self._write(coerce_edges(rows.withColumn("seq", F.monotonically_increasing_id()), ("seq",)), "edges", batch)

    def _fold(self, table: str, schema: str, key: str) -> DataFrame:
        # A stream that has written nothing yet is an empty graph.
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, seq long, batch long").parquet(f"{self.folder}/{table}")
        return last_wins(rows, key, ["batch", "seq"]).drop("batch", "seq")

    def graph(self) -> FactGraph:
        return FactGraph(self.spark, self._fold("nodes", NODE_SCHEMA, "node_id"), self._fold("edges", EDGE_SCHEMA, "edge_id"))

    def compact(self, into: str) -> GraphLog:
        """A new log whose first batch is the fold of this one."""
        out, graph = GraphLog(self.spark, into), self.graph()
        out.put_nodes(graph.node_table, 0)
        out.put_edges(graph.edge_table, 0)
        return out

    def follow_nodes(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return self._follow(stream, self.put_nodes, checkpoint, once)

    def follow_edges(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        return self._follow(stream, self.put_edges, checkpoint, once)

    @staticmethod
    def _follow(stream: DataFrame, put, checkpoint: str, once: bool) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
