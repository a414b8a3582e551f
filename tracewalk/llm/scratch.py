"""Where operators keep what must outlive a task: the folder all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``; where that is unset, a folder of our own in local mode (tests), and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tracewalk-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tracewalk/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, arrow_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: cuts lineage, survives lost executors.

    ``arrow_rows`` are the rows of a batch that goes to Python meanwhile: few where rows are wide, many where they are narrow.
    """
    path = new_path(df.sparkSession, label)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = conf.get(name)
    if arrow_rows:
        conf.set(name, arrow_rows)
    try:
        df.write.parquet(path)
    finally:
        conf.set(name, own)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on batches of rows that go to Python are this small: whole texts in them are held several times over, here and there."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs hold: Spark deletes shuffle files and broadcasts when the driver's references are collected, which a large heap may put off for long.

    The driver's JVM also gives back native memory that it has freed, most of it from compiling the code of many plans.
    """
    gc.collect()
    spark._jvm.System.gc()
    try:
        _trim_driver(spark)
    except Py4JError:  # a JVM or C library without it
        pass


def _trim_driver(spark: SparkSession) -> None:
    """The diagnostic command ``System.trim_native_heap``, called by the interface's method since the server's class is hidden."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind, values):
        out = new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    named = jvm.Class.forName
    types = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, types))
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke.invoke(server, array(jvm.Object, [command, "systemTrimNativeHeap", new_array(jvm.Object, 0), new_array(jvm.String, 0)]))


def trim() -> None:
    """Give a worker's freed memory back to the system, for the tasks of other kinds that share the machine."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI: local folders, HDFS, and the object stores that pyarrow knows, under Hadoop's names for them too."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "dbfs":
        uri = "file:///dbfs/" + rest.lstrip("/")
    elif scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    elif "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def write_atomic(uri: str, data: bytes) -> None:
    """Write under a private name, then rename: a retried or speculative task leaves one whole file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)
