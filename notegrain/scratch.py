"""Where intermediate tables go: the folder that the cluster names, which all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Of the JVM: free memory of the C heap goes back to the machine.
COMMAND = "systemTrimNativeHeap"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in a local session, where every executor sees it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="notegrain-")
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    """Is anything at this path, in whatever store it names?"""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(target))


def written(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor loses nothing. files: at most so many, for small rows."""
    spark = df.sparkSession
    df = df if files is None else df.coalesce(files)
    path = f"{shared_folder(spark).rstrip('/')}/notegrain/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    release(spark)
    return out


def release(spark: SparkSession) -> bool:
    """Have the driver's JVM give free native memory back to the machine; False if it has no such command.

    Compiling and planning leave that memory in pieces which the C library keeps for each thread; a driver that plans many jobs holds more of it with each.
    """
    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # by the interface: the server's own class is closed to callers
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), COMMAND
        call.invoke(server, given)
    except Py4JError:
        return False
    return True


def folder_of(table: DataFrame) -> str:
    """Where a written table's files are."""
    return _paths[table]


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: what came of them is written itself."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(target, True)
