"""Intermediate tables in the folder that driver and executors share.

The folder is the session's spark.checkpoint.dir.  Only where that is unset and the
master is this one machine, as in tests, a folder of our own is made.  A table written here cuts the
lineage: executors lost later cost no recomputation of what came before.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: What settle() may clear: how to remove each table and broadcast made, in order.
_made: list[Callable[[], None]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        set_dir = context._jsc.sc().getCheckpointDir()
        found = set_dir.get() if set_dir.isDefined() else _own.get(context.applicationId)
        if not found:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = _own[context.applicationId] = tempfile.mkdtemp(prefix="textloom-")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; it goes when the session's driver exits, or settle() clears it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    _made.append(partial(_remove, spark, path))
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast variable that settle() can destroy."""
    out = spark.sparkContext.broadcast(value)
    _made.append(partial(_destroy, out))
    return out


def settle(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `build` returns, written out; the tables and broadcasts that it made on the way are removed."""
    before = len(_made)
    out = materialize(build(), name)
    keep = _made.pop()
    for clear in _made[before:]:
        clear()
    del _made[before:]
    _made.append(keep)
    # the shuffle files of what is settled stay until the driver's JVM collects the plans that made them
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned and nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _remove(df.sparkSession, file.rsplit("/", 1)[0])


def _destroy(value: Broadcast) -> None:
    if value._sc._jsc is not None:
        value.destroy()


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:
        return
    jvm = context._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
