"""Lineage cuts through the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_collected: ContextVar[list[DataFrame] | None] = ContextVar("collected", default=None)


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a fresh local folder an application in local mode (tests) and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _local[app]


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that iterations don't stack up lineage."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if (tables := _collected.get()) is not None:
        tables.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of earlier cuts that nothing reads any more; other tables are left alone."""
    for table in tables:
        spark, root = table.sparkSession, shared(table.sparkSession).rstrip("/").rpartition(":")[2].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if folder.rpartition("/")[0].rpartition(":")[2].lstrip("/") == root:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def freed():
    """At its end the tables of all cuts inside are deleted; results that read them must have been stored by then."""
    before, tables = _collected.get(), []
    _collected.set(tables)
    try:
        yield
    finally:
        _collected.set(before)
        drop(*tables)
