"""Tables written between stages.

A staged table cuts lineage, survives the loss of executors, is computed once
however often it is read, and has an exact size: Catalyst broadcasts it in a
join only when its files are below ``spark.sql.autoBroadcastJoinThreshold`` and
falls back to a shuffle join beyond that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Lists of the scopes that are open; each staged path is noted in the innermost.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``, else the warehouse.

    A warehouse on a machine's own disk serves a local master only.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return warehouse.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/civiflow/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside when the block ends.

    Results that read them must have been written or collected by then.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, label: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
