"""Folders that driver and executors share, for tables of a run and for indexes kept on disk."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import SparkSession

_open: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master gets one of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or f"file:///tmp/loomspark-run-{os.getuid()}").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the process ends, or with drop()."""
    if not _open:
        atexit.register(_drop_all)
    _open.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _open[-1]


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _open:
        _open.remove(path)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            for path in list(_open):
                drop(spark, path)
    except Exception:  # the JVM may be gone when Python ends
        pass


def replace_parts(rows, path: str, by: str, parts: list[int]) -> None:  # noqa: ANN001
    """Replace the parts (values of the partition column) of the table at path by rows, and no other; parts without rows go.

    rows must not read the table any more. A large part is dealt over several files.
    """
    spark = rows.sparkSession
    left = {r[0] for r in rows.select(by).distinct().collect()} if parts else set()  # as many as parts at most
    rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for p in parts:
        if p not in left:
            drop(spark, f"{path}/{by}={p}")


def keep_schema(rows, path: str) -> None:  # noqa: ANN001
    """Keep the columns of the table at path beside it, as its parts may all go."""
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}-columns")


def parts_of(spark: SparkSession, path: str):  # noqa: ANN201
    """The table at path, with the columns that keep_schema() noted; without parts it is empty."""
    return spark.read.schema(spark.read.parquet(f"{path}-columns").schema).parquet(path)


def staged(rows, name: str = "rows"):  # noqa: ANN001, ANN201
    """rows by way of a table in the shared folder. A loop of many rounds needs this rather than checkpoints, which hand on
    what the optimizer has inferred of their columns, more with each round."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
