"""What the operators of this subpackage share: staged tables, checked broadcasts, global prefix sums."""

from __future__ import annotations

import atexit
import os
import sys
import uuid
from collections.abc import Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 400_000
WORD = r"[^\x20\x09-\x0D]+"
HOT_SHARE = 8  # a group is hot when it has more than one in so many times the number of partitions of all rows
_staged: list[str] = []

# Python workers get these functions by value, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules["loomspark"])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a local master without one gets its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/loomspark-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(_drop_all)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_now() -> list[str]:
    """The paths staged and not yet released."""
    return list(_staged)


def stage_over(df: DataFrame, name: str, since: Sequence[str]) -> DataFrame:
    """Stage df and delete what was staged after `since`: nothing but df may need it any more."""
    out = stage(df, name)
    release(df.sparkSession, [x for x in _staged[:-1] if x not in since])
    return out


def release(spark: SparkSession, paths: Sequence[str] | None = None) -> None:
    """Delete staged tables (all without paths); do so once what reads them has been written."""
    for x in list(_staged if paths is None else paths):
        if x in _staged:
            _staged.remove(x)
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the JVM may be gone when Python ends
        pass


def checked(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small with a broadcast hint if its counted rows stay under the bound; else as it is, for a shuffled join."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], name: str) -> DataFrame:
    """Add for each of sums its global exclusive prefix sum in the order given.

    Rows are dealt by range and staged with their partition's number; totals per partition give each partition's
    start, so no task sees more than one range. Only the totals, one row a partition, are broadcast. Order ties are
    kept together or split as the range bounds fall; rows alike in the order are interchangeable.
    """
    spark = df.sparkSession
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(partitions(spark), *[F.col(k).asc_nulls_first() for k in keys])
    dealt = stage(dealt.withColumn("_pid", F.spark_partition_id()), name)
    totals = dealt.groupBy("_pid").agg(*[F.sum(c).alias(f"_t{n}") for n, c in sums.items()])
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)  # as many rows as there are partitions
    starts = totals.select("_pid", *[F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_t{n}") for n in sums])
    within = W.partitionBy("_pid").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    out = own.join(F.broadcast(starts), "_pid")
    return out.withColumns({n: F.col(n) + F.col(f"_t{n}") for n in sums}).drop("_pid", *keys, *[f"_t{n}" for n in sums])


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()


def arrow_batches(spark: SparkSession) -> None:
    """Batches to Python workers are bounded in rows and bytes, so that a few long texts do not meet many more in memory.

    Both are settings of the session, read when a job starts; values that the session was given are left as they are.
    """
    for name, value in (("maxRecordsPerBatch", "512"), ("maxBytesPerBatch", "16777216")):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) in ("10000", str((1 << 63) - 1), str((1 << 31) - 1), "67108864", "268435456"):
            spark.conf.set(name, value)


def by_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], times: str) -> DataFrame:
    """rows joined with groups, one row each of the keys, where groups[times] counts the rows of a group.

    Groups of more than one in HOT_SHARE * partitions of all rows are broadcast, as there are at most so many; the rest
    is shuffled, so no task gets a large group. groups is read several times and should be staged.
    """
    total = groups.agg(F.sum(times)).first()[0] or 0
    bound = max(64, total // (HOT_SHARE * partitions(rows.sparkSession)))
    hot = groups.where(F.col(times) > bound)
    if hot.isEmpty():
        return rows.join(groups, list(keys))
    large = rows.join(F.broadcast(hot), list(keys))
    rest = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return large.unionByName(rest.join(groups.where(F.col(times) <= bound), list(keys)))


def distinct_texts(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (doc, th, text) without rows alike in doc and th, and the staged counts (doc, th, times).

    Copies are put together before anything is shuffled by doc; doc may be null.
    """
    counts = stage(rows.groupBy("doc", "th").agg(F.count("*").alias("times")), name)
    again = counts.where("times > 1").select(F.struct("doc", "th").alias("_again"))
    n = again.count()
    if not n:
        return rows, counts
    same = F.struct("doc", "th").eqNullSafe(F.col("_again"))
    once = rows.join(checked(again, n), same, "left_semi").groupBy("doc", "th").agg(F.first("text").alias("text"))
    return rows.join(checked(again, n), same, "left_anti").unionByName(once), counts


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows that a hash of the key chooses, the same each time, and at most twice as many; fewer rows are all taken."""
    total = rows.count()
    if total <= n:
        return rows
    part = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    return rows.where(part < n / total).limit(2 * n)
