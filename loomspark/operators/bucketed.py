"""Tables on disk in hash buckets of their key: a write rewrites the buckets that its rows fall in, and no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.folders import keep_schema, parts_of, replace_parts
from loomspark.operators.graph import cut_lineage

BUCKETS = 64
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketedTable:
    """A table of rows with a key, partitioned by a stable hash of it. One writer at a time.

    Batches have numbers: one that comes again, as after a failure, is left out if it was written whole, and written
    again if not; as merges are by key, that changes nothing but what was missing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/layout").first()
        self.key, self.buckets = row["key"], row["buckets"]

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> BucketedTable:
        spark = rows.sparkSession
        spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
        table = cls(spark, path)
        dealt = table._dealt(rows)
        keep_schema(dealt, f"{path}/rows")
        spark.createDataFrame([], "epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/epochs")
        replace_parts(cut_lineage(dealt), f"{path}/rows", "bucket", [])
        return table

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self.bucket(F.col(self.key)))

    def read(self) -> DataFrame:
        return parts_of(self.spark, f"{self.path}/rows").drop("bucket")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows with a key of keys (one column); only their buckets are read."""
        own = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        found = parts_of(self.spark, f"{self.path}/rows").where(F.col("bucket").isin(self._buckets(own)))
        return found.drop("bucket").join(own, self.key, "left_semi")

    def _buckets(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect())  # at most self.buckets

    def written(self, epoch: int) -> bool:
        return not self.spark.read.parquet(f"{self.path}/epochs").where(F.col("epoch") == epoch).isEmpty()

    def upsert(self, new: DataFrame, merge: Merge, epoch: int | None = None) -> list[int]:
        """Replace the buckets of new by merge(their rows, new); returns their numbers, none for a batch that was written before."""
        if epoch is not None and self.written(epoch):
            return []
        new = cut_lineage(new)
        buckets = self._buckets(new)
        if buckets:
            old = parts_of(self.spark, f"{self.path}/rows").where(F.col("bucket").isin(buckets)).drop("bucket")
            merged = self._dealt(merge(old, new).select(*old.columns))
            replace_parts(cut_lineage(merged), f"{self.path}/rows", "bucket", buckets)
        if epoch is not None:
            self.spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("append").parquet(f"{self.path}/epochs")
        return buckets

    def delete(self, keys: DataFrame) -> list[int]:
        """Remove the rows with a key of keys (one column); returns the buckets that were rewritten."""
        return self.upsert(keys.select(F.col(keys.columns[0]).alias(self.key)).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti"))
