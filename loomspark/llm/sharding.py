"""Contiguous shards of near equal bytes from global prefix sums, in DataFrame operations only.

Documents stand in the order (hash of the text, id), so that equal texts are neighbours. Prefix sums of their sizes
come from totals per range partition; a document belongs to the shard in which the middle of its byte interval lies.
A group of equal texts that a cut would split goes whole to the shard of its own middle while it is small against a
shard (whole_groups of one); larger groups are cut like any other run of documents, so no group can unbalance shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._shared import free_name, prefix_sums, read, stage

OVERHEAD = 16  # bytes that a record takes besides its text


def _shard_of(middle_twice: Column, total: int, shards: int) -> Column:
    """The shard of half that byte position, in whole numbers."""
    return F.least(F.floor(middle_twice * F.lit(shards).cast("decimal(20,0)") / F.lit(2 * max(total, 1)).cast("decimal(20,0)")), F.lit(shards - 1)).cast("int")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", whole_groups: float = 0.05) -> DataFrame:
    """Return key, size, text_crc32, shard, slot for each row.

    Null texts have the bytes of an empty one; a null key comes first among equal texts. Repeated rows are
    interchangeable: together they get the same shards and slots in any run. Fewer rows than shards leave shards
    empty, an empty table gives no rows. Other columns are ignored, so none can clash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"), (F.octet_length(body) + OVERHEAD).cast("long").alias("_size"),
        F.crc32(body.cast("binary")).alias("_crc"), F.xxhash64(body).alias("_group"),
    )
    rows = stage(rows, "op4-sized")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    placed = stage(prefix_sums(rows, [F.col("_group"), F.col("_key")], {"_at": F.col("_size"), "_n": F.lit(1)}, "op4-range"), "op4-placed")
    own = placed.withColumn("_own", _shard_of(2 * F.col("_at") + F.col("_size"), total, shards))
    # A cut splits at most one group, so there are fewer split groups than shards.
    split = own.groupBy("_group").agg(F.min("_own").alias("_a"), F.max("_own").alias("_b"), F.min("_at").alias("_from"), F.sum("_size").alias("_bytes"))
    split = split.where((F.col("_a") < F.col("_b")) & (F.col("_bytes") <= F.lit(whole_groups * total / shards)))
    split = split.select("_group", _shard_of(2 * F.col("_from") + F.col("_bytes"), total, shards).alias("_all"))
    out = own.join(F.broadcast(split), "_group", "left").withColumn("shard", F.coalesce("_all", "_own"))
    starts = out.groupBy("shard").agg(F.min("_n").alias("_first"))  # one row a shard
    return out.join(F.broadcast(starts), "shard").select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_n") - F.col("_first")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the rows of docs as Parquet under path, one folder shard=k each, and return the assignment.

    All columns stay; where docs has a column shard the folder's is _shard, and so on. Rows find their shard by key
    and text, so keys should be unique; null keys and texts count like any other, and rows repeated whole are
    written as often as they stand in docs. An empty table writes none.
    """
    where = stage(assign(docs, shards, key, text), "op4-assigned")
    same, folder = free_name(docs, "_same"), free_name(docs, "shard")
    told = F.struct(F.col(key).alias("k"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("c"))
    to = where.groupBy(F.struct(F.col(key).alias("k"), F.col("text_crc32").alias("c")).alias(same)).agg(F.min("shard").alias(folder))
    rows = docs.withColumn(f"{same}0", told)
    rows.join(to, F.col(f"{same}0").eqNullSafe(F.col(same))).drop(f"{same}0", same).write.partitionBy(folder).parquet(path)
    return where


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = assign(read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
