"""Streaming variants: hourly windows, exactly-once upserts, retries with a dead-letter sink, request limits, sessions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.operators import memory
from loomspark.operators.bucketed import BucketedTable
from loomspark.operators.graph import cut_lineage


def hourly_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """start, user_id, n, total per hour of event time; later events than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = timed.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "user_id")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "user_id", "n", "total")


def session_stream(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, end, user_id, n of sessions that a gap ends."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windows = timed.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return windows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def dead_letters(dead: DataFrame, topic: str, now: Column) -> DataFrame:
    """key, value, headers (seven names and texts) of messages (message_id, agent_id, body, reason, attempts, source) for a dead-letter sink."""
    named = {"original_topic": F.lit(topic), "message_id": F.col("message_id"), "agent_id": F.col("agent_id"), "reason": F.col("reason"), "attempts": F.col("attempts"), "source": F.col("source"), "failed_at": now}
    headers = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for k, v in named.items()])
    return dead.select(F.col("agent_id").cast("string").alias("key"), F.col("body").alias("value"), headers.alias("headers"))


def retried(send: Callable[[], None], attempts: int = 5, first: float = 0.5, wait: Callable[[float], None] = time.sleep) -> int:
    """Call send until it succeeds, waiting twice as long each time; the last failure is raised. Returns the number of calls."""
    for n in range(1, attempts + 1):
        try:
            send()
        except Exception:
            if n == attempts:
                raise
            wait(first * 2 ** (n - 1))
        else:
            return n
    return attempts


def tenant_batches(nodes: BucketedTable, edges: BucketedTable | None, split: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]], at: Column, reject: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes all good payloads of a batch at once, each row under its own agent_id.

    split gives the nodes and the edges of the batch. Rows without tenant or id, and edges without both ends among the
    tenant's nodes, are rejected. Only the buckets of the rows are rewritten. If a write fails the batch fails, and it is
    delivered again; what was written whole is then left as it is. An end may come in a later batch than its edge:
    offered_again() takes such edges.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        new, links = split(rows)
        bad = F.col("agent_id").isNull() | F.col("id").isNull()
        reject(rows.where(bad), epoch)
        good = latest_in_batch(new.where(~bad))
        nodes.upsert(good, lambda old, new: memory.upsert_nodes(old, new, at), epoch)
        if edges is None or links is None:
            return
        links = cut_lineage(links.where(~bad))
        ends = cut_lineage(nodes.of(links.select(F.explode(F.array("source_id", "target_id")).alias("id"))).select("id", "agent_id"))
        edges.upsert(links, lambda old, new: memory.upsert_edges(old, new, ends, at)[0], epoch)
        reject(memory.upsert_edges(edges.read().limit(0), links, ends)[1], epoch)

    return batch


def offered_again(nodes: BucketedTable, edges: BucketedTable, left: DataFrame, at: Column, epoch: int | None = None) -> DataFrame:
    """Take the edges that tenant_batches() left for want of their ends, where the ends have come since; returns those that are left still."""
    left = cut_lineage(left)
    ends = cut_lineage(nodes.of(left.select(F.explode(F.array("source_id", "target_id")).alias("id"))).select("id", "agent_id"))
    edges.upsert(left, lambda old, new: memory.upsert_edges(old, new, ends, at)[0], epoch)
    return memory.upsert_edges(edges.read().limit(0), left, ends)[1]


def triage(messages: DataFrame, failed: Column, fatal: Column, most: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages that are done, that are tried again with attempts + 1, and that go to the dead-letter sink.

    The counter of attempts is a column, so it survives restarts.
    """
    tried = messages.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + failed.cast("int"))
    dead = fatal | (F.col("attempts") >= most)
    return tried.where(~failed & ~fatal), tried.where(failed & ~dead), tried.where(dead & (failed | fatal)).withColumn("reason", F.when(fatal, "fatal").otherwise("attempts"))


def latest_in_batch(batch: DataFrame, key: str = "id", order: str = "ordinal") -> DataFrame:
    return batch.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def upsert_sink(table: BucketedTable, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the buckets of a batch are rewritten, and a batch that is delivered again changes nothing."""

    def batch(rows: DataFrame, epoch: int) -> None:
        table.upsert(latest_in_batch(rows), merge, epoch)

    return batch


def active(heartbeats: DataFrame, now: Column, seconds: int = 15) -> DataFrame:
    """agent_id, last_seen of agents heard within so many seconds."""
    last = heartbeats.groupBy("agent_id").agg(F.max("ts").alias("last_seen"))
    return last.where(F.unix_micros(now) - F.unix_micros(F.col("last_seen").cast("timestamp")) <= seconds * 1_000_000)
