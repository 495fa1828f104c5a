"""Time series, audit and benchmark statistics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.operators.graph import cut_lineage


def hourly(events: DataFrame, start: str, end: str, key: str = "user_id") -> DataFrame:
    """hour, key, n, total, mean of value in [start, end)."""
    rows = events.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return rows.groupBy(F.date_trunc("HOUR", "ts").alias("hour"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def summary(events: DataFrame, workflow: str = "user_id") -> DataFrame:
    """workflow, first_type (of the earliest event), first_ts, last_ts, n."""
    return events.groupBy(workflow).agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def audit(events: DataFrame, who: int | None = None, start: str | None = None, end: str | None = None, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Events of one workflow within [start, end] and of the kinds, by time."""
    for condition in (
        None if who is None else F.col("user_id") == who, None if start is None else F.col("ts") >= F.lit(start).cast("timestamp"),
        None if end is None else F.col("ts") <= F.lit(end).cast("timestamp"), F.col("event_type").isin(*kinds) if kinds else None,
    ):
        events = events if condition is None else events.where(condition)
    events = events.orderBy("ts", "event_id")
    return events.limit(limit) if limit else events


def rate_limit(events: DataFrame, limit: int = 60, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """event_id, used (requests of the key in the open window before, denied ones too), allowed, remaining."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = W.partitionBy(key).orderBy("_t").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    used = F.count("*").over(span) - 1
    rows = events.withColumn("_t", micros).withColumn("used", used)
    return rows.select("event_id", key, "used", (F.col("used") < limit).alias("allowed"), F.greatest(F.lit(0), limit - F.col("used") - 1).alias("remaining"))


def due(agents: DataFrame, now: Column, key: str = "agent_id") -> DataFrame:
    """Agents with an interval that never ran, or whose last run is at least interval_hours old."""
    old = F.col("last_run").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_run") >= F.col("interval_hours") * 3600)
    return agents.where((F.col("interval_hours") > 0) & old).select(key)


def latest_runs(runs: DataFrame, keys: list[str], by: str) -> DataFrame:
    return runs.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by), F.desc("run_id")))).where("_r = 1").drop("_r")


def until_budget(rows: DataFrame, size: str, budget: int, order: list[Column]) -> DataFrame:
    """Rows in the order, up to and with the one that reaches the budget of their sizes; with before, the sum of those in front.

    Rows are dealt by range of the order, and totals of the ranges (a row each) give each range its start; only
    ranges that begin under the budget are sorted.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = cut_lineage(rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*[F.col(k) for k in keys]).withColumn("_pid", F.spark_partition_id()))
    totals = dealt.groupBy("_pid").agg(F.sum(size).alias("_t"))
    starts = totals.select("_pid", F.coalesce(F.sum("_t").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start")).where(F.col("_start") < budget)
    own = dealt.join(F.broadcast(starts), "_pid")  # as many rows as there are partitions
    within = F.coalesce(F.sum(size).over(W.partitionBy("_pid").orderBy(*[F.col(k) for k in keys]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("before", F.col("_start") + within).where(F.col("before") < budget).drop("_pid", "_start", *keys)


PRIME = 2_147_483_647
#: x of a draw from 0 to PRIME - 1 stands for as many copies of a task as there are limits up to x: the Poisson law of mean 1.
COPIES = tuple(math.floor(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(10))


def drawn(resample, task, seed: int):  # noqa: ANN001, ANN201
    """A number from 0 to PRIME - 1 for whole numbers resample and task under PRIME (arrays too), the same in any engine of 64-bit integers."""
    b, i = resample + 1, task + 1
    x = (b * 1_103_515_245 + i * 12_345 + seed) % PRIME
    y = (x * x + i * 69_621) % PRIME
    z = (y * y + b * 48_271) % PRIME
    return (z * z + x) % PRIME


def bootstrap(scores: DataFrame, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """arm, mean, low, high: the mean of task means and its 95 % interval by resampling tasks. scores (arm, task, score).

    A resample takes each task as often as a Poisson variable of mean 1 says, which a hash of (resample, task) gives; so
    tasks need no numbers, and a task of Spark adds its rows to one vector of sums an arm as they pass. What is shuffled is
    a row for each arm and resample. Resamples without any task are left out.
    """
    tasks = scores.groupBy("arm", "task").agg(F.avg("score").alias("m"))
    code = F.conv(F.substring(F.md5(F.coalesce(F.col("task").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") % PRIME
    kind = scores.schema["arm"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        numbers, limits = np.arange(resamples, dtype=np.int64), np.array(COPIES)
        for batch in batches:
            for arm, i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = np.searchsorted(limits, drawn(numbers, i, seed), side="right")
                held = sums.setdefault(arm, np.zeros((2, resamples)))
                held[0] += w * m
                held[1] += w
        for arm, (total, copies) in sums.items():
            yield pa.RecordBatch.from_pydict({"arm": [arm] * resamples, "b": numbers, "total": total, "copies": copies}, schema=None)

    drawn_rows = tasks.where("m IS NOT NULL").select("arm", code.alias("i"), "m").mapInArrow(run, f"arm {kind}, b long, total double, copies double")
    means = drawn_rows.groupBy("arm", "b").agg(F.sum("total").alias("total"), F.sum("copies").alias("copies")).where("copies > 0").select("arm", "b", (F.col("total") / F.col("copies")).alias("m"))
    ranked = means.withColumns({"r": F.row_number().over(W.partitionBy("arm").orderBy("m", "b")) - 1, "n": F.count("*").over(W.partitionBy("arm"))})  # as many rows an arm as resamples
    at = lambda q: F.max(F.when(F.col("r") == F.floor(F.col("n") * q), F.col("m")))
    ends = ranked.groupBy("arm").agg(at(0.025).alias("low"), at(0.975).alias("high"))
    return tasks.groupBy("arm").agg(F.avg("m").alias("mean")).join(ends, "arm")


def paired_lift(scores: DataFrame, arm: str, base: str, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """The bootstrap of arm - base per task, and whether the interval leaves out 0."""
    tasks = scores.groupBy("arm", "task").agg(F.avg("score").alias("m"))
    a, b = tasks.where(F.col("arm") == arm).select("task", F.col("m").alias("a")), tasks.where(F.col("arm") == base).select("task", F.col("m").alias("b"))
    diffs = a.join(b, "task").select(F.lit(f"{arm} - {base}").alias("arm"), "task", (F.col("a") - F.col("b")).alias("score"))
    return bootstrap(diffs, resamples, seed).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def set_scores(found: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays of names as sets in any case, to three places; nothing found has precision 0, nothing expected recall 1."""
    a, b = (F.array_distinct(F.transform(c, F.lower)) for c in (found, expected))
    hits = F.size(F.array_intersect(a, b))
    precision = F.when(F.size(a) > 0, hits / F.size(a)).otherwise(F.lit(0.0))
    recall = F.when(F.size(b) > 0, hits / F.size(b)).otherwise(F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return F.round(precision, 3), F.round(recall, 3), F.round(f1, 3)


def run_costs(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """runs with cost: tokens in and out, the back end's too, by the prices a million tokens of (provider, model); unknown models cost 0."""
    tokens = lambda side: F.coalesce(F.col(f"tokens_{side}"), F.lit(0)) + F.coalesce(F.col(f"backend_tokens_{side}"), F.lit(0))
    price = lambda side: F.coalesce(F.col(f"price_{side}"), F.lit(0.0))
    both = runs.join(F.broadcast(prices), ["provider", "model"], "left")  # one row a model
    return both.withColumn("cost", tokens("in") / 1e6 * price("in") + tokens("out") / 1e6 * price("out")).drop("price_in", "price_out")


def due_connectors(connectors: DataFrame, states: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """connector_id of enabled connectors that never ran, or whose last run is at least so old."""
    both = connectors.where("enabled").join(states.select("connector_id", "last_run"), "connector_id", "left")
    return both.where(F.col("last_run").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_run") >= seconds)).select("connector_id").distinct()


def state_hashes(nodes: DataFrame, by: str) -> DataFrame:
    """by, hash: 16 hex digits of each group's set of ids (texts), alike in any order: of its JSON list with ', ' between.

    A task hashes the sorted ids of a group as they pass, so a group of any size takes no more memory than a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, state = None, None, None
        done: list[tuple[str, str]] = []

        def end() -> None:
            state.update(b"]")
            done.append((key, state.hexdigest()[:16]))

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or k != key:
                    if state is not None:
                        end()
                    key, last, state = k, None, hashlib.sha256(b"[")
                if x != last:
                    state.update(((", " if last is not None else "") + f'"{x}"').encode())
                    last = x
        if state is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], [by, "hash"])

    return nodes.select(by, "id").repartition(by).sortWithinPartitions(by, "id").mapInArrow(run, f"{by} string, hash string")
