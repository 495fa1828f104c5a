r"""Exact top-k search by largest inner product in buckets of like length.

Candidates are ranked by length over ranges and cut into buckets of BUCKET vectors, longest first. A query's k-th best
score so far, divided by its own and a bucket's greatest length, is the cosine that a vector of that bucket needs. Above
1 the bucket is left out, and all after it. A low threshold says little of single coordinates, so only the bucket's
vectors that are long enough are multiplied; a high one bounds each coordinate of a unit vector, so those within the
bounds of the query's FOCUS largest coordinates are taken from the bucket's sorted coordinates. Products of what is
left decide.

Buckets are visited in rounds, each of GROW times as many buckets as all before, and thresholds are passed from one round
to the next: a query finds about k * GROW rows a round, however many buckets there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.llm._shared import arrow_batches, prefix_sums, read, stage

BUCKET = 4096  # vectors of a bucket, fewer if they hold more than BYTES
BYTES = 1 << 24
QUERIES = 2048  # queries that one task searches a bucket for
GROW = 8
FOCUS = 3
HIGH_COSINE = 0.6  # thresholds from here on bound coordinates
STEPS = 4096  # lengths that queries are compared with to choose buckets, at most
WHOLE = 2**53  # integers under it are exact as doubles
SLACK = 1e-9


def _at_least(query: np.ndarray, norm: float, score: float, vectors: np.ndarray, norms: np.ndarray, by_axis: np.ndarray, sorted_units: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Rows of a bucket (longest first) that may reach the score, by length or by coordinates."""
    if norm == 0 or score <= 0 or not norms[0] > 0:
        return np.arange(len(norms)) if score <= 0 else np.empty(0, np.int64)
    cosine = score / (norm * norms[0]) - SLACK
    if cosine > 1:
        return np.empty(0, np.int64)
    n = int(np.searchsorted(-norms, -(score / norm) * (1 - SLACK), side="right"))
    if cosine < HIGH_COSINE:
        return np.arange(n)
    unit = query / norm
    axes = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    wide = np.sqrt(max(0.0, 1 - cosine * cosine) * np.maximum(0.0, 1 - unit[axes] ** 2)) + SLACK
    low, high = unit[axes] * cosine - wide, unit[axes] * cosine + wide
    # A unit vector of at least this cosine c >= cosine has its coordinate within u * c -/+ sqrt((1 - c^2)(1 - u^2)).
    turned = np.abs(unit[axes]) >= cosine  # there the widest bound is 1 or -1 itself
    low, high = np.where(turned & (unit[axes] < 0), -1.0 - SLACK, low), np.where(turned & (unit[axes] > 0), 1.0 + SLACK, high)
    spans = [(np.searchsorted(sorted_units[:, a], lo), np.searchsorted(sorted_units[:, a], hi, side="right")) for a, lo, hi in zip(axes, low, high, strict=True)]
    best = int(np.argmin([b - a for a, b in spans]))
    rows = by_axis[spans[best][0] : spans[best][1], axes[best]]
    rows = rows[rows < n]
    near = units[np.ix_(rows, axes)]
    return rows[((near >= low) & (near <= high)).all(1)]


def search_bucket(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[list, list, list]:
    """Query ids, vector ids and scores: each query's k best in the bucket of at least its least score (-inf: any)."""
    exact = len(vectors) and float(np.abs(vectors).max()) * float(np.abs(queries).max()) * vectors.shape[1] < WHOLE
    norms = np.sqrt((vectors * vectors).sum(1))
    order = np.argsort(-norms, kind="stable")
    ids, vectors, norms = ids[order], vectors[order], norms[order]
    units = vectors / np.where(norms > 0, norms, 1)[:, None]
    by_axis = np.argsort(units, axis=0, kind="stable")
    sorted_units = np.take_along_axis(units, by_axis, 0)
    out: tuple[list, list, list] = ([], [], [])
    for qid, q, bound in zip(query_ids, queries, least, strict=True):
        rows = _at_least(q, float(np.sqrt((q * q).sum())), bound, vectors, norms, by_axis, sorted_units, units)
        rows = rows[ids[rows] != qid]
        if not len(rows):
            continue
        near = vectors[rows] if len(rows) < len(ids) else vectors
        if exact:
            scores = near @ q
        else:  # sums beyond doubles: whole numbers, held within a long
            found = [sum(int(a) * int(b) for a, b in zip(v, q, strict=True)) for v in near]
            scores = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in found], object)
        keep = scores >= bound if exact else np.ones(len(rows), bool)
        if keep.sum() > k:
            kth = np.partition(scores[keep], keep.sum() - k)[keep.sum() - k]
            keep &= scores >= kth
        rows, scores = rows[keep], scores[keep]
        best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]  # noqa: B023
        out[0].append(np.full(len(best), qid))
        out[1].append(ids[rows[best]])
        out[2].append(np.array([int(scores[i]) for i in best], np.int64))
    return out


def whole_numbers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, in doubles; null if any component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Return query_id, rank (from 1), vec_id, score: the k largest inner products of floor(scale * x) with all rows but the query's own.

    Ties go to the smaller id. Rows with a null id or with a vector that is null or holds null or non-finite components
    take no part, nor do those of another length than most (the shorter of two equally frequent). Zero vectors take
    part. Rows that repeat an id count once, with one vector that a hash chooses. Components beyond a long are
    held at its ends, and so are scores. Fewer candidates than k give fewer rows, an empty table none. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id IS NOT NULL AND v IS NOT NULL")
    head = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = head["d"] if head else 0
    size = max(64, min(BUCKET, BYTES // (8 * max(1, dims))))
    rows = rows.where(F.size("v") == dims).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.max("asks").alias("asks"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = stage(rows.withColumn("norm", norm), "op13-vectors")
    ranked = prefix_sums(rows.select("id", "v", "norm"), [-F.col("norm"), F.col("id")], {"at": F.lit(1)}, "op13-ranges")
    buckets = stage(ranked.select("id", "v", "norm", F.floor(F.col("at") / size).alias("bucket")), "op13-buckets")
    n_buckets = -(-rows.count() // size)
    state = stage(rows.where("asks").select("id", "v", "norm", F.lit(None).cast("double").alias("least")), "op13-queries")
    # The greatest lengths of every step-th bucket, a bounded list; a query visits whole steps, and a task leaves out the rest.
    step = max(1, -(-n_buckets // STEPS))
    tops = buckets.where(F.col("bucket") % step == 0).groupBy("bucket").agg(F.max("norm").alias("top")).orderBy("bucket").toPandas()["top"].to_numpy()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found, begin, end = None, 0, 1
    while begin < n_buckets or found is None:
        new = _round(state, buckets, tops, step, begin, min(end, n_buckets), k)
        both = new if found is None else found.unionByName(new)
        found = stage(both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "vec_id", "score"), "op13-found")
        kth = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
        if end < n_buckets:
            state = stage(state.drop("least").join(kth, "id", "left").select("id", "v", "norm", "least"), "op13-queries")
        begin, end = end, end * (1 + GROW)
    return found.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")


def _round(state: DataFrame, buckets: DataFrame, tops: np.ndarray, step: int, begin: int, end: int, k: int) -> DataFrame:
    """What the queries find in the buckets from begin to before end that are long enough for their threshold."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm, least = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            least = np.where(np.isnan(least), -np.inf, least)
            need = np.where(least > 0, least / np.where(norm > 0, norm, 1) * (1 - SLACK), -np.inf)
            steps = np.searchsorted(-tops, -need, side="right")  # tops fall, so buckets are a prefix
            upto = np.minimum(steps * step, end)
            counts = np.maximum(upto - begin, 0)
            for at in range(0, b.num_rows, 64):  # a query is repeated for each of its buckets, so few at a time
                n = counts[at : at + 64]
                row = pa.array(np.repeat(np.arange(at, at + len(n)), n))
                bucket = np.concatenate([np.arange(begin, begin + x) for x in n]) if len(n) else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array(least[at : at + 64]).take(pa.array(np.repeat(np.arange(len(n)), n)))], ["bucket", "q", "qv", "least"])

    asked = stage(state.select("id", "v", "norm", "least").mapInArrow(visits, "bucket long, q long, qv array<double>, least double"), "op13-visits")
    loads = stage(asked.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).alias("salts")), "op13-loads")
    left = buckets.where((F.col("bucket") >= begin) & (F.col("bucket") < end)).join(loads, "bucket")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("bucket", "salt", "id", "v")
    right = asked.join(loads, "bucket").select(F.col("bucket").alias("bucket_"), F.pmod(F.xxhash64("q"), F.col("salts")).alias("salt_"), "q", "qv", "least")

    def both(bucket: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list, list, list] = ([], [], [])
        if len(bucket) and len(asks):
            found = search_bucket(bucket["id"].to_numpy(), np.stack(bucket["v"].to_numpy()), asks["q"].to_numpy(), np.stack(asks["qv"].to_numpy()), asks["least"].to_numpy(), k)
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), joined, strict=True)))

    return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket_", "salt_")).applyInPandas(both, "query_id long, vec_id long, score long")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer products of each vector whose id is divisible by 50."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS r
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
