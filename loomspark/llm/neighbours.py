"""Approximate nearest neighbours by largest inner product: stable projections, a kd-tree and a chi-square stop.

Vectors are scaled by the largest norm and given one more coordinate that makes their norms 1, so that the largest
inner product is the least distance. A fixed Gaussian matrix projects them to DIMS dimensions, where a squared
projected distance over the squared distance follows a chi-square law. A kd-tree over the projected space, its upper
part grown from a bounded sample, deals all vectors into blocks; within a block leaves are met in the order of their
projected distance and their points verified by the true inner product, until a chi-square test says that a nearer
point would have been met already with probability CONFIDENCE. Queries search their own block first; what they find
there decides by the same test which other blocks they visit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.llm._shared import arrow_batches, hash_sample, read, stage

DIMS = 8
CONFIDENCE = 0.97
SAMPLE = 10_000  # vectors that the tree's upper part is grown from, about; never twice as many
BLOCK = 4096  # vectors of a block, about
LEAF = 64
QUERIES = 2048  # queries searched in a block by one task
SEED = 20


def chi_square_limit(dims: int, p: float) -> float:
    """The value that a chi-square variable of an even number of dimensions stays under with probability p."""

    def under(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if under(middle) < p else (low, middle)
    return high


def directions(n: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((n, dims))


def cut_tree(points: np.ndarray, leaves: int) -> list:
    """Nested [axis, limit, low, high] with leaves numbered from 0, cut at medians of the widest axis."""
    number = iter(range(1 << 62))

    def grow(p: np.ndarray, n: int) -> list | int:
        if n <= 1 or len(p) < 2:
            return next(number)
        axis = int(np.argmax(p.max(0) - p.min(0)))
        limit = float(np.quantile(p[:, axis], (n // 2) / n))
        low = p[:, axis] <= limit
        if low.all() or not low.any():
            return next(number)
        return [axis, limit, grow(p[low], n // 2), grow(p[~low], n - n // 2)]

    return [grow(points, leaves)]


def leaf_of(tree: list, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)

    def walk(node: list | int, rows: np.ndarray) -> None:
        if isinstance(node, int):
            out[rows] = node
        elif len(rows):
            low = points[rows, node[0]] <= node[1]
            walk(node[2], rows[low])
            walk(node[3], rows[~low])

    walk(tree[0], np.arange(len(points)))
    return out


def _leaves(points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The rows of each leaf of a block's own tree, and the corners of the leaves' boxes."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        p = points[rows]
        spread = p.max(0) - p.min(0)
        if len(rows) <= LEAF or not spread.max() > 0:
            out.append(rows)
            continue
        axis = int(np.argmax(spread))
        order = np.argsort(p[:, axis], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out, np.array([points[r].min(0) for r in out]), np.array([points[r].max(0) for r in out])


def _gap(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a projected query from boxes."""
    return (np.maximum(0, np.maximum(low - query, query - high)) ** 2).sum(-1)


def hulls(tree: list, low: dict[int, np.ndarray], high: dict[int, np.ndarray]) -> tuple | None:
    """The tree as nested (low, high, children or block): boxes of the blocks' own corners, without empty blocks."""

    def grow(node: list | int) -> tuple | None:
        if isinstance(node, int):
            return (low[node], high[node], node) if node in low else None
        sides = [x for x in (grow(node[2]), grow(node[3])) if x]
        return (np.min([x[0] for x in sides], 0), np.max([x[1] for x in sides], 0), sides) if sides else None

    return grow(tree[0])


def visits(hull: tuple | None, points: np.ndarray, reach: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(rows of points, block) for all blocks whose box lies within a point's reach, by walking down the tree."""
    out: list[tuple[np.ndarray, int]] = []
    todo = [(hull, np.arange(len(points)))] if hull else []
    while todo:
        (low, high, below), rows = todo.pop()
        rows = rows[_gap(points[rows], low, high) < reach[rows]]
        if len(rows):
            if isinstance(below, int):
                out.append((rows, below))
            else:
                todo += [(x, rows) for x in below]
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_points: np.ndarray, bounds: np.ndarray, top_norm: float, k: int, limit: float) -> tuple[list, list, list]:
    """Query ids, vector ids and scores of each query's k nearest in the block that are not farther than its bound (a score)."""
    rows, low, high = _leaves(projected)
    out: tuple[list, list, list] = ([], [], [])
    for qid, q, point, bound in zip(query_ids, queries, query_points, bounds, strict=True):
        norm = float(np.sqrt((q * q).sum()))
        scale = norm * top_norm
        far = lambda score: max(0.0, 2 - 2 * score / scale) * (1 + 1e-9) + 1e-12  # noqa: B023, E731
        gaps = _gap(point, low, high)
        order = np.argsort(gaps, kind="stable")
        found_rows, found = np.empty(0, np.int64), np.empty(0)
        kth, at, step = bound, 0, 1
        while at < len(order) and (kth == -np.inf or gaps[order[at]] < limit * far(kth)):
            near = np.concatenate([rows[i] for i in order[at : at + step]])
            at, step = at + step, step * 2
            if kth > -np.inf:
                near = near[((projected[near] - point) ** 2).sum(1) < limit * far(kth)]
            near = near[ids[near] != qid]
            scores = vectors[near] @ q
            keep = scores >= kth - 1e-9 * scale if kth > -np.inf else slice(None)
            found_rows, found = np.concatenate([found_rows, near[keep]]), np.concatenate([found, scores[keep]])
            if len(found) > k:
                kth = max(kth, float(np.partition(found, len(found) - k)[len(found) - k]))
                keep = found >= kth - 1e-9 * scale
                found_rows, found = found_rows[keep], found[keep]
            elif len(found) == k:
                kth = max(kth, float(found.min()))
        if len(found_rows):
            exact = (vectors[found_rows] * q).sum(axis=1)  # summed alike for equal vectors, so ties are ties
            best = np.lexsort((ids[found_rows], -exact))[:k]
            out[0].append(np.full(len(best), qid))
            out[1].append(ids[found_rows[best]])
            out[2].append(exact[best])
    return out


def valid(vector: Column) -> Column:
    """Not null, not all zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """Return query_id, rank (from 1), vec_id, score: the k nearest found of all rows but the query's own, by inner product in double precision.

    Ties go to the smaller id. Rows with a null id or with a vector that is null, empty, zero or holds null or
    non-finite components take no part, nor do those of another length than most (the shorter of two equally
    frequent). Of equal vectors only the k + 1 least ids can come among the k nearest of any query, so only those are
    searched as candidates. Rows that repeat an id count once. Fewer candidates than k give fewer rows, an empty
    table none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("v")))
    norms = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"))
    head = norms.orderBy(F.desc("n"), "d").first()
    dims, n_rows, top_norm = (head["d"], head["n"], math.sqrt(head["most"])) if head else (1, 0, 1.0)
    rows = rows.where(F.size("v") == dims).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.max("asks").alias("asks"))
    by_vector = W.partitionBy("v").orderBy("id")
    matrix, limit = directions(dims + 1), chi_square_limit(DIMS, confidence)

    def project(v: np.ndarray, asks: bool) -> np.ndarray:
        norms = np.sqrt((v * v).sum(1))
        unit = v / norms[:, None] if asks else v / top_norm
        last = np.zeros(len(v)) if asks else np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))
        return unit @ matrix[:-1] + last[:, None] * matrix[-1]

    stacked = lambda c: np.array(c.to_pylist(), np.float64).reshape(len(c), -1)
    sample = hash_sample(rows.select("id", "v"), "id", SAMPLE).toPandas()
    blocks = max(1, -(-n_rows // BLOCK))
    tree = cut_tree(project(np.stack(sample.sort_values("id")["v"].to_numpy()), False), blocks) if len(sample) else [0]

    def place(asks: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = project(stacked(b.column(1)), asks) if b.num_rows else np.empty((0, DIMS))
                at = leaf_of(tree, p)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * DIMS), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(at)], ["id", "v", "p", "block"])

        return run

    schema = "id long, v array<double>, p array<double>, block int"
    candidates = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).select("id", "v")
    candidates = stage(candidates.mapInArrow(place(False), schema), "op9-vectors")
    corners = [F.struct(*[f(F.col("p")[i]).alias(f"x{i}") for i in range(DIMS)]).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    # A block that came out larger than planned is cut by id; blocks grow in number with the vectors, not in size.
    boxes = stage(candidates.groupBy("block").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"), *corners), "op9-boxes")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    parted = candidates.join(boxes.select("block", "parts"), "block").withColumn("part", part)
    queries = stage(rows.where("asks").select("id", "v").mapInArrow(place(True), schema).withColumn("bound", F.lit(float("-inf"))), "op9-queries")

    def visited(asked: DataFrame) -> DataFrame:
        """What queries (id, v, p, bound, block) find in their block."""
        loads = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
        left = parted.join(loads, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        left = left.select(*[F.col(c).alias(c) for c in ("block", "part", "salt", "id", "v", "p")])
        right = asked.join(loads, "block").join(boxes.select("block", "parts"), "block").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*[F.col(c).alias(f"{c}_") for c in ("block", "part", "salt", "id", "v", "p", "bound")])

        def both(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            found: tuple[list, list, list] = ([], [], [])
            if len(block) and len(asks):
                found = search_block(
                    block["id"].to_numpy(), np.stack(block["v"].to_numpy()), np.stack(block["p"].to_numpy()),
                    asks["id_"].to_numpy(), np.stack(asks["v_"].to_numpy()), np.stack(asks["p_"].to_numpy()), asks["bound_"].to_numpy(), top_norm, k, limit,
                )
            joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), joined, strict=True)))

        return left.groupBy("block", "part", "salt").cogroup(right.groupBy("block_", "part_", "salt_")).applyInPandas(both, "query_id long, vec_id long, score double")

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = stage(visited(queries).withColumn("rank", rank).where(F.col("rank") <= k), "op9-first")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    own = queries.join(kth, "id", "left").select("id", "v", "p", F.col("block").alias("home"), F.coalesce("kth", "bound").alias("bound"))
    corner = boxes.toPandas()  # a row a leaf of the tree, so bounded by the sample
    corners_of = lambda c: {b: np.array([x[f"x{i}"] for i in range(DIMS)]) for b, x in zip(corner["block"], corner[c], strict=True)}
    hull = hulls(tree, corners_of("low"), corners_of("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, home, bound = stacked(b.column(1)), b.column(3).to_numpy(), b.column(4).to_numpy()
            far = np.maximum(0.0, 2 - 2 * bound / (np.sqrt((v * v).sum(1)) * top_norm)) * (1 + 1e-9) * limit
            met = visits(hull, stacked(b.column(2)), np.where(bound == -np.inf, np.inf, far))
            for rows, block in met:
                rows = rows[home[rows] != block]
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(4), pa.array(np.full(len(rows), block, np.int32))], ["id", "v", "p", "bound", "block"])

    onward = own.select("id", "v", "p", "home", "bound").mapInArrow(run, "id long, v array<double>, p array<double>, bound double, block int")
    found = first.select("query_id", "vec_id", "score").unionByName(visited(stage(onward, "op9-onward"))) if blocks > 1 else first.select("query_id", "vec_id", "score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each whose id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings")
    return search(rows, F.col("vec_id") % 20 == 0)
