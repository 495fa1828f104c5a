"""A vector index on disk: cells of like directions, searched nearest first until no cell can hold a nearer vector.

Centroids come from a bounded sample; the table is partitioned by cell, and each cell's radius (the greatest angle to its
centroid) is kept beside it. No vector of a cell lies nearer to a query than the angle to the centroid less the radius, so
a search reads the few nearest cells, and then only those cells that this bound does not rule out for the k-th best
found: the result is exact. Only the directories of cells that some query visits are read. A write rewrites the cells
that its rows leave or enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.operators.folders import keep_schema, parts_of, replace_parts
from loomspark.operators.graph import cut_lineage
from loomspark.operators.similarity import unit

SAMPLE = 10_000  # vectors that centroids are fitted on, at most
MOST_CELLS = 1024
ROUNDS = 5
PROBE = 3  # cells that each query reads before it has a bound
QUERY_BYTES = 32 << 20  # of query vectors that go to all tasks at once, with what a task keeps for them
KEPT_BYTES = 100  # of a row that a task keeps for a query, about
ROWS_AT_ONCE, QUERIES_AT_ONCE = 1024, 1024  # of a block of scores
SLACK = 1e-9


def _centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """A few rounds of spherical k-means from rows far from each other."""
    picked, nearest = [0], sample @ sample[0]
    while len(picked) < min(cells, len(sample)) and nearest.min() < 1 - 1e-9:
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[picked[-1]])
    centres = sample[picked]
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).select("n", "radius", "cell")


class VectorIndex:
    """An index at a path of a shared store. Columns beside id and embedding (tenant, clearance) are kept for filters.

    Null vectors are not indexed; zero vectors are, in the first cell, with cosine 0 to all. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
        self.centroids = np.array(rows["centroid"].to_pylist(), np.float64).reshape(rows.num_rows, -1)

    @classmethod
    def build(cls, nodes: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        spark = nodes.sparkSession
        rows = nodes.where(F.col("embedding").isNotNull())
        n = rows.count()
        sample = unit(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()) if n else np.zeros((0, 1))
        sample = sample[(sample * sample).sum(1) > 0.5]
        centres = _centroids(sample, cells or min(MOST_CELLS, max(1, round(n**0.5)))) if len(sample) else np.zeros((1, sample.shape[1]))
        spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        index = cls(spark, path)
        placed = cut_lineage(index._placed(rows))
        keep_schema(placed, f"{path}/vectors")
        keep_schema(_cells(placed), f"{path}/cells")
        index._write(placed, [])
        return index

    def vectors(self) -> DataFrame:
        return parts_of(self.spark, f"{self.path}/vectors")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with cell and far, the angle to its centroid."""
        centres, names = self.centroids, rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = names.index("embedding")
                x = unit(b.column(at)) if b.num_rows else np.zeros((0, centres.shape[1]))
                if x.shape[1] != centres.shape[1]:
                    raise ValueError("vectors differ in length from the index")
                s = x @ centres.T
                own = s.argmax(1) if len(s) else np.zeros(0, np.int64)
                far = np.arccos(np.clip(s[np.arange(len(s)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far), pa.array(own.astype(np.int32))], [*names, "far", "cell"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.where(F.col("embedding").isNotNull()).mapInArrow(run, f"{kinds}, far double, cell int")

    def _write(self, rows: DataFrame, parts: list[int]) -> None:
        replace_parts(rows, f"{self.path}/vectors", "cell", parts)
        replace_parts(_cells(rows), f"{self.path}/cells", "cell", parts)

    def upsert(self, rows: DataFrame) -> list[int]:
        """Add rows or replace those of the same id, one row an id; returns the cells that were rewritten."""
        new = cut_lineage(self._placed(rows))
        return self._replace(rows.select("id"), new)

    def delete(self, ids: DataFrame) -> list[int]:
        """Remove ids (id); returns the cells that were rewritten."""
        return self._replace(ids.select("id"), None)

    def _replace(self, ids: DataFrame, new: DataFrame | None) -> list[int]:
        there = self.vectors().select("id", "cell").join(ids.distinct(), "id", "left_semi").select("cell")  # ids and cells only
        cells = sorted(r[0] for r in (there if new is None else there.unionByName(new.select("cell"))).distinct().collect())
        if cells:
            rest = self.vectors().where(F.col("cell").isin(cells)).join(ids, "id", "left_anti")
            self._write(cut_lineage(rest if new is None else rest.unionByName(new.select(*rest.columns))), cells)
        return cells

    def search(self, queries: DataFrame, k: int, allowed: Column | None = None, probe: int = PROBE) -> DataFrame:
        """query_id, id, score, rank: the k nearest by cosine of those allowed, for each query (query_id, vector); ties to the lesser id."""
        asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
        stats = parts_of(self.spark, f"{self.path}/cells").toPandas()  # a row a cell
        radius = np.full(len(self.centroids), -np.inf)
        radius[stats["cell"].to_numpy()] = stats["radius"].to_numpy()
        bounds = cut_lineage(self._bounds(asked, radius))
        first = F.transform(F.slice("cells", 1, probe), lambda c: c["cell"])
        found = cut_lineage(self._best(self._scan(bounds.select("query_id", "vector", first.alias("cells")), k, allowed), k))
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        more = F.filter(F.slice("cells", probe + 1, len(self.centroids)), lambda c: F.col("kth").isNull() | (c["least"] <= F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("kth")))) + SLACK))
        rest = bounds.join(kth, "query_id", "left").select("query_id", "vector", F.transform(more, lambda c: c["cell"]).alias("cells")).where("size(cells) > 0")
        return self._best(found.select("query_id", "id", "score").unionByName(self._scan(cut_lineage(rest), k, allowed)), k)

    def _bounds(self, asked: DataFrame, radius: np.ndarray) -> DataFrame:
        """query_id, vector, cells: the cells that hold vectors, by the least angle that one of them can have."""
        centres = self.centroids
        kind = asked.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            full = np.flatnonzero(radius > -np.inf)
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    q = unit(part.column(1))
                    if q.shape[1] != centres.shape[1]:
                        raise ValueError("vectors differ in length from the index")
                    least = np.maximum(0.0, np.arccos(np.clip(q @ centres[full].T, -1, 1)) - radius[full])
                    least[~q.any(1)] = 0.0  # a zero vector is as near to all
                    order = np.argsort(least, 1, kind="stable")
                    flat = pa.StructArray.from_arrays([pa.array(full[order].astype(np.int32).reshape(-1)), pa.array(np.take_along_axis(least, order, 1).reshape(-1))], ["cell", "least"])
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * len(full)), flat)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cells], ["query_id", "vector", "cells"])

        return asked.mapInArrow(run, f"query_id {kind}, vector array<double>, cells array<struct<cell:int,least:double>>")

    def _best(self, rows: DataFrame, k: int) -> DataFrame:
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return rows.withColumn("rank", best).where(F.col("rank") <= k)

    def _scan(self, visits: DataFrame, k: int, allowed: Column | None) -> DataFrame:
        """query_id, id, score: the k best of each task for each query (query_id, vector, cells); cells that none visits are not read.

        Queries go to the tasks in blocks of at most QUERY_BYTES, so any number is answered and no vector is shuffled.
        """
        n, most = visits.agg(F.count("*"), F.max(F.size("vector") + F.size("cells"))).first()
        blocks = max(1, -(-n * ((most or 0) * 8 + k * KEPT_BYTES) // QUERY_BYTES))
        parts = [self._scan_block(visits.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else visits, k, allowed) for i in range(blocks)]
        return reduce(DataFrame.unionByName, parts)

    def _scan_block(self, visits: DataFrame, k: int, allowed: Column | None) -> DataFrame:
        rows = visits.toPandas()  # at most QUERY_BYTES
        by_cell: dict[int, list[int]] = {}
        for i, cells in enumerate(rows["cells"]):
            for c in cells:
                by_cell.setdefault(int(c), []).append(i)
        vectors = np.array([np.asarray(v, np.float64) for v in rows["vector"]]) if len(rows) else np.empty((0, 0))
        held = self.spark.sparkContext.broadcast((rows["query_id"].tolist(), vectors, {c: np.array(qs, np.int32) for c, qs in by_cell.items()}))
        found = self.vectors().where(F.col("cell").isin(sorted(by_cell)))
        found = (found.where(allowed) if allowed is not None else found).select("id", "embedding", "cell")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, asking = held.value
            n = np.sqrt((vectors * vectors).sum(1, keepdims=True))
            asks = np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)
            best: dict[int, list[tuple[float, object]]] = {}
            low = np.full(len(ids), -np.inf)  # what a row must reach to be among the k best
            for b in (x.slice(i, ROWS_AT_ONCE) for x in batches for i in range(0, x.num_rows, ROWS_AT_ONCE)):
                cell = b.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    part, qs = b.take(pa.array(at)), asking[int(c)]
                    names, x = part.column(0).to_pylist(), unit(part.column(1)).T
                    for some in (qs[i : i + QUERIES_AT_ONCE] for i in range(0, len(qs), QUERIES_AT_ONCE)):
                        scores = asks[some] @ x
                        reach = np.fmax.reduce(scores, 1) >= low[some]
                        for q, row in zip(some[reach].tolist(), scores[reach], strict=True):
                            near = np.flatnonzero(row >= low[q])
                            if len(near) > k:
                                near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k]]
                            best[q] = sorted(best.get(q, []) + [(-float(row[i]), names[i]) for i in near])[:k]
                            if len(best[q]) == k:
                                low[q] = -best[q][-1][0]
            asked = list(best)
            for first in range(0, len(asked), QUERIES_AT_ONCE):
                rows_ = [(ids[q], name, -s) for q in asked[first : first + QUERIES_AT_ONCE] for s, name in best[q]]
                if rows_:
                    yield pa.RecordBatch.from_pydict({"query_id": [x[0] for x in rows_], "id": [x[1] for x in rows_], "score": [x[2] for x in rows_]})

        kinds = visits.schema["query_id"].dataType.simpleString(), found.schema["id"].dataType.simpleString()
        return found.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")
