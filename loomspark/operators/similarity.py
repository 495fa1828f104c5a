"""Exact cosine-threshold self-join by pivots.

Angles are a metric. A bounded sample gives pivots; a vector's home is the cell of its nearest pivot. Two vectors within
the angle t of each other lie in one cell, or one of them lies within t of the other's cell: within t of the great circle
halfway between both pivots, and within t of the cell's radius. So a vector visits only cells of a higher number that
can hold a partner, and pairs are formed within a cell: home with home, visitor with home. A cell of more than a block
of vectors is dealt into parts, and parts meet as matrix products of strips, so no task holds more than two blocks and
a strip. Vectors of which each component is a float are dealt as floats: the same values in half the bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.operators.graph import cut_lineage

BLOCK_ROWS = 2048  # vectors of a part, about
PART_ROWS = 4 * BLOCK_ROWS  # of this join: each row goes to as many parts as its cells have, so a fourth of the parts is a fourth of the shuffle
STRIP_ROWS = 512  # of a product
MOST_PIVOTS = 2048
SAMPLE = 4
BROADCAST_CELLS = 100_000
SLACK = 1e-9


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1; zero vectors stay zero."""
    lengths = pc.unique(pc.list_value_length(vectors))
    if vectors.null_count or len(lengths) > 1:
        raise ValueError("vectors differ in length")
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1 if len(vectors.flatten()) else 0)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _pivots(nodes: DataFrame, n: int) -> np.ndarray:
    """At most n directions far from each other, of a sample of at most SAMPLE * n rows that a hash of the id chooses.

    Each next one is the farthest from those before, so that groups get a pivot before a group gets two.
    """
    rows = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * n).select("embedding").toArrow()["embedding"].combine_chunks()
    x = unit(rows) if len(rows) else np.empty((0, 1))
    x = x[(x * x).sum(1) > 0.5]
    nearest, picked = np.full(len(x), -2.0), []
    while len(picked) < n and len(x):
        at = int(np.argmin(nearest)) if picked else 0
        if picked and nearest[at] > 1 - 1e-12:
            break  # all others are copies
        picked.append(at)
        nearest = np.maximum(nearest, x @ x[at])
    return x[picked]


def dealt(nodes: DataFrame, low: float, by: str = "agent_id", rows: int = PART_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """(by, cell, i, j, part, id, embedding, *carry): each row as often as parts of its cells meet it; its group is by, cell, i, j.

    Null vectors take no part. Tenants of no more than a block are one cell and need no pivots.
    """
    nodes = nodes.where(F.col("embedding").isNotNull()).select(by, "id", "embedding", *carry)
    if nodes.schema["embedding"].dataType == T.ArrayType(T.DoubleType()) and nodes.where(F.exists("embedding", lambda x: x != x.cast("float").cast("double"))).isEmpty():
        nodes = nodes.withColumn("embedding", F.col("embedding").cast("array<float>"))
    sizes = cut_lineage(nodes.groupBy(by).agg(F.count("*").alias("n")))
    small_ones = lambda df: F.broadcast(df) if df.count() <= BROADCAST_CELLS else df
    large = sizes.where(F.col("n") > rows).select(F.col(by).alias("_by"), F.lit(True).alias("large"))
    total = sizes.where(F.col("n") > rows).agg(F.sum("n")).first()[0] or 0
    marked = nodes.join(small_ones(large), F.col(by).eqNullSafe(F.col("_by")), "left").select(nodes[by], "id", "embedding", F.coalesce("large", F.lit(False)).alias("large"), *carry)
    pivots = _pivots(marked.where("large"), min(MOST_PIVOTS, -(-total // rows))) if total else np.empty((0, 0))
    angle = math.acos(min(1.0, max(-1.0, low))) + SLACK
    held = nodes.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        between = 2 - 2 * p @ p.T if len(p) else None  # squared distances of pivots
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                n = part.num_rows
                row, cell, home, far = [np.arange(n)], [np.zeros(n, np.int32)], [np.ones(n, bool)], [np.zeros(n)]
                wide = np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False)) if len(p) else np.empty(0, np.int64)
                if len(wide):
                    x = unit(part.column(2).take(pa.array(wide)))
                    if x.shape[1] != p.shape[1]:
                        raise ValueError("vectors differ in length")
                    s = x @ p.T
                    own = s.argmax(1)
                    cell[0][wide] = own
                    far[0][wide] = np.arccos(np.clip(s[np.arange(len(wide)), own], -1, 1))
                    # The sine of the angle to the circle halfway between the pivots of home and of another cell.
                    gap = (s[np.arange(len(wide)), own][:, None] - s) / np.sqrt(np.maximum(between[own], 1e-18))
                    near = (gap <= (math.sin(angle) if angle < math.pi / 2 else 2.0) + SLACK) & (np.arange(len(p))[None] > own[:, None])
                    r, c = np.nonzero(near)
                    row, cell, home = [*row, wide[r]], [*cell, c.astype(np.int32)], [*home, np.zeros(len(r), bool)]
                    far.append(np.arccos(np.clip(s[r, c], -1, 1)))
                rows_ = pa.array(np.concatenate(row))
                columns = [part.column(0).take(rows_), part.column(1).take(rows_), part.column(2).take(rows_), pa.array(np.concatenate(cell)), pa.array(np.concatenate(home)), pa.array(np.concatenate(far)), *[part.column(c).take(rows_) for c in carry]]
                yield pa.RecordBatch.from_arrays(columns, ["by_", "id", "embedding", "cell", "home", "far", *carry])

    kinds = [nodes.schema[c].dataType.simpleString() for c in (by, "id", "embedding", *carry)]
    carried = "".join(f", {c} {kind}" for c, kind in zip(carry, kinds[3:], strict=True))
    placed = marked.mapInArrow(place, f"by_ {kinds[0]}, id {kinds[1]}, embedding {kinds[2]}, cell int, home boolean, far double{carried}")
    placed = cut_lineage(placed.withColumn("by_", F.struct(F.col("by_").alias("v"))))  # a null tenant is a tenant
    cells = placed.where("home").groupBy("by_", "cell").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    cells = small_ones(cut_lineage(cells))
    met = placed.join(cells, ["by_", "cell"]).where(F.col("home") | (F.col("far") <= F.col("radius") + angle))
    guests = met.where("not home").groupBy("by_", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("guests"))
    met = met.join(small_ones(cut_lineage(guests)), ["by_", "cell"], "left").withColumn("guests", F.coalesce("guests", F.lit(0)))
    part = F.when(F.col("home"), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.col("parts") + F.pmod(F.xxhash64("id"), F.greatest("guests", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("home"), F.col("parts") + F.col("guests")).otherwise(F.col("parts")) - 1)
    met = met.withColumn("part", part).withColumn("_o", F.explode(others))
    return met.select(F.col("by_.v").alias(by), "cell", F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j"), "part", "id", "embedding", *carry)


def _linked(rows: pa.ListArray, columns: pa.ListArray) -> np.ndarray:
    """Which row and column have a value of their lists in common."""
    out = np.zeros((len(rows), len(columns)), bool)
    sides = [(np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())), x.flatten()) for x in (rows, columns)]
    codes = pc.dictionary_encode(pa.concat_arrays([v for _, v in sides])).indices.to_numpy()
    (r, _), (c, _) = sides
    of_rows, of_columns = codes[: len(r)], codes[len(r) :]
    both = np.intersect1d(of_rows, of_columns)
    at_r, at_c = np.argsort(of_rows, kind="stable"), np.argsort(of_columns, kind="stable")
    ends = [np.searchsorted(codes_[at], both, side) for codes_, at in ((of_rows, at_r), (of_columns, at_c)) for side in ("left", "right")]
    for r0, r1, c0, c1 in zip(*ends, strict=True):
        out[np.ix_(r[at_r[r0:r1]], c[at_c[c0:c1]])] = True
    return out


def similar_pairs(nodes: DataFrame, low: float, high: float | None = None, by: str = "agent_id", rows: int = PART_ROWS) -> DataFrame:
    """a, b (a before b), similarity: all pairs of one tenant with cosine in [low, high]. Null vectors take no part; a null tenant is a tenant.

    Rows go only to the cells where a partner can be (see dealt), so what is shuffled grows with the pairs near each
    other, not with the square of the tenant, unless vectors lie in no groups at all or low asks for little.
    """
    return tenant_pairs(nodes, low, high, by, rows).select("a", "b", "similarity")


def tenant_pairs(nodes: DataFrame, low: float, high: float | None = None, by: str = "agent_id", rows: int = PART_ROWS, apart: DataFrame | None = None) -> DataFrame:
    """by, a, b, similarity: similar_pairs with their tenant, and without those that apart rules out.

    apart (id, near, far: arrays of ids) goes along with the vectors: a pair is ruled out where a value of one's near is in the
    other's far. So pairs, of which there can be many more than nodes, are neither shuffled nor stored for it.
    """
    kind, tenant = nodes.schema["id"].dataType.simpleString(), nodes.schema[by].dataType.simpleString()
    carry = ("near", "far_") if apart is not None else ()
    if apart is not None:
        nothing = F.array().cast(f"array<{kind}>")
        nodes = nodes.select(by, "id", "embedding").join(apart.select("id", "near", F.col("far").alias("far_")), "id", "left").withColumns({c: F.coalesce(c, nothing) for c in carry})

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        ids, part, x = group["id"].combine_chunks(), group["part"].to_numpy(), unit(group["embedding"].combine_chunks())
        rank = np.unique(np.array(ids.to_pylist()), return_inverse=True)[1]
        lists = [group[c].combine_chunks() for c in carry]
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        for at in range(0, len(left), STRIP_ROWS):
            p0 = left[at : at + STRIP_ROWS]
            q0 = right[at:] if i == j else right  # of one part each pair comes once: a later row with an earlier one
            s = x[p0] @ x[q0].T
            near = (s >= low - 1e-12) & ((s <= high + 1e-12) if high is not None else True)
            if i == j:
                near &= np.arange(len(q0))[None] > np.arange(len(p0))[:, None]
            if lists and near.any():
                mine, yours = ([x.take(pa.array(k)) for x in lists] for k in (p0, q0))
                near &= ~(_linked(mine[0], yours[1]) | _linked(mine[1], yours[0]))
            p, q = np.nonzero(near)
            s = s[p, q]
            p, q = p0[p], q0[q]
            keep = rank[p] != rank[q]
            p, q, s = p[keep], q[keep], s[keep]
            swap = rank[p] > rank[q]
            a, b = ids.take(pa.array(np.where(swap, q, p))), ids.take(pa.array(np.where(swap, p, q)))
            yield pa.RecordBatch.from_arrays([pa.repeat(group[by][0], len(s)), a, b, pa.array(s, pa.float64())], [by, "a", "b", "similarity"])

    return dealt(nodes, low, by, rows, carry).groupBy(by, "cell", "i", "j").applyInArrow(both, f"{by} {tenant}, a {kind}, b {kind}, similarity double")
