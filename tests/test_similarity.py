"""The threshold join by pivots, fusion by the greedy rule, and writes that keep what they must."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions.properties import merged
from loomspark.operators import memory, similarity

VECTORS = "id long, agent_id string, embedding array<double>"


def clustered(n, dims, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    return centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dims))


def pairs_of(rows, low, high=2.0):
    out = set()
    for tenant in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == tenant and r[2]]
        x = np.array([r[2] for r in own])
        n = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        s = x @ x.T
        out |= {tuple(sorted((own[i][0], own[j][0]))) for i, j in zip(*np.nonzero((s >= low) & (s <= high)), strict=True) if i != j}
    return out


@pytest.mark.parametrize(("low", "high"), [(0.95, None), (0.7, 0.9), (0.3, 0.5), (-0.2, 0.0)])
def test_pairs_brute_force(spark, low, high):
    rng = random.Random(7)
    rows = [(i, rng.choice(("t", "t", "t", "u", None)), [float(v) for v in x]) for i, x in enumerate(clustered(500, 8, 12, 0.25, 1))]
    rows += [(600 + i, "t", rows[3][2]) for i in range(60)]  # copies
    rows += [(700, "t", None), (701, "t", [0.0] * 8), (702, "lone", [1.0] * 8)]
    got = [(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame(rows, VECTORS), low, high, rows=40).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(rows, low, 2.0 if high is None else high)


def test_rows_dealt_grow_with_the_table(spark):
    def copies(n):
        rows = [(i, "t", [float(v) for v in x]) for i, x in enumerate(clustered(n, 16, n // 50, 0.05, 2))]
        return similarity.dealt(spark.createDataFrame(rows, VECTORS), 0.95, rows=50).count()

    few, many = copies(1500), copies(6000)
    assert many < 6 * few  # four times the rows; all pairs of blocks would be sixteen times
    assert many < 6000 * 6000 / 50 / 4


def test_no_rows_make_no_pairs(spark):
    assert similarity.similar_pairs(spark.createDataFrame([], VECTORS), 0.9).count() == 0


def greedy(pairs):
    gone, to = set(), {}
    for a, b, keep in sorted((min(k, d), max(k, d), k) for k, d in pairs):
        if a not in gone and b not in gone:
            drop = b if keep == a else a
            gone.add(drop)
            to[drop] = keep
    for x in to:
        while to[x] in to:
            to[x] = to[to[x]]
    return to


@pytest.mark.parametrize("seed", range(3))
def test_fusion_is_one_pass_by_id(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)} | {(100 + i, 100 + j) for i in range(9) for j in range(i)}
    rank = {i: rng.randrange(4) for i in range(200)}
    rows = [(a, b) if rank[a] >= rank[b] else (b, a) for a, b in ((min(p), max(p)) for p in pairs)]
    got = {r.id: r.canonical_id for r in memory.fuse(spark.createDataFrame(rows, "keep_id long, drop_id long")).collect()}
    assert got == greedy(rows)


def test_fusion_follows_keepers_and_takes_nothing(spark):
    frame = spark.createDataFrame([("A", "B", 0.99), ("C", "A", 0.96)], "keep_id string, drop_id string, similarity double")
    assert {r.id: r.canonical_id for r in memory.fuse(frame).collect()} == {"B": "C", "A": "C"}
    assert memory.fuse(frame.limit(0)).count() == 0


def test_upsert_keeps_what_was_learned(spark):
    schema = "id string, source_id string, target_id string, relation string, weight double, agent_id string, properties string"
    old = spark.createDataFrame([("e1", "a", "b", "KNOWS", 1.9, "t", '{"x":1}'), ("e2", "a", "b", "LIKES", 0.4, "t", None)], schema)
    new = spark.createDataFrame(
        [("e1", "a", "b", "OTHER", 1.0, "t", '{"x":2}', 1), ("e1", "a", "b", "OTHER", 1.0, "t", '{"x":3}', 2), ("e3", "b", "a", "FIRST", 0.1, "t", "{}", 1), ("e3", "b", "a", "LATER", 0.2, "t", '{"y":1}', 2), ("e4", "a", "z", "R", 1.0, "t", "{}", 1), ("e1", "a", "b", "R", 1.0, "u", "{}", 1)],
        schema + ", ordinal int")
    merged_, bad = memory.upsert_edges(old, new, spark.createDataFrame([("a", "t"), ("b", "t")], "id string, agent_id string"))
    got = sorted(tuple(r) for r in merged_.collect())
    assert got == [("e1", "a", "b", "KNOWS", 1.9, "t", '{"x":3}'), ("e2", "a", "b", "LIKES", 0.4, "t", None), ("e3", "b", "a", "FIRST", 0.1, "t", '{"y":1}')]
    assert sorted((r.id, r.agent_id) for r in bad.collect()) == [("e1", "u"), ("e4", "t")]


def test_activation_leaves_other_clocks(spark):
    old = spark.createDataFrame([("a", 0.5, 1, "2024-01-01"), ("b", 0.25, 2, "2024-01-02"), ("c", 0.1, 0, None)], "id string, energy double, retrieval_count long, last_activated_at string")
    old = old.withColumn("last_activated_at", F.col("last_activated_at").cast("timestamp"))
    got = {r.id: (r.energy, r.retrieval_count, r.at) for r in memory.activate(old, old.where("id = 'a'"), F.lit("2024-02-01").cast("timestamp")).withColumn("at", F.col("last_activated_at").cast("date").cast("string")).collect()}
    assert got == {"a": (1.0, 2, "2024-02-01"), "b": (0.25, 2, "2024-01-02"), "c": (0.1, 0, None)}


def test_bags_keep_their_kinds_through_two_merges(spark):
    rows = [('{"a":1,"tags":["x"],"o":{"p":2},"n":null,"t":true,"s":"a \\"b\\""}', '{"a":"z","f":1.5}', '{"tags":[{"k":1}],"u":null}'), (None, "[1]", '{"x":1}'), ("bad", "{}", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string, c string").select(merged(merged(F.col("a"), F.col("b")), F.col("c"))).collect()]
    assert json.loads(got[0]) == {"o": {"p": 2}, "n": None, "t": True, "s": 'a "b"', "a": "z", "f": 1.5, "tags": [{"k": 1}], "u": None}
    assert [json.loads(x) for x in got[1:]] == [{"x": 1}, {}]
