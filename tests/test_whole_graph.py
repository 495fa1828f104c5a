"""Algorithms over whole graphs: what they shuffle, and graphs of odd shapes against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import graph
from loomspark.plans import registry

SF = "/root/testdata/sf0.01"  # 76,000 edges


def shuffled(spark, name):
    """Bytes that the query writes to shuffles for an edge of the tables."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = total()
    registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    return (total() - before) / 76_000


def plain_components(nodes, edges):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a in up and b in up:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def test_components_shuffle_little(spark):
    assert shuffled(spark, "connected_components") < 30


@pytest.mark.parametrize("shape", ["sparse", "path", "strange", "none"])
def test_components_of_odd_graphs(spark, shape):
    draw = random.Random(5)
    nodes = list(range(400))
    edges = {
        "sparse": [(draw.randrange(400), draw.randrange(400)) for _ in range(190)] + [(7, 7), (3, 4), (4, 3), (3, 4)],
        "path": [(i, i + 1) for i in range(399) if i % 150 != 149],
        "strange": [(1, 900), (900, 2), (901, 3), (5, 6), (902, 903)],  # ends of 900 and more are no nodes
        "none": [],
    }[shape]
    got = graph.components(spark.createDataFrame([(x,) for x in nodes], "id long"), spark.createDataFrame(edges + [(None, 1), (2, None)], "source_id int, target_id int"))
    assert {r.id: r.component for r in got.collect()} == plain_components(nodes, edges)


def test_nodes_of_one_hash_stay_apart(spark, monkeypatch):
    real = F.xxhash64

    def few(*cols):  # with the first salt, all ids are one
        return F.when(cols[-1] == 0, F.lit(1).cast("long")).otherwise(real(*cols))

    monkeypatch.setattr(graph.F, "xxhash64", few)
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    known, pairs = graph.numbered(nodes, spark.createDataFrame([("a", "b")], "source_id string, target_id string"))
    assert known.select("n").distinct().count() == 4 and pairs.join(known, F.col("u") == F.col("n")).first().id == "a"


@pytest.mark.parametrize(("name", "most"), [("pagerank_fixed_iter", 65), ("dpo_pairs", 67)])
def test_shuffled_without_broadcasts(spark, name, most):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of 1 GB are joined
    try:
        assert shuffled(spark, name) < most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_pagerank_with_a_hub_strange_ends_and_parallel_edges(spark):
    edges = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(1, 1400, 7)] + [(3, 0), (3, 0), (5, 9000), (9001, 4), (8, 8)]
    got = graph.pagerank(spark.range(1500).select("id"), spark.createDataFrame(edges, "source_id long, target_id long"), 4)
    targets = {}
    for a, b in set(edges):
        targets.setdefault(a, []).append(b)
    ranks = dict.fromkeys(range(1500), 1 / 1500)
    for _ in range(4):
        lost = sum(r for i, r in ranks.items() if i not in targets)
        after = dict.fromkeys(ranks, 0.15 / 1500 + 0.85 * lost / 1500)
        for a, bs in targets.items():
            for b in bs:
                if a in ranks and b in ranks:
                    after[b] += 0.85 * ranks[a] / len(bs)
        ranks = after
    assert {r.id: r["rank"] for r in got.collect()} == pytest.approx(ranks, abs=1e-12)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
