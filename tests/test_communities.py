"""Louvain against a plain run, hubs, and PageRank that stops."""

import random
from collections import defaultdict

import pytest

from loomspark.operators import communities, graph


def plain_modularity(adjacent, label):
    m2 = sum(w for a in adjacent.values() for w in a.values())
    k, inner = defaultdict(float), 0.0
    for a, near in adjacent.items():
        for b, w in near.items():
            k[label[a]] += w
            inner += w * (label[a] == label[b])
    return inner / m2 - sum(x * x for x in k.values()) / m2**2


def plain_louvain(adjacent):
    """One node after the other, level by level."""
    member = {x: x for x in adjacent}
    while True:
        label, m2 = {x: x for x in adjacent}, sum(w for a in adjacent.values() for w in a.values())
        k = {x: sum(a.values()) for x, a in adjacent.items()}
        total, moved_any, moved = dict(k), False, True
        while moved:
            moved = False
            for x in sorted(adjacent):
                links = defaultdict(float)
                for y, w in adjacent[x].items():
                    if y != x:
                        links[label[y]] += w
                own = label[x]
                total[own] -= k[x]
                best = max([own, *links], key=lambda c: (round(links[c] - k[x] * total[c] / m2, 9), c == own, -c))
                total[best] += k[x]
                if best != own:
                    label[x], moved, moved_any = best, True, True
        if not moved_any:
            return member
        member = {x: label[c] for x, c in member.items()}
        merged = defaultdict(lambda: defaultdict(float))
        for a, near in adjacent.items():
            for b, w in near.items():
                merged[label[a]][label[b]] += w
        adjacent = merged


def planted(seed, groups=6, size=12, inside=0.5, between=0.02):
    rng = random.Random(seed)
    rows = []
    for a in range(groups * size):
        for b in range(a):
            if rng.random() < (inside if a // size == b // size else between):
                rows.append((a, b, rng.choice((1.0, 2.0))))
    return rows


def sides(rows):
    adjacent = defaultdict(lambda: defaultdict(float))
    for a, b, w in rows:
        adjacent[a][b] += w
        adjacent[b][a] += w
    return adjacent


def test_louvain_is_as_good_as_a_plain_run(spark):
    rows = planted(1)
    nodes = spark.createDataFrame([(i,) for i in range(80)], "id long")
    edges = spark.createDataFrame([*rows, (3, 999, 1.0), (5, 5, 0.0)], "source_id long, target_id long, weight double")
    got = {r.id: r.community for r in communities.louvain(nodes, edges).collect()}
    adjacent = sides(rows)
    assert set(got) == set(range(80)) and all(got[i] == i for i in range(80) if i not in adjacent)
    assert all(got[c] == c and c <= i for i, c in got.items())
    assert plain_modularity(adjacent, got) >= plain_modularity(adjacent, plain_louvain(adjacent)) - 1e-9


def test_no_edges_and_hubs(spark, monkeypatch):
    nodes = spark.range(5).select("id")
    none = spark.createDataFrame([], "source_id long, target_id long, weight double")
    assert {(r.id, r.community) for r in communities.louvain(nodes, none).collect()} == {(i, i) for i in range(5)}
    star = spark.createDataFrame([(0, i) for i in range(1, 3000)], "source_id long, target_id long")
    wide = spark.range(3000).select("id")
    assert graph.hubs_of(star, "source_id").count() == 1 and graph.hubs_of(star, "target_id").count() == 0
    assert {r.component for r in graph.components(wide, star).collect()} == {0}
    plan = graph.hub_join(star, "source_id", wide.withColumnRenamed("id", "source_id"), graph.hubs_of(star, "source_id"))
    assert plan.count() == 2999 and "BroadcastHashJoin" in plan._jdf.queryExecution().toString()


def test_pagerank_stops(spark):
    edges = spark.createDataFrame([(a, b) for a, b, _ in planted(3)], "source_id long, target_id long")
    nodes = spark.range(72).select("id")
    long = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, 60).collect()}
    short = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, 60, tolerance=1e-8).collect()}
    assert short == pytest.approx(long, abs=1e-5) and sum(short.values()) == pytest.approx(1)
