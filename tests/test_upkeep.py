"""A consolidation pass: links that are proposed, and a step that fails."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import memory, similarity, upkeep

EDGES = "id string, source_id long, target_id long, relation string, weight double, agent_id string"


def _graph(spark):
    nodes = spark.createDataFrame(
        [(1, "CONCEPT", "t", [1.0, 0.0]), (2, "CONCEPT", "t", [1.0, 0.01]), (3, "CONCEPT", "t", [0.9, 0.4]), (4, "CONCEPT", "t", [0.0, 1.0])], "id long, type string, agent_id string, embedding array<double>")
    edges = spark.createDataFrame([("a", 1, 4, "R", 1.0, "t"), ("b", 2, 4, "R", 0.5, "t"), ("c", 3, 3, "R", 1.0, "t")], EDGES)
    return nodes.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")), edges


def test_a_pass_fuses_proposes_and_decays(spark):
    nodes, edges = _graph(spark)
    propose = lambda pairs: pairs.select("a", "b", F.lit(True).alias("is_related"), F.lit("R").alias("proposed_label"), F.lit(0.9).alias("confidence"))
    left, after, report = upkeep.consolidate(nodes, edges, F.lit("2024-03-01").cast("timestamp"), propose=propose)
    row = report.first().asDict()
    assert row == {"n_pruned": 0, "n_agents": 1, "n_fused": 1, "n_proposed": 1, "n_decayed": 2, "n_nodes": 3, "n_edges": 2, "error": None}
    assert sorted(r.id for r in left.collect()) == [1, 3, 4]
    assert {(r.source_id, r.target_id): round(r.weight, 4) for r in after.collect()} == {(1, 4): 0.99, (1, 3): 0.99}


def test_a_failing_step_is_told_and_the_rest_stays(spark):
    nodes, edges = _graph(spark)

    def broken(pairs):
        raise RuntimeError("no model")

    left, after, report = upkeep.consolidate(nodes, edges, F.lit("2024-03-01").cast("timestamp"), propose=broken)
    row = report.first()
    assert row.error == "no model" and row.n_fused == 1 and row.n_proposed == 0 and row.n_decayed == 0 and row.n_nodes == left.count() == 3
    assert after.where("weight = 1.0").count() >= 1  # nothing has decayed
    untimed = upkeep.consolidate(nodes.drop("created_at"), edges, F.lit("2024-03-01").cast("timestamp"))
    assert untimed[2].first().error and untimed[0].count() == 4


@pytest.mark.parametrize("longest", [0, 1, 2, 3])
def test_alike_and_unconnected_as_pairs_joined_with_edges(spark, longest):
    """The filter where pairs are formed, over several parts, and the join of all pairs with what their ends reach."""
    rng = np.random.default_rng(longest)
    nodes = spark.createDataFrame([(i, f"t{i % 2}", [float(x) for x in rng.standard_normal(6)]) for i in range(300)] + [(900, "t0", None)], "id long, agent_id string, embedding array<double>")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, 7) for i in range(0, 300, 6)], "source_id long, target_id long")  # 7 is a hub
    got = [(r.a, r.b) for r in upkeep.unconnected_alike(nodes, edges, 0.2, 0.9, longest, rows=40).select("a", "b").collect()]
    pairs = similarity.similar_pairs(nodes, 0.2, 0.9)
    want = upkeep.unconnected(pairs, edges, longest) if longest else pairs
    assert len(got) == len(set(got)) and set(got) == {(r.a, r.b) for r in want.select("a", "b").collect()}


def test_pairs_are_not_shuffled_for_their_links(spark):
    nodes, edges = _graph(spark)
    propose = lambda pairs: pairs.withColumns({"is_related": F.lit(True), "proposed_label": F.lit("R"), "confidence": F.lit(0.9)})
    plan = upkeep.proposed_links(nodes, edges, propose)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]  # what is done with the pairs
    assert "LeftSemi" in above and "LeftAnti" not in above and above.count("Join") == 1


def test_vectors_of_floats_are_dealt_as_floats(spark):
    def kind(x):
        return similarity.dealt(spark.createDataFrame([(1, "t", [x, 1.0])], "id long, agent_id string, embedding array<double>"), 0.9).schema["embedding"].dataType.simpleString()

    assert kind(0.5) == "array<float>" and kind(0.1) == "array<double>"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_among_ids_are_not_sorted(spark):
    edges = spark.range(2000).selectExpr("id", "id % 50 AS source_id", "id % 70 AS target_id", "1.0D AS weight")
    ids = spark.createDataFrame([(i,) for i in [*range(0, 70, 3), 3, 6]], "id long")  # two of them twice
    got = memory.among(edges, ids)
    assert sorted(r.id for r in got.collect()) == [k for k in range(2000) if k % 50 != k % 70 and k % 50 % 3 == 0 and k % 70 % 3 == 0]
    assert _plan(got).count("strategy=shuffle_hash") == 2


def test_new_edges_are_looked_at_once(spark):
    """Rows left for want of a source, a target or a tenant, and which joins are made for them."""
    schema = "id string, source_id string, target_id string, relation string, weight double, agent_id string"
    new = spark.createDataFrame([("1", "a", "b", "R", 1.0, "t"), ("2", "a", "z", "R", 1.0, "t"), ("3", "z", "b", "R", 1.0, "t"), ("4", "a", "b", "R", 1.0, None), ("5", None, "b", "R", 1.0, "t"), ("5", None, "b", "R", 1.0, "t")], schema)
    merged, bad = memory.upsert_edges(new.limit(0), new, spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "t")], "id string, agent_id string"))
    assert [r.id for r in merged.collect()] == ["1"] and sorted(r.id for r in bad.collect()) == ["2", "3", "4", "5", "5"]
    assert _plan(bad).count("Join") == 1
