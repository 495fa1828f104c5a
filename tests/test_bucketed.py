"""Tables in hash buckets: what a batch rewrites, batches that come again, batches that fail half way."""

import os

import pytest
from pyspark.sql import functions as F

from loomspark.operators import bucketed, memory
from loomspark.operators.bucketed import BucketedTable
from loomspark.streaming import jobs

NODES = "id long, agent_id string, label string, updated_at timestamp"
EDGES = "id string, source_id long, target_id long, relation string, weight double, agent_id string, properties string, updated_at timestamp"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, names in os.walk(f"{path}/rows") for f in names if f.startswith("part-")}


def later(old, new):
    return old.join(new.select("id"), "id", "left_anti").unionByName(new.select(*old.columns))


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable.create(spark.range(1000).withColumn("v", F.lit(0)), path, buckets=16)
    before = files(path)
    touched = table.upsert(spark.createDataFrame([(5, 1), (5000, 1)], "id long, v int"), later, 1)
    after = files(path)
    changed = {f for f, i in before.items() if after.get(f) != i}
    assert 1 <= len(touched) <= 2 and changed and changed <= {f for f in before if any(f"/bucket={b}/" in f for b in touched)}
    assert table.read().count() == 1001 and {r.id: r.v for r in table.of(spark.createDataFrame([(5,), (6,), (77777,)], "k long")).collect()} == {5: 1, 6: 0}
    # The same batch again is left out; the table opened anew knows that.
    assert BucketedTable(spark, path).upsert(spark.createDataFrame([(5, 9)], "id long, v int"), later, 1) == [] and files(path) == after
    assert table.delete(spark.range(1000).select("id")) == sorted(range(16))
    assert [r.id for r in BucketedTable(spark, path).read().collect()] == [5000]
    table.delete(spark.createDataFrame([(5000,)], "x long"))
    assert table.read().count() == 0 and table.upsert(spark.createDataFrame([(1, 1)], "id long, v int"), later) and table.read().count() == 1


def test_a_batch_that_failed_is_written_when_it_comes_again(spark, tmp_path, monkeypatch):
    table = BucketedTable.create(spark.createDataFrame([(1, 0)], "id long, v int"), str(tmp_path / "t"), buckets=8)
    rows = spark.createDataFrame([(i, 1) for i in range(20)], "id long, v int")
    write = bucketed.replace_parts

    def half(merged, path, by, parts):
        write(merged.where(F.col(by).isin(parts[:3])), path, by, parts[:3])
        raise OSError("lost")

    monkeypatch.setattr(bucketed, "replace_parts", half)
    with pytest.raises(OSError, match="lost"):
        table.upsert(rows, later, 7)
    monkeypatch.undo()
    assert not table.written(7)
    table.upsert(rows, later, 7)
    assert table.written(7) and sorted((r.id, r.v) for r in table.read().collect()) == [(i, 1) for i in range(20)]


def test_tenant_batches_write_nodes_and_edges(spark, tmp_path):
    nodes = BucketedTable.create(spark.createDataFrame([(1, "t", "one", None)], NODES), str(tmp_path / "n"), buckets=4)
    edges = BucketedTable.create(spark.createDataFrame([("1>2", 1, 2, "KNOWS", 1.7, "t", "{}", None)], EDGES), str(tmp_path / "e"), buckets=4)
    left = []

    def split(rows):
        links = rows.where("to_id IS NOT NULL").select(F.concat("id", F.lit(">"), "to_id").alias("id"), F.col("id").alias("source_id"), F.col("to_id").alias("target_id"), F.lit("OTHER").alias("relation"), F.lit(1.0).alias("weight"), "agent_id", F.lit('{"a":1}').alias("properties"))
        return rows.select("id", "agent_id", "label", "ordinal"), links

    step = jobs.tenant_batches(nodes, edges, split, F.lit("2024-02-01").cast("timestamp"), lambda rows, epoch: left.extend((epoch, r.id) for r in rows.collect()))
    batch = spark.createDataFrame([(1, "t", "uno", 2, 0), (2, "t", "two", 1, 0), (2, "t", "deux", 99, 1), (3, None, "none", 1, 0), (4, "u", "four", 1, 0)], "id long, agent_id string, label string, to_id long, ordinal int")
    for _ in range(2):
        step(batch, 0)
    assert sorted((r.id, r.agent_id, r.label) for r in nodes.read().collect()) == [(1, "t", "one"), (2, "t", "deux"), (4, "u", "four")]
    assert sorted((r.id, r.relation, r.weight, r.properties) for r in edges.read().collect()) == [("1>2", "KNOWS", 1.7, '{"a":1}'), ("2>1", "OTHER", 1.0, '{"a":1}')]
    assert {x for _, x in left} == {3, "2>99", "4>1"}


def test_learned_weights_survive_every_batch(spark, tmp_path):
    edges = BucketedTable.create(spark.createDataFrame([(f"e{i}", i, i + 1, "R", 1.0 + i / 10, "t", None, None) for i in range(10)], EDGES), str(tmp_path / "e"))
    ends = spark.range(20).select("id", F.lit("t").alias("agent_id"))
    new = edges.read().withColumns({"weight": F.lit(0.0), "relation": F.lit("X"), "properties": F.lit("{}")}).toPandas()
    new = spark.createDataFrame(new.drop(columns="updated_at"), EDGES.replace(", updated_at timestamp", ""))
    for epoch in range(2):
        edges.upsert(new, lambda old, rows: memory.upsert_edges(old, rows, ends, F.lit("2024-02-01").cast("timestamp"))[0], epoch)
    assert {r.id: (r.weight, r.relation) for r in edges.read().collect()} == {f"e{i}": (1.0 + i / 10, "R") for i in range(10)}
