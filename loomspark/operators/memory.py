"""Writes and upkeep of the graph, each as a function from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.operators.folders import staged
from loomspark.operators.graph import cut_lineage


def upsert_nodes(old: DataFrame, new: DataFrame, at: Column, keep: Sequence[str] = ("label", "type", "agent_id"), fill: Sequence[str] = ("embedding", "description", "source_text"), replace: Sequence[str] = ("properties",)) -> DataFrame:
    """old with new merged by id, and the column action (created, merged, kept).

    A node that is there already keeps `keep`, takes the new values of `replace`, and of `fill` those that are not
    null; updated_at is set on each merge. Of several new rows with one id the last by its `ordinal`, if there is one, counts.
    """
    if "ordinal" in new.columns:
        new = new.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("ordinal")))).where("_r = 1").drop("_r", "ordinal")
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    known, told = F.col("a._old").isNotNull(), F.col("b._new").isNotNull()
    out = [F.coalesce("a.id", "b.id").alias("id")]
    for c in old.columns:
        if c in ("id", "updated_at"):
            continue
        mine, yours = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        value = mine if c in keep else F.coalesce(yours, mine) if c in fill else F.when(told, yours).otherwise(mine) if c in replace else mine
        out.append(F.when(known, value).otherwise(yours).alias(c))
    out.append(F.when(told, at).otherwise(F.col("a.updated_at") if "updated_at" in old.columns else F.lit(None)).alias("updated_at"))
    action = F.when(~known, "created").when(told, "merged").otherwise("kept")
    return both.select(*out, action.alias("action"))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """old with the new edges whose ends are nodes of the edge's tenant; and the edges that were not taken.

    An edge (id and ends) that is there already keeps relation, weight and all else, and takes only the new properties
    and `at` as updated_at, where old has these columns. Of several new rows of one edge the first by `ordinal` (or,
    without it, by their values) makes it and the last one's properties count.
    """
    keys = ["id", "source_id", "target_id", "agent_id"]
    ids = nodes.select("id", "agent_id")
    a, b = ids.select(F.col("id").alias("source_id"), "agent_id"), ids.select(F.col("id").alias("target_id"), "agent_id", F.lit(True).alias("_there")).distinct()
    # An edge is its source's tenant's, so it is mostly the target that is missing: that is looked for first, and once.
    told = staged(new.join(b, ["target_id", "agent_id"], "left"), "edges")
    there = told.where("_there").drop("_there")
    good = there.join(a, ["source_id", "agent_id"], "left_semi")
    bad = told.where("_there IS NULL").drop("_there").unionByName(there.join(a, ["source_id", "agent_id"], "left_anti")).select(*new.columns)
    order = F.struct("ordinal") if "ordinal" in new.columns else F.struct(*[c for c in new.columns if c not in keys])
    rest = [c for c in new.columns if c not in (*keys, "ordinal")]
    one = good.groupBy(*keys).agg(*[(F.max_by if c == "properties" else F.min_by)(F.struct(c), order)[c].alias(c) for c in rest], F.lit(True).alias("_new"))
    known, told = F.col("a._old").isNotNull(), F.col("b._new").isNotNull()
    out = []
    for c in old.columns:
        mine, yours = F.col(f"a.{c}"), F.col(f"b.{c}") if c in one.columns else F.lit(None).cast(old.schema[c].dataType)
        value = F.coalesce(mine, yours) if c in keys else F.when(known, F.when(told, yours).otherwise(mine) if c == "properties" and c in rest else mine).otherwise(yours)
        out.append((F.when(told, at).otherwise(value) if c == "updated_at" and at is not None else value).alias(c))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "agent_id" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
    both = old.withColumn("_old", F.lit(True)).alias("a").join(one.alias("b"), same, "full")
    return both.select(*out), bad


def versions(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """The rows of old that new is about to change, with archived_at."""
    return old.join(new.select("id").distinct(), "id", "left_semi").withColumn("archived_at", at)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without gone (id), and edges without those that touch them."""
    left = nodes.join(gone.select("id"), "id", "left_anti")
    kept = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return left, kept


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def decay_edges(edges: DataFrame, rate: float = 0.99, floor: float = 0.1) -> DataFrame:
    """Edges with decayed weight, and changed; a rate of 1 or more changes nothing."""
    if rate >= 1:
        return edges.withColumn("changed", F.lit(False))
    weight = F.greatest(F.lit(floor), F.coalesce("weight", F.lit(1.0)) * rate)
    return edges.withColumn("changed", weight != F.coalesce("weight", F.lit(1.0))).withColumn("weight", weight)


def among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between two different nodes of ids (id).

    Edges are streamed past a hash table of a partition's ids, never sorted, so a task's memory goes by ids and not by edges.
    """
    a, b = ids.select(F.col("id").alias("source_id")), ids.select(F.col("id").alias("target_id"))
    return edges.where("source_id <> target_id").join(a.hint("shuffle_hash"), "source_id", "left_semi").join(b.hint("shuffle_hash"), "target_id", "left_semi")


def feedback(edges: DataFrame, ids: DataFrame, success: bool, step: float = 0.1, low: float = 0.1, high: float = 2.0) -> DataFrame:
    """The edges among ids with weight moved by one step up or down, within bounds."""
    moved = F.least(F.lit(high), F.col("weight") + step) if success else F.greatest(F.lit(low), F.col("weight") - step)
    return among(edges, ids).withColumn("weight", moved)


def activate(nodes: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Nodes, those of ids with full energy, one more retrieval and `at` as last_activated_at; all others as they were."""
    before = F.col("last_activated_at") if "last_activated_at" in nodes.columns else F.lit(None).cast("timestamp")
    hit = nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("energy", F.when(F.col("_hit"), F.lit(1.0)).otherwise(F.col("energy"))).withColumn(
        "retrieval_count", F.col("retrieval_count") + F.coalesce(F.col("_hit").cast("long"), F.lit(0))).withColumn("last_activated_at", F.when(F.col("_hit"), at).otherwise(before)).drop("_hit")


def remap_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with ends replaced through canonical (id, canonical_id); loops go, and of equal (source, target, relation) the heaviest stays."""
    for end in ("source_id", "target_id"):
        to = canonical.select(F.col("id").alias(end), F.col("canonical_id").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    best = W.partitionBy("source_id", "target_id", "relation").orderBy(F.desc("weight"), "id")
    return edges.where("source_id <> target_id").withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def fuse(pairs: DataFrame) -> DataFrame:
    """id, canonical_id from pairs (keep_id, drop_id) of near duplicates: where each dropped node ends up.

    The rule is one pass over nodes by id: a node that is still there meets its greater partners that are still there,
    by id; of each pair one is dropped, and the pass goes on with the next node once the node itself is. A node goes to
    its keeper, and with it to the keeper's keeper.

    In each round those nodes take their turn of which no lesser node, still to come, shares a partner or a pair, so
    turns of one round do not touch each other; most groups of duplicates need one or two rounds.
    """
    a, b = F.least("keep_id", "drop_id"), F.greatest("keep_id", "drop_id")
    left = cut_lineage(pairs.where("keep_id <> drop_id").select(a.alias("a"), b.alias("b"), (F.col("keep_id") == a).alias("stays")).distinct())
    done = None
    while not left.isEmpty():
        least = left.select(F.explode(F.array("a", "b")).alias("v"), "a").groupBy("v").agg(F.min("a").alias("low"))
        near = left.join(least.select(F.col("v").alias("b"), F.col("low").alias("low_b")), "b").join(least.select(F.col("v").alias("a"), F.col("low").alias("low_a")), "a")
        turns = near.groupBy("a").agg(F.bool_and((F.col("low_a") == F.col("a")) & (F.col("low_b") == F.col("a"))).alias("ready"), F.min(F.when(~F.col("stays"), F.col("b"))).alias("ends")).where("ready")
        met = left.join(turns.select("a", "ends"), "a")
        dropped = met.where("ends IS NULL OR b < ends").select(F.col("b").alias("id"), F.col("a").alias("to"))
        dropped = cut_lineage(dropped.unionByName(turns.where("ends IS NOT NULL").select(F.col("a").alias("id"), F.col("ends").alias("to"))))
        done = dropped if done is None else done.unionByName(dropped)
        gone = dropped.select("id")
        left = left.join(turns.select("a"), "a", "left_anti").join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
        left = cut_lineage(left)
    if done is None:
        return left.select(F.col("b").alias("id"), F.col("a").alias("canonical_id"))
    done = cut_lineage(done)
    while True:  # keepers of keepers, half the way each time
        onward = done.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        longer = cut_lineage(done.join(onward, "to", "left").select("id", "to", "_next"))
        if longer.where("_next IS NOT NULL").isEmpty():
            return done.select("id", F.col("to").alias("canonical_id"))
        done = longer.select("id", F.coalesce("_next", "to").alias("to"))


def claim_leases(claims: DataFrame, leases: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """node_id, agent_id, until of the first claim of each node that no live lease holds."""
    live = leases.where(F.col("until") > now).select("node_id")
    first = W.partitionBy("node_id").orderBy("at", "agent_id")
    won = claims.join(live, "node_id", "left_anti").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return won.select("node_id", "agent_id", (now + F.make_dt_interval(secs=F.lit(seconds))).alias("until"))
