"""Communities by Louvain: local moves of alternating halves of the nodes, then contraction, until modularity stops growing.

In a round the nodes of one half, which a hash of id and round chooses, each move to the neighbouring community of the
greatest gain, as seen from the labels of the round before; as the other half stands still, most neighbours that would
swap places do not. A round that lowers modularity is undone. Communities then become nodes, with the weight within them
as loops, and it begins again. Nodes of very many edges (hubs) meet their edges by broadcast, all others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.operators.folders import staged
from loomspark.operators.graph import hub_join, hubs_of

TOLERANCE = 1e-6  # of modularity, for a round or a level to count
ROUNDS = 20  # of local moves in a level, at most


def _sides(edges: DataFrame) -> DataFrame:
    """(id, to, w): each undirected edge seen from both ends, loops once with twice their weight; parallel edges added."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    one = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to"), w.alias("w")).where("w > 0")
    return one.unionByName(one.select(F.col("to").alias("id"), F.col("id").alias("to"), "w")).groupBy("id", "to").agg(F.sum("w").alias("w"))


def modularity(sides: DataFrame, labels: DataFrame, hubs: DataFrame) -> float:
    """Of labels (id, c) over sides (id, to, w)."""
    known = hub_join(sides, "to", labels.select(F.col("id").alias("to"), F.col("c").alias("ct")), hubs)
    known = hub_join(known, "id", labels, hubs)
    row = known.groupBy("c").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("c") == F.col("ct"), F.col("w")).otherwise(0.0)).alias("inner")).agg(F.sum("k").alias("m2"), F.sum("inner").alias("inner"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return row["inner"] / row["m2"] - row["kk"] / row["m2"] ** 2 if row["m2"] else 0.0


def _moved(sides: DataFrame, nodes: DataFrame, labels: DataFrame, hubs: DataFrame, total: float, turn: int) -> DataFrame:
    """labels (id, c) after the nodes of this turn's half have moved; nodes (id, k) with their weight."""
    by_c = labels.join(nodes, "id").groupBy("c").agg(F.sum("k").alias("kc"))
    seen = hub_join(sides.where("id <> to"), "to", labels.select(F.col("id").alias("to"), "c"), hubs)
    links = seen.where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0).groupBy("id", "c").agg(F.sum("w").alias("w"))
    mine = labels.join(nodes, "id").select("id", F.col("c").alias("own"), "k")
    options = links.join(mine, "id").unionByName(mine.select("id", F.col("own").alias("c"), F.lit(0.0).alias("w"), "own", "k").join(links.select("id").distinct(), "id", "left_semi").select("id", "c", "w", "own", "k"))
    options = options.groupBy("id", "c", "own", "k").agg(F.sum("w").alias("w")).join(by_c, "c")
    rest = F.col("kc") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - F.col("k") * rest / F.lit(total), 9)
    best = options.select("id", "c", gain.alias("g"), (F.col("c") == F.col("own")).alias("stays"))
    first = W.partitionBy("id").orderBy(F.desc("g"), F.desc("stays"), "c")
    chosen = best.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("id", F.col("c").alias("_to"))
    return labels.join(chosen, "id", "left").select("id", F.coalesce("_to", "c").alias("c"))


def louvain(nodes: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """id, community (its least id): edges count undirected, by their weight if there is one (null: 1), those of weight 0 or less not at all.

    Nodes without edges are communities of their own; edges to unknown nodes are left out. The same each time. The
    result has at least the modularity of each node alone; as in any local search it need not be the greatest.
    """
    known = nodes.select("id").distinct()
    kept = edges.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    sides = staged(_sides(kept))
    member = staged(known.select("id", F.col("id").alias("c")))
    while True:
        weights = staged(sides.groupBy("id").agg(F.sum("w").alias("k")))
        total = weights.agg(F.sum("k")).first()[0]
        if not total:
            break
        hubs = hubs_of(sides, "id")
        labels = staged(weights.select("id", F.col("id").alias("c")))
        start = best = modularity(sides, labels, hubs)
        quiet = 0
        for turn in range(ROUNDS):
            tried = staged(_moved(sides, weights, labels, hubs, total, turn))
            now = modularity(sides, tried, hubs)
            quiet = 0 if now > best + tolerance else quiet + 1
            if now > best:
                labels, best = tried, now
            if quiet == 2:  # neither half finds more
                break
        if best <= start + tolerance:
            break
        member = staged(member.join(labels.select(F.col("id").alias("c"), F.col("c").alias("_n")), "c", "left").select("id", F.coalesce("_n", "c").alias("c")))
        inner = hub_join(hub_join(sides, "to", labels.select(F.col("id").alias("to"), F.col("c").alias("ct")), hubs), "id", labels, hubs)
        sides = staged(inner.groupBy(F.col("c").alias("id"), F.col("ct").alias("to")).agg(F.sum("w").alias("w")))
    least = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(least, "c").select("id", "community")
