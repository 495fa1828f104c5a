"""Reads over a property graph of nodes (id, label, type, agent_id, ...) and edges (id, source_id, target_id, relation, weight)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from loomspark.operators.folders import scratch, staged


def cut_lineage(df: DataFrame) -> DataFrame:
    """df by way of the shared checkpoint folder, so that loops do not build up plans and survive lost executors.

    The folder lies in that of spark.checkpoint.dir; only a local master gets one of its own. It goes when the process ends.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    return df.checkpoint()


def relation_lines(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int | None = 30, allowed: Column | None = None) -> DataFrame:
    """line: 'A -[REL]-> B' for edges with a seed (id) at either end, both ends in nodes and allowed; distinct, in order."""
    nodes = nodes.where(allowed) if allowed is not None else nodes
    ends = edges.select("source_id", "target_id", "relation")
    touched = ends.join(seeds.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(ends.join(seeds.select(F.col("id").alias("target_id")), "target_id", "left_semi"))
    a = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("a"))
    b = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("b"))
    lines = touched.join(a, "source_id").join(b, "target_id").select(F.concat("a", F.lit(" -["), "relation", F.lit("]-> "), "b").alias("line")).distinct()
    return lines.orderBy("line").limit(limit) if limit else lines


def coherent(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def within_hops(edges: DataFrame, starts: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """id, hops of all nodes at most so many undirected hops from the starts (id), over the relations if named.

    Each hop joins only what was reached last with the edges, and keeps what is new.
    """
    if relations:
        edges = edges.where(F.col("relation").isin(*relations))
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("to")))
    seen = last = cut_lineage(starts.select("id").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, hops + 1):
        last = cut_lineage(both.join(last, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(last)
        if last.isEmpty():
            break
    return seen


def degree_counts(edges: DataFrame) -> DataFrame:
    """id, n of edge ends, parallel edges and loops counted each."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def _ends(edges: DataFrame) -> DataFrame:
    """id, out, into of the two ends of each pair of nodes that edges join, in one direction; parallel edges count once."""
    pairs = edges.select("source_id", "target_id").distinct()
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return pairs.select(F.inline(ends))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree; parallel edges count once, nodes without edges have 0."""
    found = _ends(edges).groupBy("id").agg(F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"))
    both = nodes.select("id").join(found, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("id", zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"), (zero("in_degree") + zero("out_degree")).alias("degree"))


def page(nodes: DataFrame, edges: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of nodes by id, and the edges within it."""
    found = nodes.orderBy("id").offset(offset).limit(limit)
    return found, coherent(edges, found)


def most_connected(nodes: DataFrame, edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The cap nodes of highest degree (ties by id), and the edges among them."""
    top = degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(cap)
    found = nodes.join(top.select("id"), "id", "left_semi")
    return found, coherent(edges, found)


def clusters(nodes: DataFrame, samples: int = 10) -> DataFrame:
    """type, n_nodes, sample_ids (least ids); a null type is OTHER. The samples come from a ranked prefix, not from whole groups."""
    typed = nodes.select(F.coalesce("type", F.lit("OTHER")).alias("type"), "id")
    first = typed.withColumn("r", F.row_number().over(W.partitionBy("type").orderBy("id"))).where(F.col("r") <= samples)
    ids = first.groupBy("type").agg(F.array_sort(F.collect_list("id")).alias("sample_ids"))
    return typed.groupBy("type").agg(F.count("*").alias("n_nodes")).join(ids, "type")


def cluster_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_type, target_type, n_edges."""
    kinds = nodes.select("id", F.coalesce("type", F.lit("OTHER")).alias("type"))
    typed = edges.join(kinds.select(F.col("id").alias("source_id"), F.col("type").alias("source_type")), "source_id")
    typed = typed.join(kinds.select(F.col("id").alias("target_id"), F.col("type").alias("target_type")), "target_id")
    return typed.groupBy("source_type", "target_type").agg(F.count("*").alias("n_edges"))


def density(n_nodes, n_edges):  # noqa: ANN001, ANN201
    """Edges over ordered pairs, to six places; one node or none divides by 1."""
    return F.round(n_edges / F.greatest(F.lit(1), n_nodes * (n_nodes - 1)), 6)


def capped_density(n_nodes, n_edges):  # noqa: ANN001, ANN201
    """The other form: at most 1, and 0 for less than two nodes."""
    return F.when(n_nodes < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), n_edges / (n_nodes * (n_nodes - 1))))


def scoped(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, relations: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types and edges of the relations (any case; none named: all) whose ends survive."""
    if types:
        nodes = nodes.where(F.lower("type").isin(*[t.lower() for t in types]))
    if relations:
        edges = edges.where(F.lower("relation").isin(*[r.lower() for r in relations]))
    return nodes, coherent(edges, nodes)


def multiverse(nodes: DataFrame, edges: DataFrame, hubs: DataFrame, shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and hubs (agent_id, name); relations, membership of each node in its hub, and shares (source, target) between hubs."""
    hub = hubs.select(F.col("agent_id").alias("id"), F.col("name").alias("label"), F.lit("AGENT").alias("type"), "agent_id")
    all_nodes = nodes.select("id", "label", "type", "agent_id").unionByName(hub)
    belongs = nodes.select(F.concat_ws("__bta__", "id", "agent_id").alias("id"), F.col("id").alias("source_id"), F.col("agent_id").alias("target_id"), F.lit("BELONGS_TO").alias("relation"))
    shared = shares.select(F.concat_ws("__skw__", "source", "target").alias("id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("SHARES_KNOWLEDGE_WITH").alias("relation"))
    return all_nodes, edges.select("id", "source_id", "target_id", "relation").unionByName(belongs).unionByName(shared)


def simple_paths(edges: DataFrame, starts: DataFrame, longest: int, shortest: int = 1, through: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """path (node ids), relations, weights: directed paths without a repeated node, shortest to longest edges long.

    With through (id), nodes after the start are of those; with ends (id), the last is. Edges to other ends are left out before the last step of the longest paths.
    """
    kept = lambda df, ids: df if ids is None else df.join(ids.select(F.col("id").alias("to")), "to", "left_semi")
    step = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), F.col("relation").alias("r"), F.col("weight").alias("w"))
    paths = starts.select(F.array("id").alias("path"), F.array().cast("array<string>").alias("relations"), F.array().cast("array<double>").alias("weights"), F.col("id").alias("at"))
    found = None
    for n in range(1, longest + 1):
        if n == longest:
            paths = paths.join(kept(kept(step, ends), through), "at")
        else:
            paths = kept(paths.join(step, "at"), through)
        paths = paths.where(~F.array_contains("path", F.col("to")))
        paths = paths.select(F.concat("path", F.array("to")).alias("path"), F.concat("relations", F.array("r")).alias("relations"), F.concat("weights", F.array("w")).alias("weights"), F.col("to").alias("at"))
        if n >= shortest:
            whole = paths if ends is None or n == longest else paths.join(ends.select(F.col("id").alias("at")), "at", "left_semi")
            found = whole if found is None else found.unionByName(whole)
    return found.drop("at")


def reached(edges: DataFrame, starts: DataFrame, hops: int, relations: list[str] | None = None) -> DataFrame:
    """The distinct edges of the subgraph within so many undirected hops of the starts: those with both ends in it."""
    return coherent(edges if not relations else edges.where(F.col("relation").isin(*relations)), within_hops(edges, starts, hops, relations))


def breadth_first_paths(edges: DataFrame, starts: DataFrame, shortest: int = 2, longest: int = 4, most: int = 30) -> DataFrame:
    """path, relations of at most so many directed paths without a repeated node, shorter ones first, then by their nodes.

    Rounds end as soon as there are enough, so long paths are only looked for where short ones are few. Of parallel
    edges the first relation by name counts.
    """
    step = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), F.col("relation").alias("r"))
    step = step.groupBy("at", "to").agg(F.min("r").alias("r"))
    paths = starts.select(F.array("id").alias("path"), F.array().cast("array<string>").alias("relations"), F.col("id").alias("at"))
    found, had = None, 0
    for n in range(1, longest + 1):
        paths = paths.join(step, "at").where(~F.array_contains("path", F.col("to")))
        paths = paths.select(F.concat("path", F.array("to")).alias("path"), F.concat("relations", F.array("r")).alias("relations"), F.col("to").alias("at"))
        if n >= shortest:
            mine = cut_lineage(paths.orderBy("path").limit(most - had))
            found = mine if found is None else found.unionByName(mine)
            had += mine.count()
            if had >= most:
                break
            paths = cut_lineage(paths)
    return found.select("path", "relations")


def hubs_of(rows: DataFrame, key: str, share: int = 8) -> DataFrame:
    """key: the ids with more than one in share * partitions of all rows; there can be no more than share * partitions of them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = max(1024, rows.count() // (share * parts))
    return cut_lineage(rows.groupBy(F.col(key).alias("hub")).agg(F.count("*").alias("n")).where(F.col("n") > bound).select("hub"))


def hub_join(rows: DataFrame, key: str, table: DataFrame, hubs: DataFrame) -> DataFrame:
    """rows joined with table (one row a key): the rows of hubs stay where they are and meet a broadcast, the rest is shuffled."""
    if hubs.isEmpty():
        return rows.join(table, key)
    own = F.broadcast(hubs.withColumnRenamed("hub", key))
    return rows.join(own, key, "left_anti").join(table, key).unionByName(rows.join(F.broadcast(table.join(own, key, "left_semi")), key))


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, n) and edges (u, v) by 64-bit hashes of the ids, which are cheaper to shuffle and to sort; null ids are left out.

    Nodes never share a hash: the ids of all nodes are compared, and hashed with another salt if two meet.
    """
    kind, salt = nodes.schema["id"].dataType, 0
    while True:
        known = nodes.where("id is not null").select("id", F.xxhash64("id", F.lit(salt)).alias("n"))
        if known.groupBy("n").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").isEmpty():
            break
        salt += 1
    end = lambda c: F.xxhash64(F.col(c).cast(kind), F.lit(salt))
    return known, edges.where("source_id is not null and target_id is not null").select(end("source_id").alias("u"), end("target_id").alias("v"))


def _relabelled(rows: DataFrame, key: str, labels: DataFrame, hubs: DataFrame) -> DataFrame:
    """rows with the label (u, label) of key in its place, where it has one; the rows of hubs stay where they are."""
    labels = labels.select(F.col("u").alias(key), F.col("label").alias("_label"))
    put = lambda df: df.withColumn(key, F.coalesce("_label", key)).drop("_label")
    if hubs.isEmpty():
        return put(rows.join(labels, key, "left"))
    own = F.broadcast(hubs.withColumnRenamed("hub", key))
    few = F.broadcast(labels.join(own, key, "left_semi"))
    return put(rows.join(own, key, "left_anti").join(labels, key, "left")).unionByName(put(rows.join(own, key, "left_semi").join(few, key, "left")))


def _ends_of(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, low, high (the least and greatest neighbour), n of pairs (u, v) in both directions, staged; hubs among them."""
    both = pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    ends = staged(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")), "ends")
    bound = max(1024, (ends.agg(F.sum("n")).first()[0] or 0) // (8 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return ends, staged(ends.where(F.col("n") > bound).select(F.col("u").alias("hub")), "hubs")


def _hung(ends: DataFrame) -> DataFrame:
    """u, label: each node hangs on its least neighbour if that is less than itself, and is moved up twice."""
    up = staged(ends.select("u", F.least("u", "low").alias("label")), "labels")
    for _ in range(2):
        up = staged(_relabelled(up, "label", up, hubs_of(up, "label")), "labels")
    return up


def _met(pairs: DataFrame, labels: DataFrame, hubs: DataFrame) -> DataFrame:
    """The distinct pairs of unlike labels that pairs join."""
    pairs = _relabelled(_relabelled(pairs, "u", labels, hubs), "v", labels, hubs).where("u <> v")
    return staged(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")


def _composed(labels: DataFrame, more: DataFrame) -> DataFrame:
    return staged(_relabelled(labels, "label", more, hubs_of(labels, "label")), "labels")


def _contracted(pairs: DataFrame) -> DataFrame:
    """u, label of the nodes of pairs: nodes are hung on lesser ones, pairs go on between labels, until none are left; then labels of labels are looked up."""
    levels = []
    while not pairs.isEmpty():
        ends, hubs = _ends_of(pairs)
        levels.append(_hung(ends))
        pairs = _met(pairs, levels[-1], hubs)
    labels = levels.pop()
    while levels:
        labels = _composed(levels.pop(), labels)
    return labels


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its least id): nodes hang on their least neighbour by hash and are contracted, so rounds are few.

    At first only the edge of each node to its greatest neighbour goes on, which joins nearly all; then all edges are
    looked at once, and those between unlike labels are contracted too.
    """
    known, pairs = numbered(nodes, edges)
    known, pairs = staged(known, "nodes"), staged(pairs.where("u <> v"), "pairs")
    ends, hubs = _ends_of(pairs)
    strange = staged(ends.join(known.select(F.col("n").alias("u")), "u", "left_anti").select("u"), "strange")
    if not strange.isEmpty():  # ends that are no nodes join nothing
        pairs = staged(pairs.join(strange, "u", "left_anti").join(strange.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v"), "pairs")
        ends, hubs = _ends_of(pairs)
    if ends.isEmpty():
        return known.select("id", F.col("id").alias("component"))
    labels = _hung(ends)
    thin = staged(ends.join(labels, "u").select(F.col("label").alias("u"), F.col("high").alias("v")), "pairs")
    thin = staged(_relabelled(thin, "v", labels, hubs_of(thin, "v")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    if not thin.isEmpty():
        labels = _composed(labels, _contracted(thin))
    rest = _met(pairs, labels, hubs)
    if not rest.isEmpty():
        labels = _composed(labels, _contracted(rest))
    rows = staged(known.join(labels.withColumnRenamed("u", "n"), "n", "left").select("id", F.coalesce("label", "n").alias("label")), "rows")
    least = rows.groupBy("label").agg(F.min("id").alias("component"))
    return hub_join(rows, "label", least, hubs_of(rows, "label")).select("id", "component")


@contextmanager
def _as_dealt(spark: SparkSession) -> Iterator[None]:
    """Plans made in here stay as they are: only without adaptive execution a checkpoint knows how its rows were dealt and sorted."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """id, rank after so many rounds, or earlier once the ranks move by less than tolerance for each node on average; parallel edges count once, nodes without out-edges spread over all.

    Pairs and ranks are dealt by node once, and checkpoints keep that, so a round shuffles what is given and nothing else.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known, pairs = numbered(nodes, edges)
    known = staged(known, "nodes")
    counts = staged(pairs.groupBy("u").agg(F.count("*").alias("n")), "counts")
    bound = max(1024, (counts.agg(F.sum("n")).first()[0] or 0) // (8 * parts))
    hubs = staged(counts.where(F.col("n") > bound).select("u"), "hubs")
    of_hubs = None if hubs.isEmpty() else staged(pairs.join(F.broadcast(hubs), "u", "left_semi").distinct(), "pairs")
    rest = pairs if of_hubs is None else pairs.join(F.broadcast(hubs), "u", "left_anti")
    with _as_dealt(nodes.sparkSession):
        rest = cut_lineage(rest.repartition(parts, "u").dropDuplicates().sortWithinPartitions("u"))
        n_out = lambda df: df.groupBy(F.col("u").alias("n")).agg(F.count("*").alias("n_out"))
        out = n_out(rest) if of_hubs is None else n_out(rest).unionByName(n_out(of_hubs))
        base = cut_lineage(known.select("n").repartition(parts, "n").join(out, "n", "left").sortWithinPartitions("n"))
        n = base.count()
        ranks = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
        for _ in range(rounds):
            before = ranks
            lost = ranks.where("n_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
            shares = ranks.where("n_out is not null").select(F.col("n").alias("u"), (F.col("rank") / F.col("n_out")).alias("share"))
            given = rest.join(shares, "u").select("v", "share")
            if of_hubs is not None:
                given = given.unionByName(of_hubs.join(F.broadcast(shares.join(F.broadcast(hubs), "u", "left_semi")), "u").select("v", "share"))
            given = given.groupBy(F.col("v").alias("n")).agg(F.sum("share").alias("got"))
            ranks = cut_lineage(base.join(given, "n", "left").select("n", "n_out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank")))
            if tolerance is not None:
                moved = ranks.join(before.select("n", F.col("rank").alias("was")), "n").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
                if moved < n * tolerance:
                    break
    return known.join(ranks.dropDuplicates(["n"]), "n").select("id", "rank")


@F.udtf(returnType=T.StructType([T.StructField(n, T.IntegerType() if n == "n_edges" else T.StringType()) for n in ("start", "finish", "n_edges", "relations")]))
class SubPaths:
    """A table function: every part of a path (node ids, relations) that has an edge, as SELECT ... FROM sub_paths(path, relations)."""

    def eval(self, path: list, relations: list):  # noqa: ANN201
        for i in range(len(path or [])):
            for j in range(i + 1, len(path)):
                yield path[i], path[j], j - i, ">".join(relations[i:j])
