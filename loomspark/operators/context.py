"""Retrieval as a user asks for it: seeds of several kinds, fused, expanded by a hop, ranked, re-ranked and written as lines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.functions.properties import context_line, swarm_line
from loomspark.functions.scores import cleared, synaptic_score
from loomspark.functions.texts import cut
from loomspark.operators import retrieval
from loomspark.operators.graph import coherent, cut_lineage, relation_lines
from loomspark.operators.text_index import TextIndex, best_of_texts, question_terms
from loomspark.operators.vector_index import VectorIndex

FETCHED, SELECTED = 40, 15  # candidates of a ranked search, and those that re-ranking keeps
CONTEXT_NODES, CONTEXT_EDGES = 40, 5
# A fixed value.
NOTHING = "No relevant entities found in the knowledge graph."


def context_limit(top_k: int | None) -> int:
    """Records of a context for a number of seeds: two and a half times as many, 20 if none is given."""
    return 20 if top_k is None else math.ceil(2.5 * top_k)


def terms_of(question: str, most: int = 10) -> list[str]:
    """The keywords of a question, as texts.keywords gives them for a column; none twice."""
    import re

    return list(dict.fromkeys(w for w in re.split(r"[^\w]+", question.lower()) if len(w) >= 3))[:most]


def seeds(nodes: DataFrame, question: str, limit: int | None = None) -> DataFrame:
    """nodes with score: those with words in label, description or source_text that begin as the question's keywords do; best first."""
    terms = terms_of(question)
    if not terms:
        return nodes.withColumn("score", F.lit(0.0)).limit(0)
    found = nodes.join(retrieval.fulltext(nodes, "id", [F.col(c) for c in ("label", "description", "source_text")], terms), "id")
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


def visible(nodes: DataFrame, allowed: DataFrame, clearance: int, default: int = 1) -> DataFrame:
    """nodes of the allowed agents (allowed) that a caller may see."""
    return nodes.where(cleared(F.col("clearance"), clearance, default)).join(allowed.select(F.col("allowed").alias("agent_id")).distinct(), "agent_id", "left_semi")


def keyword_context(nodes: DataFrame, allowed: DataFrame, question: str, clearance: int, top_k: int | None = None) -> DataFrame:
    """The best seeds among what the caller may see, or, if there are none, the first nodes by label; with rank."""
    mine, limit = visible(nodes, allowed, clearance), context_limit(top_k)
    found = cut_lineage(seeds(mine, question, limit))
    if found.isEmpty():
        found = mine.withColumn("score", F.lit(0.0)).orderBy("label", "id").limit(limit)
        return found.withColumn("rank", F.row_number().over(W.orderBy("label", "id")))  # of at most `limit` rows
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def scored(nodes: DataFrame, edges: DataFrame, hours: Column, least: float = 0.3) -> DataFrame:
    """nodes with synaptic_score, the mean weight of their out-edges by energy and age; those under `least` are forgotten."""
    use = edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.avg(F.coalesce("weight", F.lit(1.0))).alias("_u"))
    score = synaptic_score(F.col("_u"), F.col("energy"), F.col("retrieval_count"), hours)
    return nodes.join(use, "id", "left").withColumn("synaptic_score", score).where(F.col("synaptic_score") >= least).drop("_u")


def ranked_context(nodes: DataFrame, edges: DataFrame, allowed: DataFrame, question: str, clearance: int, hours: Column, top_k: int | None = None, least: float = 0.3) -> DataFrame:
    """Seeds that are not forgotten, by synaptic score, 40 of them re-ranked to 15 if all have vectors; with rank.


    Without seeds all visible nodes are ranked, and if all are forgotten the plain keyword context is given.
    """
    mine = visible(nodes, allowed, clearance)
    best = lambda df: cut_lineage(scored(df, edges, hours, least).orderBy(F.desc("synaptic_score"), "id").limit(FETCHED))
    found = best(seeds(mine, question).drop("score"))
    if found.isEmpty():
        found = best(mine)
    if found.isEmpty():
        return keyword_context(nodes, allowed, question, clearance, top_k)
    rank = F.row_number().over(W.orderBy(F.desc("synaptic_score"), "id"))  # of at most FETCHED rows
    n, vectors = found.agg(F.count("*"), F.count("embedding")).first() if "embedding" in found.columns else (found.count(), 0)
    if n <= SELECTED or vectors < n:  # the rule of the engine: without all vectors the best by score
        return found.withColumn("rank", rank).where(F.col("rank") <= SELECTED)
    picked = retrieval.mmr(found.select(F.lit(1).alias("query_id"), "id", F.col("synaptic_score").alias("score"), "embedding"), SELECTED)
    return found.join(picked.select("id", F.col("pick").alias("rank")), "id")


def context_lines(records: DataFrame, weight: str | None = None) -> DataFrame:
    """rank, line of records by rank; with the name of a weight column strong records are marked."""
    line = context_line(*[F.col(c) for c in ("agent_id", "label", "type", "description", "source_text", "properties")], F.col(weight) if weight else None)
    return records.select("rank", line.alias("line"))


def relationship_lines(nodes: DataFrame, edges: DataFrame, records: DataFrame, allowed: DataFrame, clearance: int, limit: int = 30) -> DataFrame:
    """The relation lines of the records, with both ends visible to the caller."""
    return relation_lines(visible(nodes, allowed, clearance), edges, records, limit)


def fused_seeds(nodes: DataFrame, questions: DataFrame, top_k: int = 8, tenant: Column | None = None, vectors: VectorIndex | None = None, words: TextIndex | None = None, embedded: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank: vector and keyword lists of each question (query_id, vector, question), fused by rank; twice top_k of them.

    All questions are answered at once. Without indexes on disk, vectors and texts are scanned; given ones must cover the
    same nodes (the tenant's). Vectors may stand in a table of their own (embedded: id, embedding), of the same nodes.
    """
    mine = nodes.where(tenant) if tenant is not None else nodes
    asked = questions.select("query_id", "vector")
    near = vectors.search(asked, top_k) if vectors is not None else retrieval.vector_topk((mine if embedded is None else embedded).select("id", "embedding"), asked, top_k)
    terms = questions.select("query_id", question_terms(F.col("question")).alias("terms"))
    said = words.top(terms, top_k) if words is not None else best_of_texts(mine, "id", [F.col(c) for c in ("label", "description", "source_text")], terms, top_k)
    lists = near.select("query_id", F.lit("vector").alias("list"), "rank", "id").unionByName(said.select("query_id", F.lit("words").alias("list"), "rank", F.col("key").alias("id")))
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return retrieval.rrf(lists).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 2 * top_k).select("query_id", "id", "score", "rank")


def expanded(nodes: DataFrame, edges: DataFrame, found: DataFrame, clearance: int, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes within a hop of the seeds (id) that the caller may see, and the edges between them.

    Seeds above the clearance are not expanded. With `least`, edges are dropped whose weight times their source's
    energy is under it. Both are distinct by id.
    """
    seen = nodes.where(cleared(F.col("clearance"), clearance))
    start = seen.join(found.select("id").distinct(), "id", "left_semi").select("id")
    one = edges.join(start.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(edges.join(start.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)).dropDuplicates(["id"])
    ids = start.unionByName(one.select(F.explode(F.array("source_id", "target_id")).alias("id"))).distinct()
    near = seen.join(ids, "id", "left_semi")
    inside = coherent(edges.join(one.select("id"), "id", "left_semi"), near)
    if least is not None:
        energy = near.select(F.col("id").alias("source_id"), F.coalesce("energy", F.lit(1.0)).alias("_e"))
        inside = inside.join(energy, "source_id").where(F.coalesce("weight", F.lit(1.0)) * F.col("_e") >= least).drop("_e")
    return near, inside


def united(parts: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Rows of several subgraphs, each key once; of equal ones that of the last part counts."""
    rows = None
    for i, p in enumerate(parts):
        mine = p.withColumn("_part", F.lit(i))
        rows = mine if rows is None else rows.unionByName(mine)
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc("_part")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r", "_part")


def supplemented(first: DataFrame, more: DataFrame, enough: int = 5, most: int = 25, key: str = "id") -> DataFrame:
    """The rows of first (key, rank) and, if these are fewer than enough, those of more that are new behind them; with rank, at most `most`."""
    both = first.select(key, "rank", F.lit(0).alias("_from"))
    if first.count() < enough:
        both = both.unionByName(more.join(first.select(key), key, "left_anti").select(key, "rank", F.lit(1).alias("_from")))
    place = F.row_number().over(W.orderBy("_from", "rank", key))  # of two short lists
    return both.withColumn("_r", place).where(F.col("_r") <= most).select(key, F.col("_r").alias("rank"))


def subgraph_lines(nodes: DataFrame, edges: DataFrame, most: int = CONTEXT_NODES, per_node: int = CONTEXT_EDGES) -> DataFrame:
    """rank, line: a bullet for each of the best nodes (score, then ordinal), with its heaviest relations; one fixed line if there are none."""
    names = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("_to"))
    heavy = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc(F.coalesce("weight", F.lit(1.0))), "id"))
    kept = edges.withColumn("_r", heavy).where(F.col("_r") <= per_node).join(names, "target_id", "left")
    said = F.struct("_r", F.concat("relation", F.lit(" → "), F.coalesce(F.col("_to"), F.col("target_id").cast("string"))).alias("s"))
    rels = kept.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["s"]), "; ").alias("_rels"))
    order = [F.desc(F.coalesce("score", F.lit(0.0))), F.col("ordinal")]
    top = nodes.orderBy(*order).limit(most).join(rels, "id", "left")
    about, text = cut(F.nullif("description", F.lit(""))), F.nullif("source_text", F.lit(""))
    text = F.when(text != F.coalesce(about, F.lit("")), cut(text))
    line = F.concat(
        F.lit("• "), "label", F.lit(" ("), "type", F.lit(")"), F.coalesce(F.concat(F.lit(": "), about), F.lit("")),
        F.coalesce(F.concat(F.lit(' — "'), text, F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(" | "), "_rels"), F.lit("")),
    )
    lines = cut_lineage(top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), line.alias("line")))
    return lines if not lines.isEmpty() else nodes.sparkSession.createDataFrame([(1, NOTHING)], "rank int, line string")


def swarm_lines(records: DataFrame) -> DataFrame:
    """id, line of records of several tenants."""
    return records.select("id", swarm_line(*[F.col(c) for c in ("agent_id", "label", "type", "description", "properties")]).alias("line"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """query_id, answer: the most certain candidate (query_id, n, answer, confidence), the first of equals.

    Failed and empty candidates are dropped; without any certainty the first one counts, and a question with no valid
    candidate has the state 'failed'.
    """
    good = F.col("answer").isNotNull() & (F.trim("answer") != "")
    rows = candidates.groupBy("query_id").agg(
        F.max_by("answer", F.when(good & F.col("confidence").isNotNull(), F.struct("confidence", (-F.col("n")).alias("n")))).alias("_sure"),
        F.min_by("answer", F.when(good, F.col("n"))).alias("_first"),
    )
    answer = F.coalesce("_sure", "_first")
    return rows.select("query_id", answer.alias("answer"), F.when(answer.isNull(), "failed").otherwise("ok").alias("state"))


def federated(found: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of several agents' subgraphs (agent_id, id), each once under its first agent, and the lines of the agents that found any.

    answers (agent_id, answer, error); agents without nodes and those that failed are left out.
    """
    one = W.partitionBy("id").orderBy("agent_id")
    nodes = found.join(answers.where("error is null").select("agent_id"), "agent_id", "left_semi").withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    grounded = answers.where("error is null").join(found.select("agent_id").distinct(), "agent_id", "left_semi")
    return nodes, grounded.select("agent_id", F.concat(F.lit("[Agent: "), "agent_id", F.lit("] "), "answer").alias("line"))
