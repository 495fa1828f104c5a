"""Writes beside the upserts of memory.py: hubs, links, points, interactions, exports, audit rows, migrations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.properties import promoted


def promote(nodes: DataFrame) -> DataFrame:
    """nodes with description and source_text lifted out of properties where the columns are null or empty."""
    about, said = promoted(F.col("description"), F.col("source_text"), F.col("properties"))
    return nodes.withColumns({"description": about, "source_text": said})


def upsert_hubs(hubs: DataFrame, new: DataFrame) -> DataFrame:
    """hubs (agent_id, name): new ones are added, known ones take the new name. Of several new rows the greatest name counts."""
    told = new.groupBy("agent_id").agg(F.max("name").alias("_name"))
    return hubs.join(told, "agent_id", "full").select("agent_id", F.coalesce("_name", "name").alias("name"))


def add_links(links: DataFrame, new: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links (source, target) with the new ones between known agents, each once; and the new ones that were refused."""
    ids = hubs.select("agent_id")
    good = new.join(ids.withColumnRenamed("agent_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("agent_id", "target"), "target", "left_semi").select("source", "target")
    return links.select("source", "target").unionByName(good).distinct(), new.select("source", "target").join(good, ["source", "target"], "left_anti")


def remove_links(links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links without those of gone (source, target), and a row with n_deleted."""
    pairs = gone.select("source", "target").distinct()
    return links.join(pairs, ["source", "target"], "left_anti"), links.join(pairs, ["source", "target"], "left_semi").agg(F.count("*").alias("n_deleted"))


def set_column(nodes: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """nodes with new values of one column from changes (id, value), and matched. Of several values of an id the greatest counts."""
    told = changes.groupBy("id").agg(F.max("value").alias("_value"))
    both = nodes.join(told.withColumn("matched", F.lit(True)), "id", "left")
    return both.withColumns({column: F.when(F.col("matched"), F.col("_value")).otherwise(F.col(column)), "matched": F.coalesce("matched", F.lit(False))}).drop("_value")


def record_interactions(turns: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """interactions with cut question (200) and answer_summary (500), and informed_by (interaction_id, node_id) to nodes that exist.

    turns (id, agent_id, session_id, question, answer, timestamp, source_node_ids).
    """
    kept = turns.select("id", "agent_id", "session_id", F.substring("question", 1, 200).alias("question"), F.substring("answer", 1, 500).alias("answer_summary"), "timestamp")
    told = turns.select(F.col("id").alias("interaction_id"), F.explode("source_node_ids").alias("node_id"))
    return kept, told.join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi").select("interaction_id", "node_id")


def delete_interactions(interactions: DataFrame, informed_by: DataFrame, agent: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """interactions and informed_by without those of an agent, and a row with n_deleted."""
    gone = interactions.where(F.col("agent_id") == agent)
    left = informed_by.join(gone.select(F.col("id").alias("interaction_id")), "interaction_id", "left_anti")
    return interactions.where(F.col("agent_id").isNull() | (F.col("agent_id") != agent)), left, gone.agg(F.count("*").alias("n_deleted"))


def full_export(nodes: DataFrame, edges: DataFrame, interactions: DataFrame, informed_by: DataFrame, agent: str) -> dict[str, DataFrame]:
    """nodes by created_at, edges within the tenant, interactions with their source_node_ids, and a row of counts."""
    own = nodes.where(F.col("agent_id") == agent)
    ids = own.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    sources = informed_by.groupBy(F.col("interaction_id").alias("id")).agg(F.sort_array(F.collect_list("node_id")).alias("source_node_ids"))
    talks = interactions.where(F.col("agent_id") == agent).join(sources, "id", "left").withColumn("source_node_ids", F.coalesce("source_node_ids", F.array().cast("array<string>")))
    count = lambda df, n: df.agg(F.count("*").alias(n))
    counts = count(own, "n_nodes").crossJoin(count(inside, "n_edges")).crossJoin(count(talks, "n_interactions"))  # one row each
    return {"nodes": own.orderBy("created_at", "id"), "edges": inside, "interactions": talks, "counts": counts}


def append_by_month(rows: DataFrame, path: str, time: str = "ts", error: str | None = None) -> None:
    """Append rows as Parquet, a folder a month; error texts are cut to 1,000 characters."""
    out = rows.withColumn("month", F.date_format(time, "yyyyMM"))
    out = out.withColumn(error, F.substring(error, 1, 1000)) if error else out
    out.write.mode("append").partitionBy("month").parquet(path)


def write_twice(first: Callable[[DataFrame, int], None], second: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each batch to both sinks, from one reading of it."""

    def batch(rows: DataFrame, epoch: int) -> None:
        kept = rows.persist()
        try:
            first(kept, epoch)
            second(kept, epoch)
        finally:
            kept.unpersist()

    return batch


def run_states(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each key after a run: new rows replace old ones; of several the last by updated_at."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), "updated_at").alias("_s")).select(*keys, "_s.*")
    return old.join(last.select(*keys), keys, "left_anti").select(*keys, *[c for c in old.columns if c not in keys]).unionByName(last.select(*keys, *[c for c in old.columns if c not in keys]))


def deletion_audit(gone: DataFrame, edges: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """An audit row for each deleted node: what it was, how many edges went with it, and when the row expires."""
    ends = edges.select("id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node_id"))
    n = ends.join(gone.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("n"))
    rows = gone.join(n, gone["id"] == n["node_id"], "left")
    return rows.select(
        F.lit("node_deleted").alias("event"), gone["id"].alias("node_id"), F.col("label").alias("node_label"), F.col("type").alias("node_type"), "agent_id",
        F.coalesce("n", F.lit(0)).alias("deleted_edges"), now.alias("timestamp"), (now + F.make_dt_interval(days=F.lit(days))).alias("expires_at"),
    )


def live_rows(audit: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired."""
    return audit.where(F.col("expires_at") > now)


def migrated(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old tables brought up to date: weights of 1 where null, ids of edges from their ends and relation where null, texts promoted."""
    made = F.substring(F.sha2(F.concat_ws(">", "source_id", "relation", "target_id").cast("binary"), 256), 1, 32)
    return promote(nodes), edges.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "id": F.coalesce("id", made)})


def backfilled(nodes: DataFrame, now: Column) -> DataFrame:
    """nodes with energy 1, activation now and 0 retrievals where these are null, and changed."""
    missing = F.col("energy").isNull() | F.col("last_activated_at").isNull() | F.col("retrieval_count").isNull()
    return nodes.withColumns({
        "changed": missing, "energy": F.coalesce("energy", F.lit(1.0)), "last_activated_at": F.coalesce("last_activated_at", now), "retrieval_count": F.coalesce(F.col("retrieval_count").cast("long"), F.lit(0)),
    })


def reembedded(nodes: DataFrame, text: Column, embed: Callable[[list[str]], list], batch: int = 64, dry_run: bool = False) -> DataFrame:
    """id, embedding of nodes with a text, embedded in batches of one call each; a dry run counts them instead (n_texts)."""
    rows = nodes.select("id", text.alias("text")).where(F.trim("text") != "")
    if dry_run:
        return rows.agg(F.count("*").alias("n_texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(embed(part["text"].tolist()))})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>")


def mark_nodes(nodes: DataFrame, marks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """nodes with needs_agent set from marks (id, needs_agent; null clears it), and the events of what changed."""
    told = marks.groupBy("id").agg(F.max_by(F.struct("needs_agent"), F.coalesce("needs_agent", F.lit(""))).alias("_m"))
    both = nodes.join(told, "id", "left")
    after = F.when(F.col("_m").isNotNull(), F.col("_m.needs_agent")).otherwise(F.col("needs_agent"))
    events = both.where(F.col("_m").isNotNull() & ~F.col("needs_agent").eqNullSafe(F.col("_m.needs_agent"))).select(
        F.col("id").alias("node_id"), F.when(F.col("_m.needs_agent").isNull(), "cleared").otherwise("marked").alias("event"), F.coalesce(F.col("_m.needs_agent"), F.col("needs_agent")).alias("agent_type"), now.alias("at"))
    return both.withColumn("needs_agent", after).drop("_m"), events


def release_leases(leases: DataFrame, releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leases (node_id, agent_id, until) without those that their holder releases, and releases with released."""
    held = leases.select("node_id", "agent_id").withColumn("_held", F.lit(True))
    told = releases.select("node_id", "agent_id").distinct()
    return leases.join(told, ["node_id", "agent_id"], "left_anti"), told.join(held, ["node_id", "agent_id"], "left").select("node_id", "agent_id", F.coalesce("_held", F.lit(False)).alias("released"))


def specialist_updates(nodes: DataFrame, answers: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """nodes with what specialists say (id, task, value): a summary becomes the description, a class the type if it is a known one."""
    last = answers.groupBy("id").pivot("task", ["summarise", "classify"]).agg(F.max("value"))
    both = nodes.join(last, "id", "left")
    kind = F.upper(F.trim("classify"))
    return both.withColumns({"description": F.coalesce(F.nullif(F.trim("summarise"), F.lit("")), "description"), "type": F.when(kind.isin(*types), kind).otherwise(F.col("type"))}).drop("summarise", "classify")


def enriched(answers: DataFrame, node_type: Callable[[Column], Column], relation_type: Callable[[Column], Column], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """New nodes and edges from a node (id) and the labels, types and relations found for it (ordinal, label, type, relation): the first few.

    Unknown types become OTHER, unknown relations RELATED_TO; ids are made of the node's and the label.
    """
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy("id").orderBy("ordinal"))
    kept = answers.where(F.trim("label") != "").withColumn("_r", rank).where(F.col("_r") <= most)
    made = F.substring(F.sha2(F.concat_ws(":", "id", F.lower("label")).cast("binary"), 256), 1, 32)
    nodes = kept.select(made.alias("id"), F.trim("label").alias("label"), node_type(F.col("type")).alias("type"))
    return nodes, kept.select(F.col("id").alias("source_id"), made.alias("target_id"), relation_type(F.col("relation")).alias("relation"))
