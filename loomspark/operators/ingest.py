"""Text and payload transforms on the way into the graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.functions import texts

SENTENCE_ENDS = (".", "!", "?", "。", "！", "？", "؟", "۔")


def char_chunks(text: str, size: int = 1200, overlap: int = 150) -> list[str]:
    """Chunks of at most size characters, cut behind the last '. ' past the middle; each begins overlap before the end of the one before."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        chunk = text[at : at + size]
        if at + size < len(text):
            stop = chunk.rfind(". ")
            if stop > size // 2:
                chunk = chunk[: stop + 1]
        if chunk.strip():
            out.append(chunk.strip())
        if at + size >= len(text):
            break
        at += max(len(chunk) - overlap, 1)
    return out


def token_chunks(text: str, budget: int = 500, overlap: int = 50) -> list[str]:
    """Chunks of at most budget words, cut behind the last sentence end past the middle."""
    words, out, at = text.split(), [], 0
    while at < len(words):
        used = words[at : at + budget]
        if at + budget < len(words):
            ends = [i for i in range(len(used) // 2, len(used)) if used[i].endswith(SENTENCE_ENDS)]
            if ends:
                used = used[: ends[-1] + 1]
        out.append(" ".join(used))
        if at + budget >= len(words):
            break
        at += max(len(used) - overlap, 1)
    return out


def chunked(docs: DataFrame, key: str, text: str, cut=char_chunks) -> DataFrame:  # noqa: ANN001
    """key, chunk_no (from 0), chunk; null texts give none."""

    @F.pandas_udf("array<string>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut(t))

    return docs.select(key, F.posexplode(cuts(F.col(text))).alias("chunk_no", "chunk"))


def merge_payload(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (payload, ordinal, label) without later ones of equal label in any case; edges (payload, ordinal, source, target, relation) between what stays, without loops and repeats.

    Edges name labels; those with an unknown one are left out.
    """
    first = W.partitionBy("payload", F.lower("label")).orderBy("ordinal")
    ranked = nodes.withColumn("_r", F.row_number().over(first)).withColumn("_canon", F.first("label").over(first))
    kept = ranked.where("_r = 1").drop("_r", "_canon")
    names = ranked.select("payload", "label", "_canon").distinct()
    for end in ("source", "target"):
        edges = edges.join(names.select("payload", F.col("label").alias(end), F.col("_canon").alias(f"_{end}")), ["payload", end]).withColumn(end, F.col(f"_{end}")).drop(f"_{end}")
    once = W.partitionBy("payload", "source", "target", "relation").orderBy("ordinal")
    return kept, edges.where("source <> target").withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")


def payload(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (payload, ordinal, label, type, properties) and edges (payload, ordinal, source, target, relation) of extraction answers.

    answers (payload, answer): JSON of {nodes: [{label, type, properties}], edges: [{source, target, relation}]}, perhaps
    within a code fence. Nodes without a label are left out, and edges that name a label which the payload does not have.
    """
    schema = "nodes array<struct<label:string,type:string,properties:string>>, edges array<struct<source:string,target:string,relation:string>>"
    parsed = answers.select("payload", F.from_json(texts.json_object_text(F.col("answer")), schema).alias("p"))
    nodes = parsed.select("payload", F.posexplode("p.nodes").alias("ordinal", "n")).where(F.trim("n.label") != "")
    nodes = nodes.select("payload", "ordinal", F.trim("n.label").alias("label"), texts.node_type(F.coalesce("n.type", F.lit("OTHER"))).alias("type"), F.coalesce("n.properties", F.lit("{}")).alias("properties"))
    edges = parsed.select("payload", F.posexplode("p.edges").alias("ordinal", "e"))
    edges = edges.select("payload", "ordinal", F.trim("e.source").alias("source"), F.trim("e.target").alias("target"), texts.relation_type(F.coalesce("e.relation", F.lit("RELATED_TO"))).alias("relation"))
    names = nodes.select("payload", "label").distinct()
    for end in ("source", "target"):
        edges = edges.join(names.withColumnRenamed("label", end), ["payload", end], "left_semi")
    return nodes, edges.select("payload", "ordinal", "source", "target", "relation")


def fact_nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, label, type, description of the FACT node of each document with text."""
    flat = F.regexp_replace(F.trim(F.col(text)), "\n", " ")
    label = F.concat(F.lit("fact: "), F.substring(flat, 1, 200), F.when(F.length(text) > 200, F.lit("…")).otherwise(F.lit("")))
    told = docs.where(F.col(text).rlike(r"\S"))
    return told.select(F.concat(F.lit("fact:"), F.col(key).cast("string")).alias("id"), label.alias("label"), F.lit("FACT").alias("type"), F.col(text).alias("description"))


def mention_edges(entities: DataFrame, key: str) -> DataFrame:
    """source_id, target_id, relation: the document's FACT node mentions each of its entities (key, id)."""
    rows = entities.select(F.concat(F.lit("fact:"), F.col(key).cast("string")).alias("source_id"), F.col("id").alias("target_id"))
    return rows.distinct().withColumn("relation", F.lit("MENTIONS"))


def classify_vectors(rows: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """rows with vector_state: missing, wrong_size or ready."""
    state = F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != dims, "wrong_size").otherwise("ready")
    return rows.withColumn("vector_state", state)


def incremental(current: DataFrame, state: DataFrame) -> DataFrame:
    """uri, action, hash: fast_skip if modified as before, hash_skip if the content is as before, else emit.

    current (uri, modified, content), state (uri, modified, hash).
    """
    old = state.select("uri", F.col("modified").alias("_m"), F.col("hash").alias("_h"))
    same = F.coalesce(F.col("modified") == F.col("_m"), F.lit(False))
    seen = current.join(old, "uri", "left").withColumn("_fast", same)
    hashed = seen.withColumn("hash", F.when(F.col("_fast"), F.col("_h")).otherwise(F.sha2(F.col("content").cast("binary"), 256)))
    action = F.when(F.col("_fast"), "fast_skip").when(F.col("hash") == F.col("_h"), "hash_skip").otherwise("emit")
    return hashed.select("uri", action.alias("action"), "hash")


def changed_pages(pages: DataFrame, state: DataFrame, most: int = 10 << 20, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """url, action, and the new state (url, etag, last_modified, hash) of pages (url, etag, last_modified, content) fetched again.

    not_modified if the tag, or without tags the time, is as before; too_large beyond `most` bytes; same if the content
    is as before; else emit. The state of a page that is not emitted stays. Pages are known by their url, or by another `key`
    of both tables where urls repeat; it is then a column of both results.
    """
    keys = ["url"] if key == "url" else [key, "url"]
    old = state.select(key, F.col("etag").alias("_e"), F.col("last_modified").alias("_m"), F.col("hash").alias("_h"))
    both = pages.join(old, key, "left")
    tagged = F.col("etag").isNotNull() & F.col("_e").isNotNull()
    same = F.when(tagged, F.col("etag") == F.col("_e")).otherwise(F.coalesce(F.col("last_modified") == F.col("_m"), F.lit(False)))
    both = both.withColumn("_same", same).withColumn("hash", F.when(~F.col("_same") & (F.octet_length("content") <= most), F.sha2(F.col("content").cast("binary"), 256)))  # a body is hashed only if it is looked at
    action = F.when(F.col("_same"), "not_modified").when(F.octet_length("content") > most, "too_large").when(F.col("hash") == F.col("_h"), "same").otherwise("emit")
    told = both.withColumn("action", action)
    new = told.where("action = 'emit'").select(*keys, "etag", "last_modified", "hash")
    return told.select(*keys, "action"), state.select(*keys, "etag", "last_modified", "hash").join(new.select(key), key, "left_anti").unionByName(new)


def checked_vectors(rows: DataFrame, dims: int, strict: bool, vector: str = "embedding") -> DataFrame:
    """rows with vector_state ready or to_embed. Strict: a vector of another size is an error; else it is embedded anew, like a missing one."""
    state = classify_vectors(rows, dims, vector)
    wrong = F.col("vector_state") == "wrong_size"
    after = F.when(wrong & F.lit(strict), F.raise_error(F.lit(f"expected vectors of {dims} numbers"))).when(F.col("vector_state") == "ready", "ready").otherwise("to_embed")
    return state.withColumn("vector_state", after)


def retries(attempts: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Documents of which some chunk succeeded within so many attempts, and those to set aside.

    attempts (doc_id, chunk_no, attempt, ok).
    """
    chunks = attempts.where(F.col("attempt") <= most).groupBy("doc_id", "chunk_no").agg(F.max("ok").alias("ok"))
    docs = chunks.groupBy("doc_id").agg(F.max("ok").alias("any_ok"), F.count("*").alias("chunks"), F.sum(F.col("ok").cast("int")).alias("good"))
    return docs.where("any_ok"), docs.where("not any_ok")
