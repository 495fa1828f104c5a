"""The property graph that the star-schema tables stand for: nodes, edges and vector nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.plans.catalog import table

KINDS = (
    ("region", "r:", "r_regionkey", "r_name", "LOCATION"), ("nation", "n:", "n_nationkey", "n_name", "LOCATION"),
    ("customer", "c:", "c_custkey", "c_name", "PERSON"), ("supplier", "s:", "s_suppkey", "s_name", "ORGANIZATION"),
    ("part", "p:", "p_partkey", "p_name", "PRODUCT"), ("orders", "o:", "o_orderkey", None, "EVENT"),
)
RELATIONS = ("PART_OF", "LOCATED_IN", "CREATED", "CONTAINS")


def node_id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, type, agent_id, energy, retrieval_count, clearance (null for some)."""
    parts = []
    for name, prefix, key, label, kind in KINDS:
        shown = F.col(label) if label else F.concat(F.lit("Order "), F.col(key).cast("string"))
        parts.append(table(spark, sf_dir, name).select(node_id(prefix, key).alias("id"), shown.alias("label"), F.lit(kind).alias("type"), F.col(key).cast("long").alias("k")))
    k = F.col("k")
    return reduce(DataFrame.unionByName, parts).select(
        "id", "label", "type", F.concat(F.lit("agent"), (k % 5).cast("string")).alias("agent_id"), (k * 7 % 101 / 100).alias("energy"),
        (k % 13).alias("retrieval_count"), F.when(k % 11 != 0, k % 5 + 1).alias("clearance"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_id, target_id, relation, weight, agent_id (the source's)."""
    links = (
        ("nation", "n:", "n_nationkey", "r:", "n_regionkey", "PART_OF"), ("customer", "c:", "c_custkey", "n:", "c_nationkey", "LOCATED_IN"),
        ("supplier", "s:", "s_suppkey", "n:", "s_nationkey", "LOCATED_IN"), ("orders", "c:", "o_custkey", "o:", "o_orderkey", "CREATED"),
    )
    parts = []
    for name, a, source, b, target, relation in links:
        weight = F.round(1 - (F.col(source) + F.col(target)) % 10 / 20, 4)
        parts.append(table(spark, sf_dir, name).select(node_id(a, source).alias("source_id"), node_id(b, target).alias("target_id"), F.lit(relation).alias("relation"), weight.alias("weight"), F.col(source).cast("long").alias("k"), F.lit("").alias("n")))
    lines = table(spark, sf_dir, "lineitem").select(
        node_id("o:", "l_orderkey").alias("source_id"), node_id("p:", "l_partkey").alias("target_id"), F.lit("CONTAINS").alias("relation"),
        F.round(0.1 + F.col("l_discount") * 15, 4).alias("weight"), F.col("l_orderkey").alias("k"), F.concat(F.lit("#"), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("n"),
    )
    found = reduce(DataFrame.unionByName, [*parts, lines])
    ids = F.concat("source_id", F.lit(">"), "target_id", "n")
    return found.select(ids.alias("id"), "source_id", "target_id", "relation", "weight", F.concat(F.lit("agent"), (F.col("k") % 5).cast("string")).alias("agent_id"))


def vector_nodes(spark: SparkSession, sf_dir: str, agents: int = 4) -> DataFrame:
    """id, type, agent_id, clearance, embedding (doubles)."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("type"), F.concat(F.lit("agent"), (v % agents).cast("string")).alias("agent_id"),
        F.when(v % 11 != 0, v % 5 + 1).alias("clearance"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each document: id, label, type, agent_id, clearance, energy, retrieval_count, description, source_text, properties, created_at."""
    k = F.col("doc_id")
    bag = F.concat(
        F.lit('{"temporal":"2024-01-'), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit('","n":'), F.col("n_chars").cast("string"), F.lit(',"lang":"'), F.col("lang"),
        F.lit('","tags":["a"],"confidence":0.5,"note":null}'),
    )
    return table(spark, sf_dir, "documents").select(
        k.alias("id"), F.concat(F.coalesce("source", F.lit("none")), F.lit(" "), k.cast("string")).alias("label"), F.upper("lang").alias("type"), F.concat(F.lit("agent"), (k % 5).cast("string")).alias("agent_id"),
        F.when(k % 7 != 0, k % 5 + 1).alias("clearance"), (k * 7 % 101 / 100).alias("energy"), (k % 13).alias("retrieval_count"), F.col("text").alias("description"),
        F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.concat(F.lit("said "), "lang")).alias("source_text"), bag.alias("properties"),
        (F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(days=(k % 30).cast("int"))).alias("created_at"),
    )


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each document to the first of its ten: id, source_id, target_id, relation, weight, agent_id."""
    k = F.col("doc_id")
    verb = F.element_at(F.array(F.lit("CITES"), F.lit("FOLLOWS"), F.lit("QUOTES")), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").where("doc_id % 10 <> 0").select(
        F.concat(k.cast("string"), F.lit(">")).alias("id"), k.alias("source_id"), (k - k % 10).alias("target_id"), verb.alias("relation"), (0.5 + k % 20 / 10).alias("weight"), F.concat(F.lit("agent"), (k % 5).cast("string")).alias("agent_id"))


DOCS = """docs AS (
  SELECT doc_id AS id, coalesce(source, 'none') || ' ' || doc_id AS label, upper(lang) AS type, 'agent' || (doc_id % 5) AS agent_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 + 1 END AS clearance,
         (doc_id * 7 % 101) / 100.0::DOUBLE AS energy, doc_id % 13 AS retrieval_count, text AS description, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'said ' || lang END AS source_text,
         '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS temporal, n_chars AS n, lang, TIMESTAMP '2024-01-31' - INTERVAL 1 DAY * (doc_id % 30) AS created_at FROM documents),
links AS (SELECT doc_id || '>' AS id, doc_id AS source_id, doc_id - doc_id % 10 AS target_id, ['CITES', 'FOLLOWS', 'QUOTES'][doc_id % 3 + 1] AS relation, 0.5::DOUBLE + (doc_id % 20) / 10.0::DOUBLE AS weight,
         'agent' || (doc_id % 5) AS agent_id FROM documents WHERE doc_id % 10 <> 0)"""
NODES = """nodes AS (
  SELECT id, label, type, 'agent' || (k % 5) AS agent_id, (k * 7 % 101) / 100.0::DOUBLE AS energy, (k % 13)::BIGINT AS retrieval_count,
         CASE WHEN k % 11 <> 0 THEN k % 5 + 1 END::BIGINT AS clearance
  FROM (SELECT 'r:' || r_regionkey AS id, r_name AS label, 'LOCATION' AS type, r_regionkey::BIGINT AS k FROM region
        UNION ALL SELECT 'n:' || n_nationkey, n_name, 'LOCATION', n_nationkey FROM nation
        UNION ALL SELECT 'c:' || c_custkey, c_name, 'PERSON', c_custkey FROM customer
        UNION ALL SELECT 's:' || s_suppkey, s_name, 'ORGANIZATION', s_suppkey FROM supplier
        UNION ALL SELECT 'p:' || p_partkey, p_name, 'PRODUCT', p_partkey FROM part
        UNION ALL SELECT 'o:' || o_orderkey, 'Order ' || o_orderkey, 'EVENT', o_orderkey FROM orders))"""
EDGES = """edges AS (
  SELECT source_id || '>' || target_id || n AS id, source_id, target_id, relation, weight, 'agent' || (k % 5) AS agent_id
  FROM (SELECT 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id, 'PART_OF' AS relation,
               round(1 - ((n_nationkey + n_regionkey) % 10) / 20.0::DOUBLE, 4) AS weight, n_nationkey::BIGINT AS k, '' AS n FROM nation
        UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'LOCATED_IN', round(1 - ((c_custkey + c_nationkey) % 10) / 20.0::DOUBLE, 4), c_custkey, '' FROM customer
        UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'LOCATED_IN', round(1 - ((s_suppkey + s_nationkey) % 10) / 20.0::DOUBLE, 4), s_suppkey, '' FROM supplier
        UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'CREATED', round(1 - ((o_custkey + o_orderkey) % 10) / 20.0::DOUBLE, 4), o_custkey, '' FROM orders
        UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'CONTAINS', round(0.1::DOUBLE + l_discount * 15, 4), l_orderkey, '#' || l_linenumber || '/' || l_suppkey FROM lineitem))"""
VECTORS = """vecs AS (
  SELECT vec_id AS id, 'label' || label AS type, 'agent' || (vec_id % 4) AS agent_id, CASE WHEN vec_id % 11 <> 0 THEN vec_id % 5 + 1 END::BIGINT AS clearance,
         embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)"""
