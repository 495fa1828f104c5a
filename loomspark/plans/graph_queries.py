"""Queries over the graph of the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.functions.scores import cleared, dynamic_decay, synaptic_score
from loomspark.operators import graph, memory, retrieval, training, upkeep
from loomspark.plans.catalog import query, table
from loomspark.sources.star import EDGES, NODES, VECTORS, edges, nodes, vector_nodes

G = f"WITH RECURSIVE {NODES}, {EDGES} "


def whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, sf_dir), edges(spark, sf_dir)


@query(G + "SELECT count(*) AS n_nodes, count(DISTINCT type) AS n_types, (SELECT count(*) FROM edges) AS n_edges FROM nodes")
def graph_stats(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    return n.agg(F.count("*").alias("n_nodes"), F.countDistinct("type").alias("n_types")).crossJoin(e.agg(F.count("*").alias("n_edges")))


@query(G + "SELECT DISTINCT 'type' AS kind, type AS name FROM nodes UNION ALL SELECT DISTINCT 'relation', relation FROM edges")
def graph_schema(spark, sf_dir):
    a = nodes(spark, sf_dir).select(F.lit("type").alias("kind"), F.col("type").alias("name")).distinct()
    return a.unionByName(edges(spark, sf_dir).select(F.lit("relation").alias("kind"), F.col("relation").alias("name")).distinct())


@query(G + "SELECT agent_id, n AS n_nodes, e AS n_edges, round(e / greatest(1, n * (n - 1)), 6) AS density FROM (SELECT agent_id, count(*) AS n FROM nodes GROUP BY 1) JOIN (SELECT agent_id, count(*) AS e FROM edges GROUP BY 1) USING (agent_id)")
def graph_density(spark, sf_dir):
    n = nodes(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("n_nodes"))
    e = edges(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("n_edges"))
    return n.join(e, "agent_id").withColumn("density", graph.density(F.col("n_nodes"), F.col("n_edges")))


@query(G + """, r AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) AS r FROM nodes)
SELECT type, count(*) AS n_nodes, string_agg(id, ',' ORDER BY id) FILTER (WHERE r <= 10) AS sample_ids FROM r GROUP BY type""")
def graph_clusters_nodes(spark, sf_dir):
    return graph.clusters(nodes(spark, sf_dir)).withColumn("sample_ids", F.array_join("sample_ids", ","))


@query(G + "SELECT a.type AS source_type, b.type AS target_type, count(*) AS n_edges FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id GROUP BY 1, 2")
def graph_clusters_edges(spark, sf_dir):
    return graph.cluster_edges(nodes(spark, sf_dir), edges(spark, sf_dir))


DEGREES = """, p AS (SELECT DISTINCT source_id, target_id FROM edges),
d AS (SELECT n.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes n
      LEFT JOIN (SELECT target_id AS id, count(*) AS n FROM p GROUP BY 1) i USING (id) LEFT JOIN (SELECT source_id AS id, count(*) AS n FROM p GROUP BY 1) o USING (id)) """


@query(G + DEGREES + "SELECT id, in_degree, out_degree, in_degree + out_degree AS degree FROM d")
def node_degrees(spark, sf_dir):
    return graph.degrees(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(G + DEGREES + """, t AS (SELECT id FROM d ORDER BY in_degree + out_degree DESC, id LIMIT 3000)
SELECT 'edge' AS kind, id FROM edges WHERE source_id IN (SELECT id FROM t) AND target_id IN (SELECT id FROM t) UNION ALL SELECT 'node', id FROM t""")
def degree_cap_subgraph(spark, sf_dir):
    return _both(*graph.most_connected(nodes(spark, sf_dir), edges(spark, sf_dir), 3000))


def _both(n, e):
    return n.select(F.lit("node").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), "id"))


@query(G + """, p AS (SELECT id FROM nodes ORDER BY id LIMIT 5000 OFFSET 50)
SELECT 'edge' AS kind, id FROM edges WHERE source_id IN (SELECT id FROM p) AND target_id IN (SELECT id FROM p) UNION ALL SELECT 'node', id FROM p""")
def paged_subgraph(spark, sf_dir):
    return _both(*graph.page(nodes(spark, sf_dir), edges(spark, sf_dir), 5000, 50))


@query(G + """, b AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges),
h(id, hops) AS (SELECT 'n:1', 0 UNION SELECT b.b, h.hops + 1 FROM h JOIN b ON b.a = h.id WHERE h.hops < 2), i AS (SELECT DISTINCT id FROM h)
SELECT id FROM edges WHERE source_id IN (SELECT id FROM i) AND target_id IN (SELECT id FROM i)""")
def khop_edges(spark, sf_dir):
    """The distinct edges of a subgraph of depth 2."""
    n, e = whole(spark, sf_dir)
    return graph.reached(e, n.where("id = 'n:1'"), 2).select("id")


@query(G + """, b AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges),
h(id, hops) AS (SELECT 'r:0', 0 UNION SELECT b.b, h.hops + 1 FROM h JOIN b ON b.a = h.id WHERE h.hops < 2)
SELECT id, min(hops)::INT AS hops FROM h GROUP BY id""")
def khop_subgraph(spark, sf_dir):
    n, e = whole(spark, sf_dir)
    return graph.within_hops(e, n.where("id = 'r:0'"), 2)


@query(G + """, b AS (SELECT source_id AS a, target_id AS b FROM edges WHERE relation = 'CREATED' UNION ALL SELECT target_id, source_id FROM edges WHERE relation = 'CREATED'),
h(id, hops) AS (SELECT 'c:1', 0 UNION SELECT b.b, h.hops + 1 FROM h JOIN b ON b.a = h.id WHERE h.hops < 3)
SELECT id, min(hops)::INT AS hops FROM h GROUP BY id""")
def filtered_traverse(spark, sf_dir):
    return graph.within_hops(edges(spark, sf_dir), nodes(spark, sf_dir).where("id = 'c:1'"), 3, ["CREATED"])


@query(G + """SELECT DISTINCT a.label || ' -[' || relation || ']-> ' || b.label AS line FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id
WHERE 'NATION_3' IN (a.label, b.label) ORDER BY line LIMIT 30""")
def relationship_lines(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return graph.relation_lines(n, edges(spark, sf_dir), n.where("label = 'NATION_3'"))


AGED = G + ", aged AS (SELECT *, TIMESTAMP '2024-01-31' - INTERVAL 1 DAY * (retrieval_count * 2) AS created_at FROM nodes) "


def aged(spark, sf_dir):
    """The nodes with a time of creation."""
    n = nodes(spark, sf_dir)
    return n.withColumn("created_at", F.lit("2024-01-31").cast("timestamp") - F.make_dt_interval(days=(F.col("retrieval_count") * 2).cast("int")))


@query(AGED + """SELECT a.id, a.type FROM aged a LEFT JOIN (SELECT source_id AS id FROM edges WHERE relation = 'CREATED' UNION SELECT target_id FROM edges WHERE relation = 'CREATED') e ON e.id = a.id
WHERE e.id IS NULL AND a.created_at < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def orphan_prune(spark, sf_dir):
    """Nodes that neither were created nor created any, older than seven days."""
    return upkeep.pruned(aged(spark, sf_dir), edges(spark, sf_dir).where("relation = 'CREATED'"), F.lit("2024-01-31").cast("timestamp")).select("id", "type")


@query(G + "SELECT relation, count(*) FILTER (WHERE greatest(0.1, weight * 0.99) <> weight) AS n_changed, round(sum(greatest(0.1, weight * 0.99)), 3) AS total FROM edges GROUP BY relation")
def edge_decay(spark, sf_dir):
    e = memory.decay_edges(edges(spark, sf_dir))
    return e.groupBy("relation").agg(F.sum(F.col("changed").cast("long")).alias("n_changed"), F.round(F.sum("weight"), 3).alias("total"))


AMONG = G + ", i AS (SELECT id FROM nodes WHERE retrieval_count >= 6) "


def _retrieved(spark, sf_dir):
    n, e = whole(spark, sf_dir)
    return e, n.where("retrieval_count >= 6").select("id")


@query(AMONG + "SELECT id, round(greatest(0.1, weight - 0.1), 6) AS weight FROM edges WHERE source_id IN (SELECT id FROM i) AND target_id IN (SELECT id FROM i)")
def hebbian_feedback(spark, sf_dir):
    return memory.feedback(*_retrieved(spark, sf_dir), success=False).select("id", F.round("weight", 6).alias("weight"))


@query(AMONG + "SELECT id, round(least(2.0, weight + 0.1), 6) AS weight FROM edges WHERE source_id IN (SELECT id FROM i) AND target_id IN (SELECT id FROM i)")
def hebbian_success(spark, sf_dir):
    return memory.feedback(*_retrieved(spark, sf_dir), success=True).select("id", F.round("weight", 6).alias("weight"))


@query(AMONG + "SELECT id, round(least(2.0, weight + 0.02), 6) AS weight FROM edges WHERE source_id IN (SELECT id FROM i) AND target_id IN (SELECT id FROM i)")
def implicit_reinforce(spark, sf_dir):
    return memory.feedback(*_retrieved(spark, sf_dir), success=True, step=0.02).select("id", F.round("weight", 6).alias("weight"))


@query(AMONG + """SELECT id, CASE WHEN id IN (SELECT id FROM i) THEN 1.0::DOUBLE ELSE energy END AS energy, retrieval_count + CASE WHEN id IN (SELECT id FROM i) THEN 1 ELSE 0 END AS retrieval_count,
epoch(CASE WHEN id IN (SELECT id FROM i) THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-31' - INTERVAL 1 DAY * (retrieval_count * 2) END)::BIGINT AS last_activated_at FROM nodes""")
def activation_boost(spark, sf_dir):
    """Nodes that are hit get full energy and a new time; the clocks of the others run on."""
    n = aged(spark, sf_dir).withColumnRenamed("created_at", "last_activated_at")
    out = memory.activate(n, n.where("retrieval_count >= 6"), F.lit("2024-02-01").cast("timestamp"))
    return out.select("id", "energy", "retrieval_count", F.col("last_activated_at").cast("long").alias("last_activated_at"))


@query(G + """, u AS (SELECT n.id, n.label, n.energy, n.retrieval_count, coalesce(avg(e.weight), 1.0) AS utility FROM nodes n LEFT JOIN edges e ON e.source_id = n.id
  WHERE coalesce(n.clearance, 1) <= 3 GROUP BY ALL),
s AS (SELECT id, label, utility * energy * exp(-0.05 / (1 + 0.1 * sqrt(retrieval_count)) * 12.0) AS score FROM u)
SELECT id, label, round(score, 6) AS score FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 40""")
def synaptic_rank(spark, sf_dir):
    n, e = nodes(spark, sf_dir).where(cleared(F.col("clearance"), 3)), edges(spark, sf_dir)
    use = e.groupBy(F.col("source_id").alias("id")).agg(F.avg("weight").alias("utility"))
    score = synaptic_score(F.col("utility"), F.col("energy"), F.col("retrieval_count"), F.lit(12.0))
    return n.join(use, "id", "left").withColumn("s", score).where("s >= 0.3").orderBy(F.desc("s"), "id").limit(40).select("id", "label", F.round("s", 6).alias("score"))


@query(G + "SELECT type, round(sum(least(1.0, greatest(0.0, energy * exp(-0.05 / (1 + 0.5 * sqrt(retrieval_count)) * 24.0)))), 4) AS energy FROM nodes GROUP BY type")
def dynamic_decay_energy(spark, sf_dir):
    e = dynamic_decay(F.col("energy"), F.col("retrieval_count"), F.lit(24.0))
    return nodes(spark, sf_dir).groupBy("type").agg(F.round(F.sum(e), 4).alias("energy"))


@query(G + """, b AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges UNION SELECT DISTINCT target_id, source_id FROM edges),
cc(id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION
  SELECT n.id, n.component FROM (SELECT b.b AS id, min(c.component) AS component FROM cc c JOIN b ON b.a = c.id GROUP BY b.b) n JOIN recurring.cc o ON o.id = n.id WHERE n.component < o.component)
SELECT id, component FROM cc""")
def connected_components(spark, sf_dir):
    return graph.components(*whole(spark, sf_dir))


PR = G + """, p AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges), o AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT count(*) AS n FROM nodes),
r0 AS (SELECT id, 1.0 / c.n AS r FROM nodes, c)"""
for _i in range(1, 6):
    PR += f""", r{_i} AS (SELECT nodes.id, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + l.lost / c.n) AS r FROM nodes CROSS JOIN c
  CROSS JOIN (SELECT coalesce(sum(r), 0) AS lost FROM r{_i - 1} WHERE id NOT IN (SELECT a FROM o)) l
  LEFT JOIN (SELECT p.b, sum(r / o.n) AS got FROM p JOIN r{_i - 1} q ON q.id = p.a JOIN o ON o.a = p.a GROUP BY p.b) g ON g.b = nodes.id)"""


@query(PR + " SELECT id, round(r, 9) AS rank FROM r5")
def pagerank_fixed_iter(spark, sf_dir):
    return graph.pagerank(*whole(spark, sf_dir), rounds=5).select("id", F.round("rank", 9).alias("rank"))


PATHS = G + """, s AS (SELECT * FROM edges), p AS (SELECT a.source_id || ' -> ' || a.target_id AS path, 1 AS n, a.weight AS w FROM s a WHERE a.source_id LIKE 'c:%'
      UNION ALL SELECT a.source_id || ' -> ' || a.target_id || ' -> ' || b.target_id, 2, a.weight + b.weight FROM s a JOIN s b ON b.source_id = a.target_id WHERE a.source_id LIKE 'c:%') """


@query(PATHS + "SELECT n::INT AS n_edges, count(*) AS n_paths, round(sum(w), 3) AS weight, min(path) AS first_path, max(path) AS last_path FROM p GROUP BY n")
def simple_paths(spark, sf_dir):
    found = graph.simple_paths(edges(spark, sf_dir), nodes(spark, sf_dir).where("type = 'PERSON'"), 2)
    rows = found.select(F.size("relations").alias("n_edges"), F.array_join("path", " -> ").alias("path"), F.aggregate("weights", F.lit(0.0), lambda s, w: s + w).alias("w"))
    return rows.groupBy("n_edges").agg(F.count("*").alias("n_paths"), F.round(F.sum("w"), 3).alias("weight"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@query(G + """, p AS (SELECT a.source_id AS start, b.target_id AS fin, a.source_id || ' -> ' || a.target_id || ' -> ' || b.target_id AS path, (a.weight + b.weight) / 2 AS w
  FROM edges a JOIN edges b ON b.source_id = a.target_id JOIN nodes u ON u.id = a.source_id JOIN nodes v ON v.id = a.target_id JOIN nodes z ON z.id = b.target_id
  WHERE a.relation = 'CREATED' AND b.relation = 'CONTAINS' AND greatest(coalesce(u.clearance, 0), coalesce(v.clearance, 0), coalesce(z.clearance, 0)) <= 4),
q AS (SELECT p.*, n.energy, n.retrieval_count = 4 AS doubt FROM p JOIN nodes n ON n.id = p.fin WHERE p.start IN (SELECT id FROM nodes WHERE retrieval_count > 0)),
c AS (SELECT start, path, row_number() OVER (PARTITION BY start ORDER BY energy DESC, w DESC, path) AS r FROM q WHERE energy > 0.8 AND w >= 0.7),
x AS (SELECT start, path, row_number() OVER (PARTITION BY start ORDER BY energy, w, path) AS r FROM q WHERE (energy < 0.2 OR doubt) AND w <= 0.45)
SELECT c.start, c.path AS chosen, x.path AS rejected FROM c JOIN x ON x.start = c.start WHERE c.r = 1 AND x.r = 1 AND c.path <> x.path""")
def dpo_pairs(spark, sf_dir):
    """Chosen and rejected paths of which the caller may see every node; ends that wait for a human are rejected too."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir).where(F.col("relation").isin("CREATED", "CONTAINS"))
    n = n.withColumn("needs_human", F.col("retrieval_count") == 4)
    seen = n.where(cleared(F.col("clearance"), 4, 0))
    ends = seen.where((F.col("energy") > 0.8) | (F.col("energy") < 0.2) | F.col("needs_human"))  # others are neither chosen nor rejected
    starts = seen.where("type = 'PERSON' and retrieval_count > 0")
    return training.dpo_pairs(graph.simple_paths(e, starts, 2, 2, through=seen, ends=ends), n, bad=0.45)


@query(G + """, x AS (SELECT id FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id HAVING count(*) >= 2),
l AS (SELECT source_id, target_id, a.label || ' (' || a.type || ') --[' || relation || ']--> ' || b.label || ' (' || b.type || ')' AS line FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id)
SELECT source_id AS id, line FROM l WHERE source_id IN (SELECT id FROM x) UNION ALL SELECT target_id, line FROM l WHERE target_id IN (SELECT id FROM x)""")
def factual_facts(spark, sf_dir):
    return training.fact_lines(*whole(spark, sf_dir))


@query(G + """SELECT a.agent_id, a.id AS id, count(e.id) AS n_edges FROM nodes a LEFT JOIN edges e ON e.source_id = a.id AND e.target_id IN (SELECT id FROM nodes WHERE type = 'LOCATION')
WHERE a.type IN ('PERSON', 'LOCATION') GROUP BY 1, 2""")
def scope_filter(spark, sf_dir):
    n, e = whole(spark, sf_dir)
    n, e = graph.scoped(n, e, ["person", "Location"], ["located_in", "part_of"])
    return n.join(e.select(F.col("id").alias("edge"), "source_id"), F.col("id") == F.col("source_id"), "left").groupBy("agent_id", "id").agg(F.count("edge").alias("n_edges"))


@query(G + """, new AS (SELECT replace(id, 'c:', 'c:1') AS id, 'new ' || label AS label, '{"v": 2}' AS properties, agent_id, type FROM nodes WHERE type = 'PERSON' AND retrieval_count = 3)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.label, n.label) AS label, coalesce(n.properties, '{"v": 1}') AS properties, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NOT NULL THEN 'merged' ELSE 'kept' END AS action
FROM (SELECT * FROM nodes WHERE type = 'PERSON') o FULL JOIN new n ON n.id = o.id""")
def node_upsert(spark, sf_dir):
    n = nodes(spark, sf_dir).where("type = 'PERSON'")
    old = n.select("id", "label", "type", "agent_id", F.lit('{"v": 1}').alias("properties"))
    new = n.where("retrieval_count = 3").select(F.replace("id", F.lit("c:"), F.lit("c:1")).alias("id"), F.concat(F.lit("new "), "label").alias("label"), "type", "agent_id", F.lit('{"v": 2}').alias("properties"))
    return memory.upsert_nodes(old, new, F.lit("2024-02-01").cast("timestamp")).select("id", "label", "properties", "action")


@query(G + """, new AS (SELECT CASE WHEN right(source_id, 1) IN ('1', '2', '3') THEN id ELSE id || '!' END AS id, source_id, CASE WHEN right(source_id, 1) = '7' THEN 'n:none' ELSE target_id END AS target_id, agent_id, '{"from":' || (length(id) % 3) || '}' AS properties FROM edges WHERE weight > 0.8),
ok AS (SELECT * FROM new e WHERE EXISTS (SELECT 1 FROM nodes WHERE id = source_id AND agent_id = e.agent_id) AND EXISTS (SELECT 1 FROM nodes WHERE id = target_id AND agent_id = e.agent_id))
SELECT CASE WHEN o.id IS NULL THEN 'created' WHEN k.id IS NULL THEN 'kept' ELSE 'merged' END AS state, coalesce(o.id, k.id) AS id, coalesce(o.relation, 'OTHER') AS relation, coalesce(o.weight, 0.5)::DOUBLE AS weight, k.properties
FROM edges o FULL JOIN ok k ON k.id = o.id AND k.source_id = o.source_id AND k.target_id = o.target_id
UNION ALL SELECT 'left', id, 'OTHER', 0.5, properties FROM new e WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.id = e.id AND ok.source_id = e.source_id AND ok.target_id = e.target_id)""")
def edge_upsert(spark, sf_dir):
    """Edges that are there keep relation and weight and take the new bag; new ones are made; those without both ends are left."""
    n, e = whole(spark, sf_dir)
    there = F.right("source_id", F.lit(1)).isin("1", "2", "3")
    new = e.where("weight > 0.8").select(
        F.when(there, F.col("id")).otherwise(F.concat("id", F.lit("!"))).alias("id"), "source_id", F.when(F.endswith("source_id", F.lit("7")), F.lit("n:none")).otherwise(F.col("target_id")).alias("target_id"),
        F.lit("OTHER").alias("relation"), F.lit(0.5).alias("weight"), "agent_id", F.concat(F.lit('{"from":'), (F.length("id") % 3).cast("string"), F.lit("}")).alias("properties"))
    old = e.select("id", "source_id", "target_id", "relation", "weight", "agent_id", F.lit(None).cast("string").alias("properties"))
    merged, bad = memory.upsert_edges(old, new, n)
    state = F.when(F.endswith("id", F.lit("!")), "created").when(F.col("properties").isNull(), "kept").otherwise("merged")
    return merged.select(state.alias("state"), "id", "relation", "weight", "properties").unionByName(bad.select(F.lit("left").alias("state"), "id", "relation", "weight", "properties"))


@query(G + "SELECT id, label, energy FROM nodes WHERE retrieval_count = 3")
def node_versions(spark, sf_dir):
    n, _ = whole(spark, sf_dir)
    return memory.versions(n, n.where("retrieval_count = 3"), F.lit("2024-02-01").cast("timestamp")).select("id", "label", "energy")


@query(G + "SELECT (SELECT count(*) FROM nodes WHERE id <> 'n:3') AS n_nodes, (SELECT count(*) FROM edges WHERE 'n:3' NOT IN (source_id, target_id)) AS n_edges")
def cascade_delete(spark, sf_dir):
    n, e = memory.delete_nodes(*whole(spark, sf_dir), whole(spark, sf_dir)[0].where("id = 'n:3'"))
    return n.agg(F.count("*").alias("n_nodes")).crossJoin(e.agg(F.count("*").alias("n_edges")))


@query(G + """, x AS (SELECT id FROM nodes WHERE agent_id = 'agent2') SELECT (SELECT count(*) FROM x) AS n_nodes,
(SELECT count(*) FROM edges WHERE source_id IN (SELECT id FROM x) OR target_id IN (SELECT id FROM x)) AS n_edges""")
def tenant_delete(spark, sf_dir):
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    gone = n.where("agent_id = 'agent2'")
    kept = memory.delete_nodes(n, e, gone)[1]
    return gone.agg(F.count("*").alias("n_nodes")).crossJoin(e.agg(F.count("*").alias("a"))).crossJoin(kept.agg(F.count("*").alias("b"))).select("n_nodes", (F.col("a") - F.col("b")).alias("n_edges"))


@query(G + """SELECT count(*) AS n_nodes, (SELECT count(*) FROM edges) + (SELECT count(*) FROM nodes) + 4 AS n_edges FROM (SELECT id FROM nodes UNION ALL SELECT DISTINCT agent_id FROM nodes)""")
def multiverse_graph(spark, sf_dir):
    n, e = whole(spark, sf_dir)
    hubs = n.select("agent_id", F.upper("agent_id").alias("name")).distinct()
    shares = hubs.where("agent_id <> 'agent0'").select(F.lit("agent0").alias("source"), F.col("agent_id").alias("target"))
    a, b = graph.multiverse(n, e, hubs, shares)
    return a.agg(F.count("*").alias("n_nodes")).crossJoin(b.agg(F.count("*").alias("n_edges")))


@query(G + """, c AS (SELECT id, CASE WHEN id LIKE 's:%' THEN 'n:0' ELSE id END AS t FROM nodes), e AS (SELECT a.t AS s, b.t AS g, relation, max(weight) AS weight FROM edges JOIN c a ON a.id = source_id JOIN c b ON b.id = target_id WHERE a.t <> b.t GROUP BY ALL)
SELECT s AS source_id, g AS target_id, relation, weight FROM e""")
def remapped_edges(spark, sf_dir):
    n, e = whole(spark, sf_dir)
    canonical = n.where("id like 's:%'").select("id", F.lit("n:0").alias("canonical_id"))
    return memory.remap_edges(e, canonical).select("source_id", "target_id", "relation", "weight")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(1 - levenshtein(lower(a.s_name), lower(b.s_name)) / greatest(length(a.s_name), length(b.s_name)), 6) AS similarity FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey WHERE levenshtein(lower(a.s_name), lower(b.s_name)) <= 0.15 * greatest(length(a.s_name), length(b.s_name))")
def fuzzy_labels(spark, sf_dir):
    """Pairs of suppliers of one nation whose names are alike, equal ones among them."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").cast("string").alias("agent_id"))
    equal = F.lower("label").alias("l")
    same = retrieval.joined_by_label(s.select("agent_id", "id", equal), s.select("agent_id", F.col("id").alias("match_id"), equal), ["agent_id", "l"]).select("id", "match_id", F.lit(1.0).alias("similarity"))
    found = retrieval.fuzzy_pairs(s, s, "agent_id").unionByName(same).where("id < match_id")
    return found.select(F.col("id").alias("a"), F.col("match_id").alias("b"), F.round("similarity", 6).alias("similarity"))


RESOLVE = f"""WITH {VECTORS}, k AS (SELECT *, 'entity ' || substr(md5(id::VARCHAR), 1, 12) AS label FROM vecs),
x AS (SELECT a.id, a.agent_id, b.id AS m, list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) AS s FROM k a JOIN k b ON b.agent_id = a.agent_id WHERE a.id % 4 = 3 AND a.id % 20 <> 19),
y AS (SELECT id, m, row_number() OVER (PARTITION BY id ORDER BY s DESC, m) AS r FROM x WHERE s >= 0.9) """


def _resolution(spark, sf_dir):
    """Known entities of the vector table, and new ones that stand for them by label, alias, spelling or vector; some are facts."""
    v = vector_nodes(spark, sf_dir)
    md5 = lambda *c: F.substring(F.md5(F.concat(*c).cast("binary")), 1, 12)
    key = F.col("id").cast("string")
    known = v.select("id", F.concat(F.lit("entity "), md5(key)).alias("label"), F.lit("CONCEPT").alias("type"), "agent_id", F.col("id").alias("ordinal"), F.array(F.concat(F.lit("aka "), md5(F.lit("a"), key))).alias("aliases"), "embedding", F.lit('{"seen": 1, "tags": ["k"], "of": {"n": null}}').alias("properties"))
    way = F.col("id") % 4
    label = F.when(way == 0, F.upper("label")).when(way == 1, F.concat(F.lit("AKA "), md5(F.lit("a"), key))).when(way == 2, F.expr("left(label, length(label) - 1)")).otherwise(F.concat(F.lit("other "), md5(F.lit("z"), key)))
    new = known.select(F.concat(F.lit("x"), key).alias("id"), label.alias("label"), F.when(F.col("id") % 20 == 19, "FACT").otherwise(F.col("type")).alias("type"), "agent_id", "embedding", F.concat(F.lit('{"from": "'), key, F.lit('"}')).alias("properties"))
    return new, known


@query(RESOLVE + "SELECT 'x' || id AS id, id AS match_id, CASE WHEN id % 4 < 2 THEN 1 ELSE 2 END::INT AS stage FROM k WHERE id % 4 < 3 UNION ALL SELECT 'x' || id, m, 3 FROM y WHERE r = 1")
def entity_resolve(spark, sf_dir):
    """Label, alias, spelling, vector: every rule fires."""
    return retrieval.resolve(*_resolution(spark, sf_dir))


@query(RESOLVE + """, w AS (SELECT id, id AS m FROM k WHERE id % 4 < 3 UNION ALL SELECT id, m FROM y WHERE r = 1)
SELECT m AS id, count(*) AS n_merged, count(*) FILTER (WHERE w.id % 4 <> 0) + (max(CASE WHEN w.id % 4 = 1 THEN 0 ELSE 1 END)) AS n_aliases,
       '{"seen":1,"tags":["k"],"of":{"n":null},"from":"' || max('x' || w.id)[2:] || '"}' AS properties FROM w GROUP BY m""")
def resolved_merge(spark, sf_dir):
    """Bags and aliases of the known entities after resolution."""
    new, known = _resolution(spark, sf_dir)
    matches = graph.cut_lineage(retrieval.resolve(new, known))
    merged = retrieval.merged_matches(new, known, matches)
    n = matches.groupBy(F.col("match_id").alias("id")).agg(F.count("*").alias("n_merged"))
    return merged.join(n, "id").select("id", "n_merged", F.size(F.array_distinct(F.transform("aliases", F.lower))).cast("long").alias("n_aliases"), "properties")


@query(G + """, sc AS (SELECT n.id, n.label, coalesce(avg(e.weight), 1.0) * n.energy AS s FROM nodes n LEFT JOIN edges e ON e.source_id = n.id
  WHERE coalesce(n.clearance, 1) <= 4 AND (lower(n.label) LIKE '%widget%' OR lower(n.label) LIKE '%ring%') GROUP BY n.id, n.label, n.energy),
top AS (SELECT * FROM sc WHERE s >= 0.3 ORDER BY s DESC, id LIMIT 15)
SELECT DISTINCT a.label || ' -[' || relation || ']-> ' || b.label AS line FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id
WHERE source_id IN (SELECT id FROM top) OR target_id IN (SELECT id FROM top) ORDER BY line LIMIT 30""")
def retrieve_context(spark, sf_dir):
    """Keyword seeds, clearance, score, top, relation lines: the flagship."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    hit = F.exists(F.array(F.lit("widget"), F.lit("ring")), lambda k: F.contains(F.lower("label"), k))
    seeds = n.where(cleared(F.col("clearance"), 4) & hit)
    use = e.join(seeds.select(F.col("id").alias("source_id")), "source_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.avg("weight").alias("utility"))
    score = synaptic_score(F.col("utility"), F.col("energy"), F.lit(1), F.lit(0.0))
    top = seeds.join(use, "id", "left").withColumn("s", score).where("s >= 0.3").orderBy(F.desc("s"), "id").limit(15)
    return graph.relation_lines(n, e, top)


@query(G + "SELECT source_id, id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, id) AS r FROM edges) WHERE r <= 5")
def context_edge_cap(spark, sf_dir):
    r = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("weight"), "id"))
    return edges(spark, sf_dir).withColumn("r", r).where("r <= 5").select("source_id", "id", "weight")
