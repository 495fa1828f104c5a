"""Lookups, access rules and writes over the documents as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import properties, texts
from loomspark.operators import access, analytics, graph, ingest, memory, upkeep, writes
from loomspark.operators.folders import parts_of, scratch
from loomspark.operators.model_calls import CallCache
from loomspark.plans.catalog import query, table
from loomspark.sources.star import DOCS, document_edges, document_nodes

D = f"WITH {DOCS} "
NOW = "2024-01-31"


def now():
    return F.lit(NOW).cast("timestamp")


@query(D + "SELECT id, label, type FROM docs WHERE id = 17")
def point_lookup(spark, sf_dir):
    return access.matched(document_nodes(spark, sf_dir), columns=["id", "label", "type"], id=17)


@query(D + "SELECT id, label FROM docs WHERE agent_id = 'agent3' ORDER BY id LIMIT 12")
def first_nodes(spark, sf_dir):
    return access.matched(document_nodes(spark, sf_dir), 12, ["id", "label"], agent_id="agent3")


@query(D + "SELECT id FROM docs WHERE agent_id = 'agent2' AND type = 'EN' AND clearance IS NULL")
def match_nodes(spark, sf_dir):
    return access.matched(document_nodes(spark, sf_dir), None, ["id"], agent_id="agent2", type="EN", clearance=None)


@query(D + "SELECT id, label, type, energy FROM docs WHERE agent_id = 'agent1'")
def node_scan(spark, sf_dir):
    """A tenant's nodes without vectors; only four columns are read."""
    return access.without_vectors(document_nodes(spark, sf_dir).withColumn("embedding", F.array(F.lit(0.0))), "agent1").select("id", "label", "type", "energy")


@query(D + "SELECT id, created_at FROM docs WHERE agent_id = 'agent4' ORDER BY created_at DESC, id LIMIT 15")
def list_recent(spark, sf_dir):
    return access.recent(document_nodes(spark, sf_dir), "agent4", 15).select("id", "created_at")


@query(D + "SELECT CASE WHEN id % 6 = 0 THEN 'fact' ELSE 'entity' END AS kind, count(*) AS n FROM docs GROUP BY 1")
def fact_split(spark, sf_dir):
    n = document_nodes(spark, sf_dir).withColumn("type", F.when(F.col("id") % 6 == 0, "FACT").when(F.col("id") % 6 != 1, F.col("type")))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in zip(("fact", "entity"), access.split_facts(n), strict=True)]
    return parts[0].unionByName(parts[1])


@query(D + "SELECT id FROM docs WHERE type IN ('DE', 'FR')")
def type_filter(spark, sf_dir):
    return access.of_types(document_nodes(spark, sf_dir), ["de", "Fr"]).select("id")


LEVELS = "a AS (SELECT user_id AS agent_id, (CASE WHEN user_id % 4 <> 0 THEN user_id % 9 END) AS level FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0)), c AS (SELECT DISTINCT user_id AS agent_id FROM events)"


def _levels(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id")).distinct()
    return u, u.where("agent_id % 3 <> 0").select("agent_id", F.when(F.col("agent_id") % 4 != 0, F.col("agent_id") % 9).alias("clearance_level"))


@query(f"WITH {LEVELS} SELECT agent_id, coalesce(level, 1)::INT AS clearance FROM c LEFT JOIN a USING (agent_id)")
def clearance_open(spark, sf_dir):
    return access.caller_clearance(*_levels(spark, sf_dir))


@query(f"WITH {LEVELS} SELECT agent_id, CASE WHEN level BETWEEN 1 AND 5 THEN level ELSE 0 END::INT AS clearance FROM c LEFT JOIN a USING (agent_id)")
def clearance_closed(spark, sf_dir):
    return access.caller_clearance(*_levels(spark, sf_dir), closed=True)


CONNECTIONS = """c AS (SELECT event_id AS id, 'agent' || (user_id % 20) AS s, 'agent' || (event_id % 20) AS t, event_id % 5 <> 0 AS active, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 10 DAY END AS expires_at, ts AS created_at FROM events)"""


def _connections(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("id"), F.concat(F.lit("agent"), (F.col("user_id") % 20).cast("string")).alias("source_agent_id"), F.concat(F.lit("agent"), (k % 20).cast("string")).alias("target_agent_id"), (k % 5 != 0).alias("active"),
        F.when(k % 3 != 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"), F.col("ts").alias("created_at"))


@query(f"""WITH {CONNECTIONS}, r AS (SELECT DISTINCT s, t FROM c)
SELECT s AS source_agent_id, t AS target_agent_id, EXISTS (SELECT 1 FROM c WHERE c.s = r.s AND c.t = r.t AND active AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')) AS allowed FROM r""")
def access_check(spark, sf_dir):
    c = _connections(spark, sf_dir)
    return access.allowed_pairs(c.select("source_agent_id", "target_agent_id").distinct(), c, now())


@query(f"WITH {CONNECTIONS} SELECT id, created_at FROM c WHERE 'agent7' IN (s, t) AND active")
def connection_list(spark, sf_dir):
    return access.connections_of(_connections(spark, sf_dir), "agent7").select("id", "created_at")


@query(f"WITH {CONNECTIONS} SELECT active AND id NOT IN (1, 2, 3, 4, 5, 6) AS active, id IN (1, 2, 3, 4, 5, 6) AS revoked, count(*) AS n FROM c GROUP BY 1, 2")
def soft_revoke(spark, sf_dir):
    c = access.revoked(_connections(spark, sf_dir), [str(i) for i in range(1, 7)], now())
    return c.groupBy("active", F.col("revoked_at").isNotNull().alias("revoked")).agg(F.count("*").alias("n"))


SHARES = "h AS (SELECT DISTINCT agent_id FROM docs), s AS (SELECT DISTINCT 'agent' || (user_id % 5) AS source, 'agent' || (event_id % 5) AS target FROM events WHERE user_id % 5 < event_id % 5 AND event_id % 7 = 0)"


def _shares(spark, sf_dir):
    hubs = document_nodes(spark, sf_dir).select("agent_id").distinct()
    a, b = F.col("user_id") % 5, F.col("event_id") % 5
    links = table(spark, sf_dir, "events").where((a < b) & (F.col("event_id") % 7 == 0)).select(F.concat(F.lit("agent"), a.cast("string")).alias("source"), F.concat(F.lit("agent"), b.cast("string")).alias("target")).distinct()
    return hubs, links


@query(D + f", {SHARES} SELECT agent_id, agent_id AS allowed FROM h UNION SELECT source, target FROM s WHERE source IN (SELECT agent_id FROM h)")
def sharing_expansion(spark, sf_dir):
    return access.shared_with(*_shares(spark, sf_dir))


@query(D + """SELECT id, CASE WHEN id % 2 = 0 AND description <> '' THEN description WHEN id % 2 = 1 AND lang <> '' THEN lang END AS description, nullif(source_text, '') AS source_text FROM docs""")
def text_promotion(spark, sf_dir):
    """Descriptions from the bag where the column is empty."""
    n = document_nodes(spark, sf_dir)
    bag = F.to_json(F.struct(F.get_json_object("properties", "$.lang").alias("description")))
    n = n.withColumns({"description": F.when(F.col("id") % 2 == 0, F.col("description")).otherwise(F.lit("")), "properties": F.when(F.col("id") % 2 == 1, bag)})
    return writes.promote(n).select("id", "description", "source_text")


@query(D + "SELECT id, 'temporal=' || temporal || '|n=' || n || '|lang=' || lang || '|tags=[\"a\"]|confidence=0.5' AS flat FROM docs")
def property_flatten(spark, sf_dir):
    flat = F.array_join(F.transform(F.map_entries(properties.flattened(F.col("properties"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return document_nodes(spark, sf_dir).select("id", flat.alias("flat"))


@query(D + "SELECT id, 'n: ' || n || '|lang: ' || lang AS shown FROM docs")
def property_projection(spark, sf_dir):
    return document_nodes(spark, sf_dir).select("id", F.array_join(properties.shown(F.col("properties")), "|").alias("shown"))


@query(D + "SELECT id, 'n' || n || ' new' AS said FROM docs")
def property_merge(spark, sf_dir):
    """Two bags, the newer values first in rank."""
    both = properties.merged(F.col("properties"), F.lit('{"lang": "new", "x": [1]}'))
    return document_nodes(spark, sf_dir).select("id", F.concat(F.lit("n"), F.get_json_object(both, "$.n"), F.lit(" "), F.get_json_object(both, "$.lang")).alias("said"))


@query(D + ", h AS (SELECT DISTINCT agent_id FROM docs) SELECT agent_id, CASE WHEN agent_id IN ('agent1', 'agent9') THEN 'renamed' ELSE upper(agent_id) END AS name FROM (SELECT agent_id FROM h UNION SELECT 'agent9')")
def hub_upsert(spark, sf_dir):
    hubs = document_nodes(spark, sf_dir).select("agent_id", F.upper("agent_id").alias("name")).distinct()
    return writes.upsert_hubs(hubs, spark.createDataFrame([("agent1", "renamed"), ("agent9", "renamed")], "agent_id string, name string"))


@query(D + f""", {SHARES}, n AS (SELECT * FROM (VALUES ('agent0', 'agent1'), ('agent4', 'agent0'), ('agent0', 'agent77')) v(source, target)), g AS (SELECT * FROM n WHERE source IN (SELECT agent_id FROM h) AND target IN (SELECT agent_id FROM h))
SELECT 'link' AS kind, source, target FROM (SELECT * FROM s UNION SELECT * FROM g) EXCEPT SELECT 'link', 'agent4', 'agent0' UNION ALL SELECT 'refused', source, target FROM n WHERE target = 'agent77' UNION ALL SELECT 'deleted', '1', NULL""")
def agent_links(spark, sf_dir):
    """Links are added between known agents, listed, and one is deleted again."""
    hubs, links = _shares(spark, sf_dir)
    new = spark.createDataFrame([("agent0", "agent1"), ("agent4", "agent0"), ("agent0", "agent77")], "source string, target string")
    links, refused = writes.add_links(links, new, hubs)
    left, n = writes.remove_links(links, new.where("source = 'agent4'"))
    told = lambda df, k: df.select(F.lit(k).alias("kind"), "source", "target")
    return told(left, "link").unionByName(told(refused, "refused")).unionByName(n.select(F.lit("deleted").alias("kind"), F.col("n_deleted").cast("string").alias("source"), F.lit(None).cast("string").alias("target")))


@query(D + "SELECT id, CASE WHEN id % 9 = 0 THEN 'new' || id ELSE type END AS type, id % 9 = 0 AS matched FROM docs")
def set_type(spark, sf_dir):
    n = document_nodes(spark, sf_dir)
    changes = n.where("id % 9 = 0").select("id", F.concat(F.lit("new"), F.col("id").cast("string")).alias("value")).unionByName(spark.createDataFrame([(-5, "nobody")], "id long, value string"))
    return writes.set_column(n, changes, "type").select("id", "type", "matched")


TALKS = """t AS (SELECT conv_id * 1000 + turn AS id, 'agent' || (conv_id % 5) AS agent_id, conv_id, text FROM conversations WHERE role = 'user'), b AS (SELECT id, unnest([conv_id, conv_id + 1, -9]) AS node FROM t)"""


def _talks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    turns = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("agent"), (F.col("conv_id") % 5).cast("string")).alias("agent_id"), F.col("conv_id").alias("session_id"), F.col("text").alias("question"),
        F.concat("text", F.lit("!"), "text", F.lit("!"), "text").alias("answer"), now().alias("timestamp"), F.array(F.col("conv_id"), F.col("conv_id") + 1, F.lit(-9).cast("long")).alias("source_node_ids"))
    return writes.record_interactions(turns, document_nodes(spark, sf_dir))


@query(D + f", {TALKS} SELECT t.id, substr(text, 1, 200) AS question, length(substr(text || '!' || text || '!' || text, 1, 500))::INT AS answer_chars, (SELECT count(*) FROM b WHERE b.id = t.id AND node IN (SELECT id FROM docs)) AS n_sources FROM t")
def record_interaction(spark, sf_dir):
    talks, informed = _talks(spark, sf_dir)
    n = informed.groupBy(F.col("interaction_id").alias("id")).agg(F.count("*").alias("n"))
    return talks.join(n, "id", "left").select("id", "question", F.length("answer_summary").alias("answer_chars"), F.coalesce("n", F.lit(0)).alias("n_sources"))


@query(D + f", {TALKS} SELECT (SELECT count(*) FROM t WHERE agent_id <> 'agent2') AS n_left, (SELECT count(*) FROM b JOIN t USING (id) WHERE agent_id <> 'agent2' AND node IN (SELECT id FROM docs)) AS n_links, (SELECT count(*) FROM t WHERE agent_id = 'agent2') AS n_deleted")
def interactions_delete(spark, sf_dir):
    talks, informed, n = writes.delete_interactions(*_talks(spark, sf_dir), "agent2")
    return talks.agg(F.count("*").alias("n_left")).crossJoin(informed.agg(F.count("*").alias("n_links"))).crossJoin(n)


@query(D + f""", {TALKS} SELECT (SELECT count(*) FROM docs WHERE agent_id = 'agent3') AS n_nodes, (SELECT count(*) FROM links WHERE source_id % 5 = 3 AND target_id % 5 = 3) AS n_edges,
(SELECT count(*) FROM t WHERE agent_id = 'agent3') AS n_interactions, (SELECT count(*) FROM b JOIN t USING (id) WHERE agent_id = 'agent3' AND node IN (SELECT id FROM docs)) AS n_sources""")
def full_export(spark, sf_dir):
    talks, informed = _talks(spark, sf_dir)
    out = writes.full_export(document_nodes(spark, sf_dir), document_edges(spark, sf_dir), talks, informed, "agent3")
    return out["counts"].crossJoin(out["interactions"].agg(F.sum(F.size("source_node_ids")).cast("long").alias("n_sources")))


@query("WITH r AS (SELECT user_id AS connector_id, event_type AS source_uri, event_id AS cursor, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT connector_id, source_uri, cursor FROM r WHERE r = 1")
def run_state(spark, sf_dir):
    """The state of each connector and source after a second run."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("connector_id"), F.col("event_type").alias("source_uri"), F.col("event_id").alias("cursor"), F.struct("ts", "event_id").alias("updated_at"))
    cut = F.lit("2024-01-15").cast("timestamp")
    first = upkeep.first_per(e.where(F.col("updated_at.ts") < cut), ["connector_id", "source_uri"], F.desc("updated_at"))
    return writes.run_states(first, e.where(F.col("updated_at.ts") >= cut), ["connector_id", "source_uri"]).select("connector_id", "source_uri", "cursor")


@query(D + f"""SELECT id AS node_id, label AS node_label, (SELECT count(*) FROM links WHERE source_id = docs.id OR target_id = docs.id) AS deleted_edges, TIMESTAMP '{NOW}' + INTERVAL 365 DAY AS expires_at FROM docs WHERE id % 10 = 0""")
def delete_audit(spark, sf_dir):
    gone = document_nodes(spark, sf_dir).where("id % 10 = 0")
    audit = writes.deletion_audit(gone, document_edges(spark, sf_dir), now())
    return writes.live_rows(audit, now()).select("node_id", "node_label", "deleted_edges", "expires_at")


@query(D + """SELECT CASE WHEN source_id % 4 = 0 THEN substr(sha256(source_id || '>' || relation || '>' || target_id), 1, 32) ELSE id END AS id, CASE WHEN source_id % 6 = 0 THEN 1.0 ELSE weight END AS weight FROM links""")
def boot_migration(spark, sf_dir):
    e = document_edges(spark, sf_dir).withColumns({"id": F.when(F.col("source_id") % 4 != 0, F.col("id")), "weight": F.when(F.col("source_id") % 6 != 0, F.col("weight"))})
    return writes.migrated(document_nodes(spark, sf_dir), e)[1].select("id", "weight")


@query(D + "SELECT id, CASE WHEN id % 3 = 0 THEN 1.0 ELSE energy END AS energy, CASE WHEN id % 4 = 0 THEN 0 ELSE retrieval_count END AS retrieval_count, id % 3 = 0 OR id % 4 = 0 AS changed FROM docs")
def cognitive_backfill(spark, sf_dir):
    n = document_nodes(spark, sf_dir).withColumns({"energy": F.when(F.col("id") % 3 != 0, F.col("energy")), "retrieval_count": F.when(F.col("id") % 4 != 0, F.col("retrieval_count")), "last_activated_at": now()})
    return writes.backfilled(n, now()).select("id", "energy", "retrieval_count", "changed")


def _lengths(batch: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(len(t) % 7)] for t in batch]


@query(D + "SELECT id, length(t)::DOUBLE AS a, (length(t) % 7)::DOUBLE AS b FROM (SELECT id, label || CASE WHEN description <> '' THEN ': ' || description ELSE '' END || CASE WHEN source_text <> '' AND source_text IS DISTINCT FROM description THEN ' — ' || substr(source_text, 1, 300) ELSE '' END AS t FROM docs)")
def reembed(spark, sf_dir):
    """Each node's text by a stand-in for an embedding service, in batches."""
    text = properties.embedding_text(*[F.col(c) for c in ("type", "label", "description", "source_text")])
    out = writes.reembedded(document_nodes(spark, sf_dir), text, _lengths)
    return out.select("id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


@query("""SELECT doc_id, text IS NOT NULL AS has_text, length(text)::DOUBLE AS a, length(text)::DOUBLE AS again,
(SELECT count(DISTINCT text) FROM documents) AS n_cached, 0::BIGINT AS n_twice FROM documents""")
def embed_batch(spark, sf_dir):
    """Every distinct text is embedded once, and not at all in a second run; answers are joined back by key."""
    cache = CallCache.create(spark, scratch(spark, "calls"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").isNotNull().alias("has_text"))
    half = cache.ask(d.where("doc_id % 2 = 0"), "text", "lengths", _lengths)  # a run before, over some of the rows
    half.write.format("noop").mode("overwrite").save()
    first = cache.ask(d, "text", "lengths", _lengths, "one", "call_key")
    out = cache.ask(first, "text", "lengths", _lengths, "two", "call_key")
    kept = parts_of(spark, f"{cache.path}/answers")
    counts = kept.agg(F.countDistinct("key").alias("n_cached"), (F.count("*") - F.countDistinct("key")).alias("n_twice"))
    return out.crossJoin(F.broadcast(counts)).select("doc_id", "has_text", F.col("one")[0].alias("a"), F.col("two")[0].alias("again"), "n_cached", "n_twice")


@query(D + "SELECT id, CASE WHEN id % 8 = 0 THEN 'critic' WHEN id % 8 = 4 THEN NULL WHEN id % 4 = 1 THEN 'old' END AS needs_agent FROM docs")
def pheromone_mark(spark, sf_dir):
    n = document_nodes(spark, sf_dir).withColumn("needs_agent", F.when((F.col("id") % 4).isin(0, 1), "old"))
    marks = n.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "critic").alias("needs_agent"))
    return writes.mark_nodes(n, marks, now())[0].select("id", "needs_agent")


@query(D + "SELECT CASE WHEN id % 8 = 0 THEN 'marked' ELSE 'cleared' END AS event, count(*) AS n FROM docs WHERE id % 4 = 0 GROUP BY 1")
def pheromone_events(spark, sf_dir):
    n = document_nodes(spark, sf_dir).withColumn("needs_agent", F.when((F.col("id") % 4).isin(0, 1), "old"))
    marks = n.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "critic").alias("needs_agent"))
    return writes.mark_nodes(n, marks, now())[1].groupBy("event").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT DISTINCT event_id % 100 AS node_id FROM events) SELECT node_id, 'a' || (node_id % 3) AS agent_id, node_id % 3 = 0 AS released FROM (SELECT node_id FROM l UNION SELECT 500) WHERE node_id % 2 = 0")
def lease_release(spark, sf_dir):
    """Only the holder can release a lease."""
    held = table(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("node_id")).distinct().select("node_id", F.lit("a0").alias("agent_id"), now().alias("until"))
    asked = held.select("node_id").unionByName(spark.createDataFrame([(500,)], "node_id long")).where("node_id % 2 = 0").select("node_id", F.concat(F.lit("a"), (F.col("node_id") % 3).cast("string")).alias("agent_id"))
    return writes.release_leases(held, asked)[1]


@query(D + "SELECT id, CASE WHEN id % 5 = 0 THEN 'short ' || id ELSE description END AS description, CASE WHEN id % 4 = 0 THEN 'CONCEPT' ELSE type END AS type FROM docs")
def specialist_update(spark, sf_dir):
    """Summaries become descriptions; classes count only if they are known."""
    n, k = document_nodes(spark, sf_dir), F.col("id")
    said = n.where("id % 5 = 0").select("id", F.lit("summarise").alias("task"), F.concat(F.lit(" short "), k.cast("string")).alias("value"))
    said = said.unionByName(n.where("id % 4 in (0, 1)").select("id", F.lit("classify").alias("task"), F.when(k % 4 == 0, "concept").otherwise("nonsense").alias("value")))
    return writes.specialist_updates(n, said, texts.NODE_TYPES).select("id", "description", "type")


@query(D + "SELECT id AS source_id, i AS ordinal, CASE WHEN i = 1 THEN 'ORGANIZATION' ELSE 'OTHER' END AS type, CASE WHEN i = 1 THEN 'LEADS' ELSE 'RELATED_TO' END AS relation FROM docs, range(1, 4) r(i) WHERE id % 6 = 0")
def specialist_enrich(spark, sf_dir):
    """At most three new nodes for each, with known types and relations."""
    rows = document_nodes(spark, sf_dir).where("id % 6 = 0").select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ordinal"))
    first = F.col("ordinal") == 1
    rows = rows.withColumns({"label": F.concat(F.lit("new"), F.col("ordinal").cast("string")), "type": F.when(first, "startup").otherwise("??"), "relation": F.when(first, "heads").otherwise("likes")})
    n, e = writes.enriched(rows, texts.node_type, texts.relation_type)
    both = e.join(n.select(F.col("id").alias("target_id"), "label", "type"), "target_id")
    return both.select("source_id", F.substring("label", 4, 9).cast("long").alias("ordinal"), "type", "relation")


@query("""WITH s AS (SELECT DISTINCT user_id AS connector_id, max(ts) OVER (PARTITION BY user_id) AS last_run FROM events WHERE user_id % 4 <> 0)
SELECT DISTINCT e.user_id AS connector_id FROM events e LEFT JOIN s ON s.connector_id = e.user_id WHERE e.user_id % 5 <> 0 AND (last_run IS NULL OR epoch(TIMESTAMP '2024-01-31') - floor(epoch(last_run)) >= 86400)""")
def due_connectors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    states = e.where("user_id % 4 <> 0").groupBy(F.col("user_id").alias("connector_id")).agg(F.max("ts").alias("last_run"))
    return analytics.due_connectors(e.select(F.col("user_id").alias("connector_id"), (F.col("user_id") % 5 != 0).alias("enabled")).distinct(), states, now(), 86_400)


@query("""SELECT url, CASE WHEN page_id % 4 = 0 THEN 'not_modified' WHEN page_id % 4 = 1 THEN 'not_modified' WHEN page_id % 4 = 2 THEN 'same' ELSE 'emit' END AS action FROM pages""")
def conditional_pages(spark, sf_dir):
    """Tag, time, content: what a second fetch of each page leads to. Pages are known by their number, as several have one url."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    tag = F.concat(F.lit("t"), k.cast("string"))
    fetched = p.select("page_id", "url", F.when(k % 4 != 1, F.when(k % 4 == 0, tag).otherwise(F.concat(tag, F.lit("'")))).alias("etag"), F.lit("now").alias("last_modified"), F.when(k % 4 == 3, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("content"))
    state = p.select("page_id", "url", tag.alias("etag"), F.lit("now").alias("last_modified"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
    return ingest.changed_pages(fetched, state, key="page_id")[0].select("url", "action")


@query(D + ", a AS (SELECT DISTINCT agent_id FROM docs UNION SELECT 'agent9') SELECT a.agent_id, count(docs.id) AS n_nodes FROM a LEFT JOIN docs USING (agent_id) GROUP BY 1")
def nodes_per_agent(spark, sf_dir):
    n = document_nodes(spark, sf_dir)
    agents = n.select("agent_id").distinct().unionByName(spark.createDataFrame([("agent9",)], "agent_id string"))
    return upkeep.nodes_per_agent(agents, n)


@query(D + "SELECT type, count(*) AS n FROM docs GROUP BY 1 ORDER BY n DESC, type LIMIT 3")
def top_types(spark, sf_dir):
    return upkeep.top_types(document_nodes(spark, sf_dir), 3)


@query(D + "SELECT count(*) AS n FROM docs WHERE energy IS NOT NULL AND retrieval_count > 0 AND id IN (SELECT source_id FROM links)")
def candidate_starts(spark, sf_dir):
    return upkeep.candidate_starts(document_nodes(spark, sf_dir), document_edges(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(D + "SELECT agent_id, substr(sha256('[\"' || string_agg(id::VARCHAR, '\", \"' ORDER BY id::VARCHAR) || '\"]'), 1, 16) AS hash FROM docs GROUP BY 1")
def state_hash(spark, sf_dir):
    """A fingerprint of each tenant's nodes."""
    return analytics.state_hashes(document_nodes(spark, sf_dir).select("agent_id", F.col("id").cast("string").alias("id")), "agent_id")


@query(D + "SELECT agent_id, round(CASE WHEN n < 2 THEN 0 ELSE least(1.0, e / (n * (n - 1))) END, 9) AS density FROM (SELECT agent_id, count(*) AS n FROM docs GROUP BY 1) JOIN (SELECT agent_id, count(*) AS e FROM links GROUP BY 1) USING (agent_id)")
def density_capped(spark, sf_dir):
    n = document_nodes(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("n"))
    e = document_edges(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("e"))
    return n.join(e, "agent_id").select("agent_id", F.round(graph.capped_density(F.col("n"), F.col("e")), 9).alias("density"))


@query(D + "SELECT agent_id, list_sort(list_distinct(list(lang))) AS langs FROM docs GROUP BY 1")
def ordered_ids(spark, sf_dir):
    """A list of ids without repeats."""
    n = document_nodes(spark, sf_dir).withColumn("lang", F.lower("type"))
    return n.groupBy("agent_id").agg(F.array_sort(F.array_distinct(F.collect_set("lang"))).alias("langs"))


@query(D + """SELECT a.id FROM links a JOIN links b ON b.target_id = a.target_id AND b.relation = 'QUOTES' WHERE a.relation = 'CITES' AND a.id <> b.id GROUP BY a.id""")
def related_edges(spark, sf_dir):
    e = document_edges(spark, sf_dir)
    return e.where("relation = 'CITES'").join(e.where("relation = 'QUOTES'").select("target_id"), "target_id", "left_semi").select("id")


@query(D + "SELECT (SELECT count(*) FROM links) AS n_all, (SELECT count(*) FROM links WHERE target_id % 3 <> 0 AND source_id % 3 <> 0) AS n_left")
def coherent_edges(spark, sf_dir):
    n, e = document_nodes(spark, sf_dir), document_edges(spark, sf_dir)
    left = memory.delete_nodes(n, e, n.where("id % 3 = 0"))[1]
    return e.agg(F.count("*").alias("n_all")).crossJoin(left.agg(F.count("*").alias("n_left")))
