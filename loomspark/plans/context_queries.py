"""Retrieval, context lines, consolidation and synthesis over documents, vectors and the star graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import properties, texts
from loomspark.operators import access, analytics, context, graph, ingest, model_calls, retrieval, training, upkeep
from loomspark.plans.catalog import query, table
from loomspark.sources.star import DOCS, EDGES, NODES, VECTORS, document_edges, document_nodes, edges, nodes, vector_nodes

D = f"WITH {DOCS} "
G = f"WITH {NODES}, {EDGES} "
V = f"WITH {VECTORS} "
COS = "list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm)"


@query(r"SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 3)[1:10], lambda w: w || '*'), ' OR ') AS ft FROM conversations WHERE regexp_matches(text, '[\p{L}\p{N}_]{3}')")
def keyword_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.prefix_query(F.col("text")).alias("ft")).where("ft is not null")


STOP = ", ".join(f"'{w}'" for w in texts.STOP_WORDS)


@query(rf"""WITH q AS (SELECT doc_id, 'What does the (' || lang || ') text, from ' || source || ', say about it?' AS q FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(q), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({STOP})) AS ws FROM q)
SELECT doc_id, array_to_string(list_filter(list_transform(ws, lambda w: regexp_replace(w, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g')), lambda w: w <> '')[1:10], ' ') AS words FROM w""")
def search_words(spark, sf_dir):
    """The words of a question without stop words and punctuation."""
    q = F.concat(F.lit("What does the ("), "lang", F.lit(") text, from "), "source", F.lit(", say about it?"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(texts.search_words(q), " ").alias("words"))


FULL = r"""s0 AS (SELECT *, lower(concat_ws(' ', label, description, source_text)) AS t FROM docs), w AS (SELECT *, list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS ws FROM s0),
c AS (SELECT *, len(ws) AS wn, len(list_filter(ws, lambda x: starts_with(x, 'tion'))) AS f0, len(list_filter(ws, lambda x: starts_with(x, 'news'))) AS f1 FROM w),
st AS (SELECT count(*) AS c, avg(wn) AS a, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM c),
hits AS (SELECT c.*, ln(1 + (st.c - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * wn / a)) + ln(1 + (st.c - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * wn / a)) AS score FROM c, st WHERE f0 + f1 > 0)"""
ASKED = "tion, or news?"


@query(D + f", {FULL} SELECT id, round(score, 5) AS score FROM hits ORDER BY hits.score DESC, id LIMIT 20")
def fulltext_seeds(spark, sf_dir):
    """Prefix search over label, description and source text."""
    return context.seeds(document_nodes(spark, sf_dir), ASKED, 20).select("id", F.round("score", 5).alias("score"))


VISIBLE = "docs AS (SELECT * FROM all_docs WHERE agent_id IN ('agent0', 'agent1', 'agent3') AND coalesce(clearance, 1) <= 3)"
DV = f"WITH {DOCS.replace('docs AS (', 'all_docs AS (', 1)}, {VISIBLE}"


def _allowed(spark):
    hubs = spark.createDataFrame([("agent0",), ("agent1",)], "agent_id string")
    links = spark.createDataFrame([("agent0", "agent1"), ("agent0", "agent3"), ("agent1", "agent4")], "source string, target string")
    return access.shared_with(hubs, links).where("agent_id = 'agent0'").select("allowed")


def _line(weight: str = "") -> str:
    return f"""{weight}'[Source: Agent ' || agent_id || '] - ' || label || ' (' || type || '): ' || CASE WHEN description <> '' THEN description || '; ' ELSE '' END
  || CASE WHEN source_text <> '' AND source_text IS DISTINCT FROM description THEN substr(source_text, 1, 300) || CASE WHEN length(source_text) > 300 THEN '...' ELSE '' END || '; ' ELSE '' END || 'date: ' || temporal || '; n: ' || n || '; lang: ' || lang"""


@query(DV + f", {FULL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM hits) SELECT rank::INT AS rank, md5({_line()}) AS line FROM r WHERE rank <= 20")
def context_keyword(spark, sf_dir):
    """The first form of retrieval: shared tenants, keyword seeds, lines of context (their digests)."""
    found = context.keyword_context(document_nodes(spark, sf_dir), _allowed(spark), ASKED, 3, 8)
    return context.context_lines(found).select("rank", F.md5(F.col("line").cast("binary")).alias("line"))


SCORED = """u AS (SELECT h.*, coalesce(avg(l.weight), 1.0) AS use FROM {0} h LEFT JOIN links l ON l.source_id = h.id GROUP BY ALL),
sc AS (SELECT *, use * energy * exp(-0.05 / (1 + 0.1 * sqrt(retrieval_count)) * 6.0) AS syn FROM u), k AS (SELECT *, row_number() OVER (ORDER BY syn DESC, id) AS rank FROM sc WHERE syn >= 0.3)"""


@query(DV + f""", {FULL}, h0 AS (SELECT id, label, type, agent_id, energy, retrieval_count, description, source_text, temporal, n, lang FROM hits), {SCORED.format('h0')}
SELECT rank::INT AS rank, md5({_line("CASE WHEN syn >= 1.5 THEN '[Strength: ' || printf('%.1f', syn) || '] ' ELSE '' END || ")}) AS line FROM k WHERE rank <= 15""")
def context_ranked(spark, sf_dir):
    """The second form: keyword seeds that are not forgotten, by synaptic score; without vectors the best 15."""
    found = context.ranked_context(document_nodes(spark, sf_dir), document_edges(spark, sf_dir), _allowed(spark), ASKED, 3, F.lit(6.0))
    return context.context_lines(found, "synaptic_score").select("rank", F.md5(F.col("line").cast("binary")).alias("line"))


@query()
def context_diverse(spark, sf_dir):
    """The second form where all candidates have vectors: 40 are re-ranked to 15. Tests hold it against plain Python."""
    v = vector_nodes(spark, sf_dir).select("id", "embedding")
    n = document_nodes(spark, sf_dir).join(v, "id")
    found = context.ranked_context(n, document_edges(spark, sf_dir), _allowed(spark), "zzz", 3, F.lit(1.0))
    return found.select("id", "rank", F.round("synaptic_score", 9).alias("score"))


@query(DV + """, top AS (SELECT id FROM docs WHERE id % 10 = 3) SELECT DISTINCT a.label || ' -[' || relation || ']-> ' || b.label AS line FROM links JOIN docs a ON a.id = source_id JOIN docs b ON b.id = target_id
WHERE source_id IN (SELECT id FROM top) OR target_id IN (SELECT id FROM top) ORDER BY line LIMIT 30""")
def context_relations(spark, sf_dir):
    """Relation lines of seeds, with both ends in allowed tenants and within the clearance."""
    n = document_nodes(spark, sf_dir)
    return context.relationship_lines(n, document_edges(spark, sf_dir), n.where("id % 10 = 3"), _allowed(spark), 3)


TWO = D + r""", w AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', label, description, source_text)), '[\p{L}\p{N}_]+') AS ws FROM docs), st AS (SELECT count(*) AS c, avg(len(ws)) AS a FROM w),
tf AS (SELECT id, wn, word, count(*) AS f FROM (SELECT id, len(ws) AS wn, unnest(ws) AS word FROM w) GROUP BY ALL),
qs AS (SELECT conv_id AS q, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' AND conv_id % 20 = 0 AND conv_id IN (SELECT vec_id FROM embeddings) GROUP BY 1),
qt AS (SELECT q, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:10]) AS t FROM (SELECT q, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 3) AS l FROM qs)),
pf AS (SELECT q, t, id, wn, sum(f) AS f FROM qt JOIN tf ON starts_with(word, t) GROUP BY ALL), pd AS (SELECT q, t, count(*) AS d FROM pf GROUP BY ALL),
hits AS (SELECT q, id, sum(ln(1 + (c - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * wn / a))) AS score FROM pf JOIN pd USING (q, t), st GROUP BY 1, 2),
v AS (SELECT a.vec_id AS q, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))
    / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x))) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id IN (SELECT id FROM docs)),
l AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS r FROM v UNION ALL SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) FROM hits),
f AS (SELECT q, id, sum(1.0::DOUBLE / (60 + r)) AS score FROM l WHERE r <= 8 GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM f) """


@query(TWO + "SELECT q AS query_id, id, round(score, 8) AS score, rank::INT AS rank FROM g WHERE rank <= 16")
def hybrid_seeds(spark, sf_dir):
    """Vector and keyword lists of every question, fused; twice the seeds survive. Questions are the vectors of the query set with the first user turn of the conversation of that number, if there is one."""
    v = vector_nodes(spark, sf_dir)
    n = document_nodes(spark, sf_dir)
    said = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("question"))
    questions = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")).join(said, "query_id", "left")
    return context.fused_seeds(n, questions, embedded=v.join(n.select("id"), "id", "left_semi")).select("query_id", "id", F.round("score", 8).alias("score"), "rank")


EXPANDED = D + """, seen AS (SELECT * FROM docs WHERE coalesce(clearance, 1) <= 3), s AS (SELECT id FROM seen WHERE id % 50 = 0), one AS (SELECT * FROM links WHERE source_id IN (SELECT id FROM s) OR target_id IN (SELECT id FROM s)),
near AS (SELECT * FROM seen WHERE id IN (SELECT id FROM s UNION SELECT source_id FROM one UNION SELECT target_id FROM one)) """


@query(EXPANDED + "SELECT 'node' AS kind, id::VARCHAR AS id FROM near UNION ALL SELECT 'edge', o.id FROM one o JOIN near a ON a.id = source_id JOIN near b ON b.id = target_id WHERE weight * a.energy >= 0.3")
def seed_expansion(spark, sf_dir):
    """One hop around the seeds, cleared, without weak edges."""
    n = document_nodes(spark, sf_dir)
    near, inside = context.expanded(n, document_edges(spark, sf_dir), n.where("id % 50 = 0").select("id"), 3, 0.3)
    return near.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("id")).unionByName(inside.select(F.lit("edge").alias("kind"), "id"))


@query(D + "SELECT id, CASE WHEN id % 4 = 0 THEN 'last' WHEN id % 2 = 0 THEN 'second' ELSE 'first' END AS part FROM docs")
def union_last_wins(spark, sf_dir):
    n = document_nodes(spark, sf_dir).select("id")
    part = lambda where, name: n.where(where).select("id", F.lit(name).alias("part"))
    return context.united([part("true", "first"), part("id % 2 = 0", "second"), part("id % 4 = 0", "last")])


@query(D + "SELECT id, rank::INT AS rank FROM (SELECT id, row_number() OVER (ORDER BY id % 10 <> 7, energy DESC, id) AS rank FROM docs WHERE id % 10 = 7 AND id < 40 OR id % 10 = 1) WHERE rank <= 25")
def text_supplement(spark, sf_dir):
    """Few vector rows, so text rows that are new follow them."""
    n = document_nodes(spark, sf_dir)
    ranked = lambda df, most: df.orderBy(F.desc("energy"), "id").limit(most).select("id", F.row_number().over(context.W.orderBy(F.desc("energy"), "id")).alias("rank"))
    return context.supplemented(ranked(n.where("id % 10 = 7 and id < 40"), 20), ranked(n.where("id % 10 = 1"), 40))


@query(D + """, r AS (SELECT source_id, relation || ' → ' || b.label AS s, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, l.id) AS r FROM links l JOIN docs b ON b.id = target_id),
m AS (SELECT source_id, string_agg(s, '; ' ORDER BY r) AS rels FROM r WHERE r <= 5 GROUP BY 1), k AS (SELECT docs.*, rels, row_number() OVER (ORDER BY energy DESC, id) AS rank FROM docs LEFT JOIN m ON source_id = docs.id)
SELECT rank::INT AS rank, md5('• ' || label || ' (' || type || ')' || CASE WHEN description <> '' THEN ': ' || substr(description, 1, 300) || CASE WHEN length(description) > 300 THEN '...' ELSE '' END ELSE '' END
 || CASE WHEN source_text <> '' AND source_text IS DISTINCT FROM (substr(description, 1, 300) || CASE WHEN length(description) > 300 THEN '...' ELSE '' END) THEN ' — "' || substr(source_text, 1, 300) || CASE WHEN length(source_text) > 300 THEN '...' ELSE '' END || '"' ELSE '' END
 || coalesce(' | ' || rels, '')) AS line FROM k WHERE rank <= 40""")
def subgraph_context(spark, sf_dir):
    """A bullet for each of the best 40 nodes, with at most five relations (digests)."""
    n = document_nodes(spark, sf_dir).withColumns({"score": F.col("energy"), "ordinal": F.col("id")})
    return context.subgraph_lines(n, document_edges(spark, sf_dir)).select("rank", F.md5(F.col("line").cast("binary")).alias("line"))


@query(D + "SELECT id, md5('[Agent: ' || agent_id || '] ' || label || ' (' || type || '): ' || CASE WHEN id % 2 = 0 AND description <> '' THEN substr(description, 1, 300) ELSE temporal END) AS line FROM docs")
def swarm_context(spark, sf_dir):
    """Lines of several tenants: the description, else the first text of the bag (digests)."""
    n = document_nodes(spark, sf_dir).withColumn("description", F.when(F.col("id") % 2 == 0, F.col("description")))
    return context.swarm_lines(n).select("id", F.md5(F.col("line").cast("binary")).alias("line"))


@query("SELECT doc_id, doc_id % 4 < 2 AND doc_id % 3 = 0 AS wanted FROM documents")
def answer_gate(spark, sf_dir):
    """A span is cut out of long answers to questions for a fact, not of refusals."""
    k = F.col("doc_id")
    q = F.when(k % 4 == 0, " Who wrote it?").when(k % 4 == 1, "How many are there").when(k % 4 == 2, "Explain it").otherwise("whatever")
    a = F.when(k % 3 == 0, F.concat(F.lit("It was written by "), "lang", F.lit(" in a day"))).when(k % 3 == 1, "No information about this is there").otherwise(F.concat(F.lit("three "), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", texts.wants_span(q, a).alias("wanted"))


@query("""WITH c AS (SELECT user_id AS q, event_id AS n, CASE WHEN event_id % 5 <> 0 THEN 'a' || event_id ELSE ' ' END AS a, CASE WHEN user_id % 3 <> 0 AND event_id % 2 = 0 THEN value END AS s FROM events),
r AS (SELECT q, a, row_number() OVER (PARTITION BY q ORDER BY s DESC NULLS LAST, n) AS r FROM c WHERE a <> ' ') SELECT u.q AS query_id, r.a AS answer, CASE WHEN r.a IS NULL THEN 'failed' ELSE 'ok' END AS state FROM (SELECT DISTINCT q FROM c) u LEFT JOIN r ON r.q = u.q AND r.r = 1""")
def best_of_n(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query_id"), k.alias("n"), F.when(k % 5 != 0, F.concat(F.lit("a"), k.cast("string"))).otherwise(" ").alias("answer"), F.when((F.col("user_id") % 3 != 0) & (k % 2 == 0), F.col("value")).alias("confidence"))
    return context.best_candidate(rows)


@query(D + """, f AS (SELECT agent_id, id % 100 AS id FROM docs WHERE agent_id <> 'agent4' AND agent_id <> 'agent2') SELECT 'node' AS kind, min(agent_id) AS agent_id, id::VARCHAR AS value FROM f GROUP BY id
UNION ALL SELECT DISTINCT 'line', agent_id, '[Agent: ' || agent_id || '] said ' || agent_id FROM f""")
def federated_query(spark, sf_dir):
    """Agents that failed or found nothing are left out; nodes are merged by id."""
    n = document_nodes(spark, sf_dir)
    found = n.where("agent_id <> 'agent4'").select("agent_id", (F.col("id") % 100).alias("id")).distinct()
    answers = n.select("agent_id").distinct().select("agent_id", F.concat(F.lit("said "), "agent_id").alias("answer"), F.when(F.col("agent_id") == "agent2", "timeout").alias("error"))
    near, lines = context.federated(found, answers)
    return near.select(F.lit("node").alias("kind"), "agent_id", F.col("id").cast("string").alias("value")).unionByName(lines.select(F.lit("line").alias("kind"), "agent_id", F.col("line").alias("value")))


# Consolidation
def _twins(spark, sf_dir):
    """Every third vector node has a twin of the same direction, some of these facts, and every sixth another one with more edges than both."""
    v = vector_nodes(spark, sf_dir).select(F.col("id"), F.lit("CONCEPT").alias("type"), "agent_id", "embedding")
    twin = v.where("id % 3 = 0").select((F.col("id") + 100_000).alias("id"), F.when(F.col("id") % 9 == 0, "FACT").otherwise("CONCEPT").alias("type"), "agent_id", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    e = v.select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 6 == 0, F.col("id") + 100_000).otherwise(F.col("id")).alias("source_id"), ((F.col("id") * 7 + 4) % 200).alias("target_id"), F.lit("R").alias("relation"), F.lit(1.0).alias("weight"), "agent_id")
    more = v.where("id % 6 = 0").withColumn("id", F.col("id") + 200_000)
    extra = more.select("id", "agent_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).withColumn("k", F.col("id") * 10 + F.col("k"))
    e = e.unionByName(extra.select(F.col("k").cast("string").alias("id"), F.col("id").alias("source_id"), (F.col("k") % 200).alias("target_id"), F.lit("R").alias("relation"), F.lit(1.0).alias("weight"), "agent_id"))
    return v.unionByName(twin).unionByName(more), e


TWINS = V + """, n AS (SELECT id, 'CONCEPT' AS type, agent_id, e, norm FROM vecs UNION ALL SELECT id + 100000, CASE WHEN id % 9 = 0 THEN 'FACT' ELSE 'CONCEPT' END, agent_id, list_transform(e, lambda x: x * 2), norm * 2 FROM vecs WHERE id % 3 = 0 UNION ALL SELECT id + 200000, 'CONCEPT', agent_id, e, norm FROM vecs WHERE id % 6 = 0),
ed AS (SELECT id::VARCHAR AS id, CASE WHEN id % 6 = 0 THEN id + 100000 ELSE id END AS s, (id * 7 + 4) % 200 AS t FROM vecs
  UNION ALL SELECT ((id + 200000) * 10 + k)::VARCHAR, id + 200000, ((id + 200000) * 10 + k) % 200 FROM vecs, range(9) r(k) WHERE id % 6 = 0), dg AS (SELECT x AS id, count(*) AS n FROM (SELECT s AS x FROM ed UNION ALL SELECT t FROM ed) GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id < b.id AND a.agent_id = b.agent_id AND a.type <> 'FACT' AND b.type <> 'FACT' WHERE """ + COS + """ >= 0.95),
kd AS (SELECT CASE WHEN coalesce(x.n, 0) >= coalesce(y.n, 0) THEN a ELSE b END AS keep_id, CASE WHEN coalesce(x.n, 0) >= coalesce(y.n, 0) THEN b ELSE a END AS drop_id FROM p LEFT JOIN dg x ON x.id = a LEFT JOIN dg y ON y.id = b) """


#: The rule of fusion, pair by pair: g holds what was dropped, m where to; f follows keepers to the last.
FUSED = TWINS.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY least(keep_id, drop_id), greatest(keep_id, drop_id)) AS k FROM kd),
st(k, g, m) AS (SELECT 0::BIGINT, []::BIGINT[], []::STRUCT(id BIGINT, t BIGINT)[]
  UNION ALL SELECT o.k, CASE WHEN list_contains(g, keep_id) OR list_contains(g, drop_id) THEN g ELSE list_append(g, drop_id) END,
    CASE WHEN list_contains(g, keep_id) OR list_contains(g, drop_id) THEN m ELSE list_append(m, {'id': drop_id, 't': keep_id}) END FROM st JOIN o ON o.k = st.k + 1),
mp AS MATERIALIZED (SELECT x.id AS id, x.t AS t FROM (SELECT unnest(m) AS x FROM st WHERE k = (SELECT max(k) FROM st))),
f(id, t, n) AS (SELECT id, t, 0 FROM mp UNION ALL SELECT f.id, mp.t, n + 1 FROM f JOIN mp ON mp.id = f.t),
cm AS (SELECT id, max_by(t, n) AS k FROM f GROUP BY id) """


@query(TWINS + "SELECT keep_id, drop_id FROM kd")
def duplicate_fusion(spark, sf_dir):
    """The node of more edges is kept; facts never fuse."""
    return upkeep.fusion_pairs(*_twins(spark, sf_dir)).select("keep_id", "drop_id")


@query(FUSED + "SELECT id, k AS canonical_id FROM cm")
def fused_nodes(spark, sf_dir):
    """Where each dropped node ends up, by way of keepers that are dropped themselves."""
    n, e = _twins(spark, sf_dir)
    return upkeep.fused(n, e, graph.cut_lineage(upkeep.fusion_pairs(n, e)))[2]


@query(FUSED + "SELECT coalesce(x.k, s) AS source_id, coalesce(y.k, t) AS target_id FROM ed LEFT JOIN cm x ON x.id = s LEFT JOIN cm y ON y.id = t WHERE coalesce(x.k, s) <> coalesce(y.k, t) GROUP BY 1, 2")
def fused_edges(spark, sf_dir):
    """Edges after fusion: redirected, without loops and repeats."""
    n, e = _twins(spark, sf_dir)
    return upkeep.fused(n, e, graph.cut_lineage(upkeep.fusion_pairs(n, e)))[1].select("source_id", "target_id")


@query(TWINS + """, bd AS (SELECT s AS a, t AS b FROM ed WHERE s <> t UNION SELECT t, s FROM ed WHERE s <> t), w AS (SELECT a.id AS a, b.id AS b FROM vecs a JOIN vecs b ON a.id < b.id AND a.agent_id = b.agent_id WHERE """ + COS + """ BETWEEN 0.25 AND 0.92),
j AS (SELECT a, b FROM bd UNION SELECT x.a, y.b FROM bd x JOIN bd y ON y.a = x.b)
SELECT a, b FROM w WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.a = w.a AND j.b = w.b)""")
def unconnected_pairs(spark, sf_dir):
    """Alike nodes without a path of one or two edges between them."""
    e = _twins(spark, sf_dir)[1]
    return upkeep.unconnected_alike(vector_nodes(spark, sf_dir), e, 0.25, 0.92, 2).select("a", "b")


@query(TWINS + """, bd AS (SELECT s AS a, t AS b FROM ed UNION SELECT t, s FROM ed), w AS (SELECT a.id AS a, b.id AS b FROM vecs a JOIN vecs b ON a.id < b.id AND a.agent_id = b.agent_id WHERE """ + COS + """ BETWEEN 0.25 AND 0.92)
SELECT a AS source_id, b AS target_id, 'R' AS relation, ((80 + (a + b) % 20) / 100.0)::DOUBLE AS confidence FROM w WHERE NOT EXISTS (SELECT 1 FROM bd WHERE bd.a = w.a AND bd.b = w.b) AND (a + b) % 3 <> 0 AND (a + b) % 5 <> 0 AND (a + b) % 7 <> 0""")
def link_proposal(spark, sf_dir):
    """Only related pairs, known relations and sure ones are taken."""
    n, e = vector_nodes(spark, sf_dir), _twins(spark, sf_dir)[1]
    k = F.col("a") + F.col("b")

    def propose(pairs):
        return pairs.select("agent_id", "a", "b", (k % 3 != 0).alias("is_related"), F.when(k % 5 == 0, "MADE_UP").otherwise("R").alias("proposed_label"), F.when(k % 7 == 0, F.lit(0.79)).otherwise((80 + k % 20) / 100).alias("confidence"))

    return upkeep.proposed_links(n, e, propose, 0.25, 0.92)


@query(FUSED + """, alone AS MATERIALIZED (SELECT id + 300000 AS id, agent_id FROM vecs WHERE id % 50 = 0), left_ AS MATERIALIZED (SELECT * FROM n WHERE id NOT IN (SELECT id FROM cm)),
e2 AS MATERIALIZED (SELECT DISTINCT coalesce(x.k, s) AS s, coalesce(y.k, t) AS t FROM ed LEFT JOIN cm x ON x.id = s LEFT JOIN cm y ON y.id = t WHERE coalesce(x.k, s) <> coalesce(y.k, t)),
pr AS (SELECT a.id AS a, b.id AS b FROM left_ a JOIN left_ b ON a.id < b.id AND a.agent_id = b.agent_id WHERE """ + COS + """ BETWEEN 0.25 AND 0.92 AND (a.id + b.id) % 3 <> 0
  AND NOT EXISTS (SELECT 1 FROM e2 WHERE (e2.s = a.id AND e2.t = b.id) OR (e2.s = b.id AND e2.t = a.id)) AND EXISTS (SELECT 1 FROM ed JOIN vecs v ON v.id = ed.s % 100000 WHERE v.agent_id = a.agent_id))
SELECT (SELECT count(*) FROM alone WHERE id % 100 = 0) AS n_pruned, (SELECT count(DISTINCT agent_id) FROM n) AS n_agents, (SELECT count(*) FROM cm) AS n_fused, (SELECT count(*) FROM pr) AS n_proposed,
(SELECT count(*) FROM e2) + (SELECT count(*) FROM pr) AS n_decayed, (SELECT count(*) FROM n) + (SELECT count(*) FROM alone WHERE id % 100 <> 0) - (SELECT count(*) FROM cm) AS n_nodes, (SELECT count(*) FROM e2) + (SELECT count(*) FROM pr) AS n_edges, NULL::VARCHAR AS error""")
def consolidation_report(spark, sf_dir):
    """Prune, fuse, propose links, decay, and what came of it. Nodes without edges are added, half of them old."""
    n, e = _twins(spark, sf_dir)
    alone = vector_nodes(spark, sf_dir).where("id % 50 = 0").select((F.col("id") + 300_000).alias("id"), F.lit("CONCEPT").alias("type"), "agent_id", F.lit(None).cast("array<double>").alias("embedding"))
    at = F.lit("2024-01-31").cast("timestamp")
    aged = lambda df, old: df.withColumn("created_at", F.when(old, at - F.expr("INTERVAL 8 DAYS")).otherwise(at))
    both = aged(n, F.lit(False)).unionByName(aged(alone, F.col("id") % 100 == 0))

    def propose(pairs):  # noqa: ANN001, ANN202
        return pairs.select("agent_id", "a", "b", ((F.col("a") + F.col("b")) % 3 != 0).alias("is_related"), F.lit("R").alias("proposed_label"), F.lit(0.9).alias("confidence"))

    return upkeep.consolidate(both, e, at, propose=propose, low=0.25)[2]


# Text to graph
def _answer(k, lang):
    named = lambda a, b: F.concat(F.lit('{"label":"'), a, F.lit('","type":"'), b, F.lit('","properties":{"x":1}}'))
    said = lambda a, b, r: F.concat(F.lit('{"source":"'), a, F.lit('","target":"'), b, F.lit(f'","relation":"{r}"}}'))
    n = F.concat(F.lit("N"), k.cast("string"))
    found = F.concat_ws(",", named(n, F.lit("startup")), named(F.lit("Berlin"), F.lit("city")), named(lang, F.lit("language")))
    links = F.concat_ws(",", said(n, F.lit("Berlin"), "is_based_in"), said(n, F.lit("Nowhere"), "uses"), said(lang, n, "likes"))
    return F.concat(F.lit('Here:\n```json\n{"nodes":['), found, F.lit('],"edges":['), links, F.lit("]}\n```"))


@query("""SELECT doc_id AS payload, 0 AS ordinal, 'N' || doc_id AS source, 'Berlin' AS target, 'LOCATED_IN' AS relation, 'ORGANIZATION' AS type FROM documents UNION ALL SELECT doc_id, 2, lang, 'N' || doc_id, 'RELATED_TO', 'TECHNOLOGY' FROM documents""")
def payload_build(spark, sf_dir):
    """Nodes and edges out of a model's answer, names of types and relations made regular, unknown ends left out."""
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("payload"), _answer(F.col("doc_id"), F.col("lang")).alias("answer"))
    n, e = ingest.payload(answers)
    return e.join(n.select("payload", F.col("label").alias("source"), "type"), ["payload", "source"]).select("payload", "ordinal", "source", "target", "relation", "type")


@query("SELECT 'fact:' || doc_id AS source_id, doc_id || '/' || i AS target_id, 'MENTIONS' AS relation FROM documents, range(2) r(i)")
def fact_mentions(spark, sf_dir):
    """The FACT node of a document mentions each of its entities once."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("i"))
    return ingest.mention_edges(d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("i").cast("string")).alias("id")), "doc_id")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'to_embed' WHEN vec_id % 5 = 0 THEN 'to_embed' ELSE 'ready' END AS state FROM embeddings")
def vector_check(spark, sf_dir):
    """Missing vectors and those of a wrong size are embedded anew."""
    k = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(k % 3 != 0, F.when(k % 5 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))).alias("embedding"))
    return ingest.checked_vectors(rows, 64, False).select("vec_id", F.col("vector_state").alias("state"))


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS chunk_no, length(text) AS n FROM conversations), r AS (SELECT *, CASE WHEN n % 5 = 4 THEN 9 ELSE 1 + n % 5 END AS need FROM c),
g AS (SELECT doc_id, max(CASE WHEN need <= 3 THEN 1 ELSE 0 END) AS ok FROM r GROUP BY 1)
SELECT doc_id, chunk_no, least(need, 3)::INT AS attempts, CASE WHEN need <= 3 THEN md5('{"n": ' || n || '}') END AS answer, CASE WHEN need > 3 THEN CASE WHEN n % 5 = 4 THEN 'ValueError: too long' ELSE 'not JSON' END END AS error, g.ok = 0 AS aside FROM r JOIN g USING (doc_id)""")
def extraction_retry(spark, sf_dir):
    """A stand-in model that says 'not yet' until it has been told of its error so often as the length of a text asks; some texts always fail."""

    def call(said, errors):  # noqa: ANN001, ANN202
        out = []
        for text, error in zip(said, errors, strict=True):
            n, tries = len(text), 1 + (0 if error is None else error.count("not JSON") + error.count("again"))
            out.append('{"n": %d}' % n if n % 5 < tries else "not yet" + " again" * (tries - 1) if n % 5 != 4 else "too long")
        return out

    def check(answer):  # noqa: ANN001, ANN202
        return F.when(answer == "too long", "ValueError: too long").when(~answer.startswith("{"), F.concat(F.lit("not JSON"), F.regexp_replace(answer, "^not yet", "")))

    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), "text")
    done, aside = model_calls.attempted(chunks, call, check)
    error = F.when(F.col("error").startswith("not JSON"), "not JSON").otherwise(F.col("error"))
    return done.join(aside.withColumn("aside", F.lit(True)), "doc_id", "left").select("doc_id", "chunk_no", "attempts", F.md5(F.col("answer").cast("binary")).alias("answer"), error.alias("error"), F.coalesce("aside", F.lit(False)).alias("aside"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['the ' || lang || ' one'] ELSE ['A ' || lang, 'b', 'c', 'd', 'e'] END AS questions FROM documents")
def sub_questions(spark, sf_dir):
    """Strings of a model's list, trimmed, once each, five at most; else the question."""
    asked = F.concat(F.lit("the "), "lang", F.lit(" one"))
    answer = F.when(F.col("doc_id") % 3 == 0, "not json").otherwise(F.concat(F.lit('```json\n["A '), "lang", F.lit('", " b ", "B", 7, "c", "", "d", "e", "f"]\n```')))
    return table(spark, sf_dir, "documents").select("doc_id", texts.sub_questions(answer, asked).alias("questions"))


@query("SELECT doc_id, 2::INT AS n, 'x' || doc_id AS first FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, NULL FROM documents WHERE doc_id % 2 = 1")
def json_objects(spark, sf_dir):
    """The objects of a fenced list; other members and broken answers give none."""
    good = F.concat(F.lit('Sure:\n```\n[{"a":"x'), F.col("doc_id").cast("string"), F.lit('"}, 5, "s", {"a":"y"}]\n```'))
    found = texts.json_objects(F.when(F.col("doc_id") % 2 == 0, good).otherwise("[{broken"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), F.get_json_object(F.try_element_at(found, F.lit(1)), "$.a").alias("first"))


@query(D + "SELECT id, CASE id % 4 WHEN 0 THEN 'two' WHEN 1 THEN temporal WHEN 2 THEN 'plain ' || lang ELSE '' END AS text FROM docs")
def text_field(spark, sf_dir):
    """The best text of a bag; what is no JSON counts itself."""
    k = F.col("id")
    bag = F.when(k % 4 == 0, '{"description":" ","source_text":" two ","summary":"three"}').when(k % 4 == 1, F.col("properties")).when(k % 4 == 2, F.concat(F.lit("plain "), F.lower("type"))).otherwise("{}")
    return document_nodes(spark, sf_dir).select("id", properties.best_text(bag).alias("text"))


# Synthesis
@query(G + """, e AS (SELECT source_id AS s, target_id AS t, min(relation) AS r FROM edges GROUP BY 1, 2), p AS (SELECT a.s AS a, a.t AS b, b.t AS c, a.r AS r1, b.r AS r2, row_number() OVER (ORDER BY a.s, a.t, b.t) AS k FROM e a JOIN e b ON b.s = a.t WHERE b.t NOT IN (a.s, a.t))
SELECT x.label || ' --[' || r1 || ']--> ' || y.label || ' --[' || r2 || ']--> ' || z.label AS line FROM p JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b JOIN nodes z ON z.id = c WHERE k <= 30""")
def reasoning_chains(spark, sf_dir):
    """The first 30 paths of two edges and more, shortest first, as chains of labels."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    return training.chain_lines(graph.breadth_first_paths(e, n), n).select("line")


@query(G + """, f AS (SELECT * FROM edges ORDER BY id LIMIT 100), x AS (SELECT f.id, a.label AS al, a.type AS aty, b.label AS bl, b.type AS bt, relation, row_number() OVER (ORDER BY f.id) AS k FROM f JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id)
SELECT k::INT AS ordinal, 'Extract the relationship between entities mentioned in the following text.' AS instruction, al || ' (' || aty || ') is related to ' || bl || ' (' || bt || ') via ''' || relation || '''.' AS context,
'{"subject":"' || al || '","relation":"' || relation || '","object":"' || bl || '"}' AS response FROM x WHERE k <= 70""")
def relation_extraction(spark, sf_dir):
    return training.relation_examples(nodes(spark, sf_dir), edges(spark, sf_dir), 210)


@query("""WITH e AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'factual_qa' ELSE 'relation_extraction' END AS strategy, doc_id AS ordinal, lang AS instruction, source AS response FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY instruction, response ORDER BY strategy, ordinal) AS r FROM e) SELECT strategy, count(*) AS n, sum((r > 1)::INT)::BIGINT AS n_duplicates FROM r GROUP BY 1""")
def synthesis_stats(spark, sf_dir):
    """Examples by strategy, and how many repeat others."""
    d = table(spark, sf_dir, "documents")
    ex = d.select(F.when(F.col("doc_id") % 2 == 0, "factual_qa").otherwise("relation_extraction").alias("strategy"), F.col("doc_id").alias("ordinal"), F.col("lang").alias("instruction"), F.col("source").alias("response"))
    return training.distinct_examples(ex)[1]


@query("SELECT lang AS instruction, source AS response, min(doc_id) AS ordinal FROM documents GROUP BY 1, 2")
def example_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("instruction"), F.col("source").alias("response"), F.col("doc_id").alias("ordinal"))
    return training.first_of_each(d, ["instruction", "response"], "ordinal")


@query(D + "SELECT id, CASE WHEN id % 3 = 0 THEN 'THOUGHT: A -[:X]-> B' || chr(10) ELSE '' END || 'ANSWER: ' || CASE WHEN description <> '' THEN md5(description) ELSE label END AS said FROM docs")
def reasoning_responses(spark, sf_dir):
    """Chosen responses carry their chain, rejected ones do not."""
    text = F.when(F.col("description") != "", F.md5(F.col("description").cast("binary")))
    chosen, rejected = training.reasoning_responses(F.lit("A -[:X]-> B"), text, F.col("label"))
    return document_nodes(spark, sf_dir).select("id", F.when(F.col("id") % 3 == 0, chosen).otherwise(rejected).alias("said"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['factual_qa', 'relation_extraction'] WHEN 1 THEN ['factual_qa', 'reasoning_chains', 'relation_extraction'] ELSE ['reasoning_chains'] END AS strategies, CASE doc_id % 4 WHEN 1 THEN 'alpaca' ELSE 'openai' END AS format FROM documents")
def strategy_names(spark, sf_dir):
    k = F.col("doc_id")
    names = F.when(k % 3 == 0, F.array(F.lit("factual"), F.lit("relations"), F.lit("factual_qa"), F.lit("?"))).when(k % 3 == 1, F.array(F.lit("nothing"))).otherwise(F.array(F.lit("reasoning")))
    form = F.when(k % 4 == 0, "both").when(k % 4 == 1, "alpaca").when(k % 4 == 2, "openai").otherwise("xml")
    return table(spark, sf_dir, "documents").select("doc_id", training.strategies(names).alias("strategies"), training.output_format(form).alias("format"))


@query("""SELECT doc_id AS worker, CASE WHEN doc_id % 5 = 0 THEN 'worker_' || doc_id || '_no_facts' WHEN doc_id % 5 = 1 THEN 'worker_' || doc_id || '_failed' WHEN doc_id % 5 = 2 THEN 'worker_' || doc_id || '_missing_keys' END AS skipped,
CASE WHEN doc_id % 5 > 2 THEN 'f' || doc_id END AS final, CASE WHEN doc_id % 5 > 2 THEN '{"question":"q"}' END AS asked FROM documents""")
def tool_trajectories(spark, sf_dir):
    """Records of a tool call, or the reason why one is skipped."""
    k = F.col("doc_id")
    good = F.concat(F.lit('{"user_question":"u","tool_query":"q","simulated_result":"s","final_answer":"f'), k.cast("string"), F.lit('"}'))
    answer = F.when(k % 5 == 1, "sorry").when(k % 5 == 2, '{"user_question":"u"}').otherwise(good)
    rows = table(spark, sf_dir, "documents").select(k.alias("worker"), F.when(k % 5 == 0, 0).otherwise(3).alias("n_facts"), answer.alias("answer"))
    get = lambda path: F.get_json_object("value", path)
    return training.trajectories(rows, "query_graph", "Use the tool.").select("worker", get("$.__skipped__").alias("skipped"), get("$.messages[4].content").alias("final"), get("$.messages[2].tool_calls[0].function.arguments").alias("asked"))


@query(D + """, s AS (SELECT DISTINCT 'agent' || (doc_id % 2) AS source, 'agent' || (doc_id % 2 + 2) AS target FROM documents), l AS (SELECT * FROM s ORDER BY md5('7:' || source || ':' || target) LIMIT 1)
SELECT id FROM docs WHERE agent_id IN (SELECT source FROM l UNION SELECT target FROM l) ORDER BY md5('7:' || id), id LIMIT 8""")
def bridge_sample(spark, sf_dir):
    """Eight nodes of the two agents of one link, drawn by a seed."""
    k = F.col("doc_id") % 2
    links = table(spark, sf_dir, "documents").select(F.concat(F.lit("agent"), k.cast("string")).alias("source"), F.concat(F.lit("agent"), (k + 2).cast("string")).alias("target")).distinct()
    n = document_nodes(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return training.sampled_facts(n, links, 7).select(F.col("id").cast("long").alias("id"))


@query("SELECT count(*) FILTER (WHERE doc_id % 13 > 0) > 0 AS usable FROM documents")
def usage_signal(spark, sf_dir):
    return spark.createDataFrame([(training.has_usage_signal(document_nodes(spark, sf_dir)),)], "usable boolean")


# Scorers
@query("""SELECT doc_id, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 2 / 3.0::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN 1 / 3.0::DOUBLE ELSE 0 END AS p,
CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN 0.5 ELSE 1 END AS r FROM documents)""")
def set_scores(spark, sf_dir):
    """Precision, recall and F1 of names as sets in any case."""
    k = F.col("doc_id")
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    found = F.when(k % 4 == 1, arr()).otherwise(arr("Ann", "bob", "ANN", "x"))
    expected = F.when(k % 4 == 0, arr("ann", "BOB")).when(k % 4 == 1, arr("ann")).when(k % 4 == 2, arr("ann", "zed")).otherwise(arr())
    p, r, f1 = analytics.set_scores(found, expected)
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def corpus_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, contains(lower(text), 'tion') AND contains(lower(text), 'the') AS good FROM documents")
def substring_judge(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.holds_all(F.col("text"), F.array(F.lit("TION"), F.lit("the"))).alias("good"))


@query(r"""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS low, lower(trim(substr(coalesce(text, ''), 5, 6))) AS a FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN length(a) >= 3 AND a NOT IN ('yes', 'no') THEN (contains(low, a) AND low <> '')::INT::DOUBLE END
  WHEN 1 THEN CASE WHEN low = '' THEN 0 ELSE (contains(low, 'the')::INT + contains(low, 'zzz')::INT) / 2.0::DOUBLE END END AS hit FROM a""")
def retrieval_hit(spark, sf_dir):
    """Answer containment, or the share of titles for answers that say yes or are too short; over all texts."""
    k = F.col("doc_id")
    titles = F.when(k % 3 == 1, F.array(F.lit("The"), F.lit("zzz"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", texts.retrieval_hit(F.col("text"), F.when(k % 3 == 0, F.substring("text", 5, 6)).when(k % 3 == 1, "Yes").otherwise("no"), titles).alias("hit"))


@query("""SELECT event_type AS model, round(sum((event_id % 1000 + 10) / 1e6 * CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN 0.15 ELSE 0 END + coalesce(user_id, 0) / 1e6 * CASE event_type WHEN 'click' THEN 5.0 WHEN 'error' THEN 0.6 ELSE 0 END), 9) AS cost FROM events GROUP BY 1""")
def run_costs(spark, sf_dir):
    """Cost of runs by the tokens of both sides; a model without a price costs nothing."""
    e = table(spark, sf_dir, "events").select(
        F.lit("p").alias("provider"), F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens_in"), F.col("user_id").alias("tokens_out"), F.lit(10).alias("backend_tokens_in"), F.lit(None).cast("long").alias("backend_tokens_out"))
    prices = spark.createDataFrame([("p", "click", 1.0, 5.0), ("p", "error", 0.15, 0.6)], "provider string, model string, price_in double, price_out double")
    return analytics.run_costs(e, prices).groupBy("model").agg(F.round(F.sum("cost"), 9).alias("cost"))
