"""Vector, keyword, text, metric and training-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.functions import texts
from loomspark.functions.scores import cleared
from loomspark.operators import analytics, ingest, retrieval, similarity, training
from loomspark.operators.folders import scratch
from loomspark.operators.text_index import TextIndex
from loomspark.operators.vector_index import VectorIndex
from loomspark.plans.catalog import query, table
from loomspark.sources.star import VECTORS, vector_nodes

V = f"WITH {VECTORS} "
COS = "list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm)"


def _queries(n):
    """The stated query set: every vector whose id is divisible by 20."""
    return n.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


@query(V + f", s AS (SELECT a.id AS query_id, b.id AS id, {COS} AS s FROM vecs a JOIN vecs b ON a.id % 20 = 0 AND b.agent_id = 'agent1') SELECT query_id, id, round(s, 6) AS score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM s) WHERE r <= 10")
def vector_topk(spark, sf_dir):
    n = vector_nodes(spark, sf_dir)
    return retrieval.vector_topk(n, _queries(n), 10, F.col("agent_id") == "agent1").withColumn("score", F.round("score", 6))


@query(V + f", s AS (SELECT a.id AS query_id, b.id AS id, {COS} AS s FROM vecs a JOIN vecs b ON a.id % 20 = 0 AND coalesce(b.clearance, 1) <= 2) SELECT query_id, id, round(s, 6) AS score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM s) WHERE r <= 10")
def vector_topk_clearance(spark, sf_dir):
    n = vector_nodes(spark, sf_dir)
    return retrieval.vector_topk(n, _queries(n), 10, cleared(F.col("clearance"), 2)).withColumn("score", F.round("score", 6))


@query(V + f""", now AS (SELECT id, clearance, CASE WHEN id % 30 = 0 THEN list_reverse(e) ELSE e END AS e, norm FROM vecs WHERE id % 13 <> 0),
s AS (SELECT a.id AS query_id, b.id AS id, {COS} AS s FROM vecs a JOIN now b ON a.id % 20 = 0 AND coalesce(b.clearance, 1) <= 2)
SELECT query_id, id, round(s, 6) AS score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM s) WHERE r <= 10""")
def vector_index_search(spark, sf_dir):
    """The index on disk after rows have moved and gone, asked for what a caller may see."""
    n = vector_nodes(spark, sf_dir)
    index = VectorIndex.build(n, scratch(spark, "vector-index"))
    index.upsert(n.where("id % 30 = 0").withColumn("embedding", F.reverse("embedding")))
    index.delete(n.where("id % 13 = 0"))
    return index.search(_queries(n), 10, cleared(F.col("clearance"), 2)).withColumn("score", F.round("score", 6))


@query(V + f"SELECT a.id AS a, b.id AS b, round({COS}, 6) AS similarity FROM vecs a JOIN vecs b ON a.id < b.id AND a.agent_id = b.agent_id WHERE {COS} >= 0.38")
def dup_pairs(spark, sf_dir):
    return similarity.similar_pairs(vector_nodes(spark, sf_dir), 0.38).withColumn("similarity", F.round("similarity", 6))


@query(V + f"SELECT a.id AS a, b.id AS b, round({COS}, 6) AS similarity FROM vecs a JOIN vecs b ON a.id < b.id AND a.agent_id = b.agent_id WHERE {COS} BETWEEN 0.3 AND 0.36")
def link_candidates_band(spark, sf_dir):
    return similarity.similar_pairs(vector_nodes(spark, sf_dir), 0.3, 0.36).withColumn("similarity", F.round("similarity", 6))


@query(V + "SELECT len(e)::INT AS dims, count(*) AS n FROM vecs GROUP BY 1")
def embedding_dims(spark, sf_dir):
    return vector_nodes(spark, sf_dir).groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'disgusting') OR contains(lower(text), 'scum')")
def keyword_search(spark, sf_dir):
    hit = F.exists(F.array(F.lit("disgusting"), F.lit("scum")), lambda k: F.contains(F.lower("text"), k))
    return table(spark, sf_dir, "documents").where(hit).select("doc_id", "lang")


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
FULL = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: starts_with(x, 'tion'))) AS f0, len(list_filter(ws, lambda x: starts_with(x, 'clown'))) AS f1 FROM w),
s AS (SELECT count(*) AS c, avg(n) AS a, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM c),
b AS (SELECT doc_id, ln(1 + (c - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / a)) + ln(1 + (c - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / a)) AS s FROM c, s WHERE f0 + f1 > 0)
"""


def _fulltext(spark, sf_dir):
    return retrieval.fulltext(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["tion", "clown"])


@query(FULL + "SELECT doc_id, round(s, 5) AS score FROM b")
def text_index_search(spark, sf_dir):
    """The same scores from the index on disk, for all rows that match."""
    index = TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), scratch(spark, "text-index"))
    return index.search(["tion", "clown"]).select(F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


@query(FULL + "SELECT doc_id, round(s, 5) AS score FROM b ORDER BY s DESC, doc_id LIMIT 25")
def fulltext_topk(spark, sf_dir):
    return _fulltext(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(25).withColumn("score", F.round("score", 5))


@query(FULL + """, l AS (SELECT 'text' AS list, doc_id AS id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM b),
v AS (SELECT 'size' AS list, doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents),
u AS (SELECT * FROM l WHERE r <= 40 UNION ALL SELECT * FROM v WHERE r <= 40) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM u GROUP BY id""")
def rrf_hybrid(spark, sf_dir):
    ranked = lambda df, by, name: df.orderBy(F.desc(by), "doc_id").limit(40).withColumn("rank", F.row_number().over(W.orderBy(F.desc(by), "doc_id"))).select(F.lit(1).alias("query_id"), F.lit(name).alias("list"), "rank", F.col("doc_id").alias("id"))
    lists = ranked(_fulltext(spark, sf_dir), "score", "text").unionByName(ranked(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "size"))
    return retrieval.rrf(lists).select("id", F.round("score", 8).alias("score"))


@query()
def mmr_select(spark, sf_dir):
    """Greedy re-ranking of 40 candidates a query to 15; tests hold it against a plain loop."""
    n = vector_nodes(spark, sf_dir)
    top = retrieval.vector_topk(n, _queries(n), 40)
    return retrieval.mmr(top.join(n.select("id", "embedding"), "id"))


@query("SELECT 'fact:' || doc_id AS id, 'fact: ' || substr(replace(trim(text, ' '), chr(10), ' '), 1, 200) || CASE WHEN length(text) > 200 THEN '…' ELSE '' END AS label, 'FACT' AS type FROM documents WHERE regexp_matches(text, '\\S')")
def fact_nodes(spark, sf_dir):
    return ingest.fact_nodes(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", "label", "type")


@query()
def chunk_documents(spark, sf_dir):
    """Overlapping character chunks; tests hold them against their definition."""
    return ingest.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")


def _values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs.items())


TYPED = {"startup": "ORGANIZATION", " City ": "LOCATION", "framework": "TECHNOLOGY", "PERSON": "PERSON", "Year": "DATE", "revenue": "METRIC", "book": "DOCUMENT", "theory": "CONCEPT", "Team": "TEAM", "gadget": "OTHER"}
SAID = {
    "employed_by": "WORKS_AT", "MANAGES": "LEADS", "was_founded_by": "FOUNDED_BY", "is_headquartered_in": "LOCATED_IN", "ARE_PART_OF": "PART_OF", "relies_on": "DEPENDS_ON", "is_ceo_of": "IS_CEO_OF",
    "bought": "ACQUIRED", "LIKES": "RELATED_TO", "was_used": "USES", "": "RELATED_TO",
}


@query(f"""WITH t(raw, type) AS (VALUES {_values(TYPED)}), r(raw, relation) AS (VALUES {_values(SAID)}),
a AS (SELECT *, row_number() OVER (ORDER BY raw) - 1 AS i FROM t), b AS (SELECT *, row_number() OVER (ORDER BY raw) - 1 AS i FROM r)
SELECT p_partkey, type, relation FROM part JOIN a ON a.i = p_partkey % {len(TYPED)} JOIN b ON b.i = p_partkey % {len(SAID)}""")
def type_normalise(spark, sf_dir):
    """Every branch: known names, aliases, a leading copula, and what is not known."""
    pick = lambda d, k: F.element_at(F.array(*[F.lit(x) for x in sorted(d)]), (k % len(d) + 1).cast("int"))
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", texts.node_type(pick(TYPED, k)).alias("type"), texts.relation_type(pick(SAID, k)).alias("relation"))


QA = r"""WITH c AS (SELECT count(*) AS n FROM benchmark), o AS (SELECT item_id, text AS gold, lead(text) OVER (ORDER BY item_id) AS after, first(text) OVER (ORDER BY item_id) AS top FROM benchmark),
r AS (SELECT item_id, gold, coalesce(after, top) AS other FROM o),
n AS (SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN item_id % 4 = 0 THEN gold ELSE other || ' the ' || gold END), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS p,
       trim(regexp_replace(regexp_replace(regexp_replace(lower(gold), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS g FROM r),
t AS (SELECT *, string_split(p, ' ') AS ps, string_split(g, ' ') AS gs FROM n), c2 AS (SELECT *, len(list_filter(ps, lambda x: list_contains(gs, x))) AS m FROM t)
SELECT item_id, (p = g)::INT AS exact, round(CASE WHEN m = 0 THEN 0 ELSE 2.0::DOUBLE * (m / len(ps)) * (m / len(gs)) / (m / len(ps) + m / len(gs)) END, 6) AS f1 FROM c2 WHERE p IS NOT NULL"""


def _answers(spark, sf_dir):
    """Each benchmark text as gold, and as prediction itself or, behind the next one's, once more."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    ring = W.orderBy("item_id")  # a table of a few hundred tasks
    b = b.withColumn("other", F.coalesce(F.lead("gold").over(ring), F.first("gold").over(ring)))
    pred = F.when(F.col("item_id") % 4 == 0, F.col("gold")).otherwise(F.concat("other", F.lit(" the "), "gold"))
    return b.select("item_id", "gold", pred.alias("pred"))


@query(QA)
def qa_em_f1(spark, sf_dir):
    same = (texts.answer_text(F.col("pred")) == texts.answer_text(F.col("gold"))).cast("int")
    return _answers(spark, sf_dir).select("item_id", same.alias("exact"), F.round(texts.token_f1(F.col("pred"), F.col("gold")), 6).alias("f1"))


@query()
def rouge_l(spark, sf_dir):
    """Longest common subsequence F; tests hold it against a plain table."""
    return _answers(spark, sf_dir).select("item_id", F.round(texts.lcs_f(F.col("pred"), F.col("gold")), 6).alias("rouge_l"))


@query("SELECT role, count(*) AS n, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM conversations GROUP BY role")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(texts.token_estimate(F.col("text"))).alias("tokens"))


@query("""WITH d AS (SELECT doc_id, greatest(1, length(text) // 4) AS t, md5(doc_id::VARCHAR) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
s AS (SELECT *, coalesce(sum(t) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d) SELECT doc_id, b::BIGINT AS before FROM s WHERE b < 20000""")
def budget_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", texts.token_estimate(F.col("text")).alias("t"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    d = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return analytics.until_budget(d, "t", 20000, [F.col("h"), F.col("doc_id")]).select("doc_id", "before")


@query("""SELECT 'agent' || (doc_id % 5) AS agent_id, coalesce(source, 'Unknown') AS label, md5('{"messages":[{"role":"user","content":' || to_json('What do you know about ' || coalesce(source, 'Unknown') || '?')
  || '},{"role":"assistant","content":' || to_json(CASE WHEN text <> '' THEN text || ' ' ELSE '' END || CASE WHEN lang <> coalesce(text, '') THEN lang || ' ' ELSE '' END || 'Also known as: ' || lang || ', d' || doc_id || '.') || '}]}') AS line
FROM documents WHERE coalesce(CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 END, 0) <= 1""")
def chatml_export(spark, sf_dir):
    """A question and an answer of the whole description, source text and aliases for each cleared document, as digests of the lines."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("agent"), (k % 5).cast("string")).alias("agent_id"), F.coalesce("source", F.lit("Unknown")).alias("label"), F.col("text").alias("description"),
        F.col("lang").alias("source_text"), F.array("lang", F.concat(F.lit("d"), k.cast("string"))).alias("aliases"), F.when(k % 7 != 0, k % 3).alias("clearance"))
    return training.chatml(rows, 1).select("agent_id", "label", F.md5(F.col("line").cast("binary")).alias("line"))


@query("""WITH l AS (SELECT doc_id AS line_no, CASE doc_id % 4 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN '[1]' WHEN 2 THEN 'no {' ELSE ' ' END AS value FROM documents)
SELECT line_no, CASE WHEN line_no % 4 = 1 THEN 'not an object' ELSE 'not JSON' END AS problem FROM l WHERE line_no % 4 IN (1, 2)""")
def jsonl_validate(spark, sf_dir):
    k = F.col("doc_id") % 4
    value = F.when(k == 0, F.lit('{"a": 1}')).when(k == 1, F.lit("[1]")).when(k == 2, F.lit("no {")).otherwise(F.lit(" "))
    return training.validated_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), value.alias("value")))


@query(r"""SELECT doc_id, 'error at ' || source || ': [REDACTED] and [REDACTED] or [REDACTED] via db[REDACTED]h' AS shown FROM documents""")
def error_redaction(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("error at "), "source", F.lit(": Bearer a:b|c,"), k, F.lit(" and passwd=x;y&"), k, F.lit(" or Access-Key: z,"), k, F.lit(" via db://u:pw@h"))
    return table(spark, sf_dir, "documents").select("doc_id", texts.redacted(raw).alias("shown"))


@query("""WITH n AS (SELECT source AS payload, doc_id AS ordinal, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS label FROM documents), f AS (SELECT payload, lower(label) AS l, min(ordinal) AS ordinal, arg_min(label, ordinal) AS label FROM n GROUP BY 1, 2),
e AS (SELECT n.payload, a.label AS source, b.label AS target FROM n JOIN f a ON a.payload = n.payload AND a.l = lower(n.label) JOIN f b ON b.payload = n.payload AND b.l = 'en' WHERE EXISTS (SELECT 1 FROM n m WHERE m.payload = n.payload AND m.label = 'en') AND a.l <> 'en')
SELECT 'node' AS kind, payload, label AS source, NULL AS target FROM f UNION ALL SELECT DISTINCT 'edge', payload, source, target FROM e""")
def payload_merge(spark, sf_dir):
    """Nodes of one label in any case become one, edges follow."""
    d = table(spark, sf_dir, "documents")
    n = d.select(F.col("source").alias("payload"), F.col("doc_id").alias("ordinal"), F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("label"))
    e = n.select("payload", "ordinal", F.col("label").alias("source"), F.lit("en").alias("target"), F.lit("X").alias("relation"))
    kept, joined = ingest.merge_payload(n, e)
    return kept.select(F.lit("node").alias("kind"), "payload", F.col("label").alias("source"), F.lit(None).cast("string").alias("target")).unionByName(joined.select(F.lit("edge").alias("kind"), "payload", "source", "target"))


@query("SELECT user_id % 3 AS agent_id, count(*) AS n FROM events GROUP BY 1")
def guarded_sql(spark, sf_dir):
    from loomspark.sources.connectors import guarded_sql as run

    table(spark, sf_dir, "events").createOrReplaceTempView("guarded_events")
    return run(spark, "SELECT user_id % 3 AS agent_id, count(*) AS n FROM guarded_events GROUP BY 1")
