"""Operators that SQL does not express, and edge cases, against plain Python."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import scores, texts
from loomspark.operators import analytics, graph, ingest, memory, retrieval, similarity, training
from loomspark.operators.bucketed import BucketedTable
from loomspark.plans import text_queries
from loomspark.sources import connectors, star
from loomspark.streaming import jobs, keyed

SF = "/root/testdata/sf0.001"


def test_mmr_is_the_greedy_choice(spark):
    got = text_queries.mmr_select(spark, SF).toPandas()
    n = star.vector_nodes(spark, SF)
    top = retrieval.vector_topk(n, text_queries._queries(n), 40).join(n.select("id", "embedding"), "id").toPandas()
    for q, group in top.groupby("query_id"):
        group = group.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(group.embedding) / np.linalg.norm(np.stack(group.embedding), axis=1)[:, None]
        s = ((group.score - group.score.min()) / (group.score.max() - group.score.min())).to_numpy()
        chosen = [0]
        while len(chosen) < 15:
            rest = [i for i in range(len(s)) if i not in chosen]
            chosen.append(max(rest, key=lambda i: (0.5 * s[i] - 0.5 * max(x[i] @ x[j] for j in chosen), -i)))
        assert got[got.query_id == q].sort_values("pick").id.tolist() == group.id[chosen].tolist()


def test_char_chunks_cover_the_text():
    text = ("Some words here. " * 300).strip()
    chunks = ingest.char_chunks(text)
    assert all(len(c) <= 1200 for c in chunks) and chunks[0].endswith(".") and chunks[-1].endswith("here.")
    assert ingest.char_chunks("short") == ["short"] and ingest.char_chunks("") == [""]
    assert all(len(c.split()) <= 500 for c in ingest.token_chunks(text)) and ingest.token_chunks("") == []


def plain_chunks(text):
    """The definition anew: windows of 1,200, cut behind the last '. ' past 600 but for the last, the next 150 back."""
    if len(text) <= 1200:
        return [text]
    out, start = [], 0
    while True:
        window, last = text[start : start + 1200], start + 1200 >= len(text)
        stop = max((i for i in range(len(window) - 1) if window[i : i + 2] == ". "), default=-1)
        if not last and stop > 600:
            window = window[: stop + 1]
        out += [window.strip()] if window.strip() else []
        if last:
            return out
        start += max(len(window) - 150, 1)


def test_chunk_query_counts(spark):
    rows = text_queries.chunk_documents(spark, SF).toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for doc, group in rows.groupby("doc_id"):
        assert group.sort_values("chunk_no").chunk.tolist() == plain_chunks(docs[doc])


def test_rouge_l(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for i, y in enumerate(b, 1):
                last, row[i] = row[i], last + 1 if x == y else max(row[i], row[i - 1])
        return row[-1]

    rows = spark.createDataFrame([("the cat sat on a mat", "a cat sat on mats"), ("x", "x"), ("", "y"), ("", "")], "p string, g string")
    got = rows.select(texts.answer_tokens(F.col("p")).alias("ps"), texts.answer_tokens(F.col("g")).alias("gs"), texts.lcs_f(F.col("p"), F.col("g")).alias("f")).collect()
    for r in got:
        n = lcs(r.ps, r.gs)
        want = float(len(r.ps) == len(r.gs)) if not r.ps or not r.gs else 2 * n / (len(r.ps) + len(r.gs))
        assert r.f == pytest.approx(want)


def test_scores(spark):
    row = spark.range(1).select(
        scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        scores.synaptic_score(F.lit(None).cast("double"), F.lit(0.5), F.lit(0), F.lit(1.0)).alias("s"),
        scores.dynamic_decay(F.lit(5.0), F.lit(1), F.lit(-3.0)).alias("d"), scores.similarity(F.lit("AB"), F.lit("ab")).alias("same")).first()
    assert row.zero == 0 and row.s == pytest.approx(0.5 * np.exp(-0.05)) and row.d == 1 and row.same == 1
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(scores.dynamic_decay(F.lit(1.0), F.lit(-1), F.lit(1.0))).collect()


def test_text_helpers(spark):
    row = spark.range(1).select(
        texts.keywords(F.lit("Été à Paris, the CITY of")).alias("k"), texts.json_object_text(F.lit('x ```json\n{"a": {"b": 1}}\n``` y')).alias("j"), texts.json_array_text(F.lit("none")).alias("a"),
        texts.is_script_shell(F.lit("Please enable JavaScript")).alias("shell"), texts.is_script_shell(F.lit("Loading... please wait")).alias("real"), texts.redacted(F.lit("token=abc,d;e&f sk-abcdefghijk https://me:pw@host Bearer a:b|c")).alias("r"),
        texts.node_type(F.lit(" company ")).alias("t"), texts.relation_type(F.lit("was_built")).alias("rel")).first()
    assert row.k == ["été", "paris", "the", "city"] and json.loads(row.j) == {"a": {"b": 1}} and row.a == "[]" and row.shell
    assert not row.real and row.r == "[REDACTED] [REDACTED] https[REDACTED]host [REDACTED]" and row.t == "ORGANIZATION" and row.rel == "CREATED"


def test_components_and_paths_on_a_small_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = spark.createDataFrame([("1", "a", "b", "R", 1.0), ("2", "b", "c", "R", 0.5), ("3", "c", "a", "R", 0.5), ("4", "d", "e", "R", 1.0)], "id string, source_id string, target_id string, relation string, weight double")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    paths = {"".join(r.path) for r in graph.simple_paths(edges, nodes, 3).collect()}
    assert paths == {"ab", "abc", "bc", "bca", "ca", "cab", "de"}
    assert {r.id: r.hops for r in graph.within_hops(edges, nodes.where("id = 'a'"), 1).collect()} == {"a": 0, "b": 1, "c": 1}
    assert sum(r["rank"] for r in graph.pagerank(nodes, edges, 8).collect()) == pytest.approx(1)


def test_upsert_keeps_what_it_must(spark):
    old = spark.createDataFrame([("1", "L", "T", "x", "old", None)], "id string, label string, type string, agent_id string, properties string, description string")
    new = spark.createDataFrame([("1", "M", "U", "y", None, "d", 0), ("1", "N", "U", "y", "new", None, 1), ("2", "A", "B", "z", "p", None, 0)], "id string, label string, type string, agent_id string, properties string, description string, ordinal int")
    got = {r.id: r for r in memory.upsert_nodes(old, new, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert (got["1"].label, got["1"].type, got["1"].properties, got["1"].action) == ("L", "T", "new", "merged")
    assert got["2"].action == "created" and got["2"].label == "A"
    again = memory.upsert_nodes(memory.upsert_nodes(old, new, F.lit("2024-01-01").cast("timestamp")).drop("action", "updated_at"), new, F.lit("2024-01-01").cast("timestamp"))
    assert again.where("action = 'created'").count() == 0


def test_fusion_is_not_chained(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.98), ("a", "c", 0.96)], "keep_id string, drop_id string, similarity double")
    assert {(r.id, r.canonical_id) for r in memory.fuse(pairs).collect()} == {("b", "a"), ("c", "a")}


def test_guarded_sql(spark):
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) DELETE FROM b"):
        with pytest.raises(ValueError, match="reading"):
            connectors.guarded_sql(spark, bad)
    assert connectors.guarded_sql(spark, "SELECT 'drop' AS x, :n AS n", n=3).first() == ("drop", 3)


def test_ndjson_round_trip(spark):
    nodes = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, label string")
    edges = spark.createDataFrame([("e", "1", "2"), ("f", "1", "9")], "id string, source_id string, target_id string")
    lines = connectors.export_ndjson(nodes, edges).select("value").union(spark.createDataFrame([("oops",)], "value string"))
    n, e, skipped = connectors.import_ndjson(lines, "id string, label string", "id string, source_id string, target_id string")
    assert sorted(map(tuple, n.collect())) == [("1", "A"), ("2", "B")] and e.count() == 1 and skipped.count() == 2
    n, e, _ = connectors.import_ndjson(lines, "id string, label string", "id string, source_id string, target_id string", salt="s")
    assert {r.source_id for r in e.collect()} <= {r.id for r in n.collect()} and "1" not in {r.id for r in n.collect()}


def test_uploads(spark, tmp_path):
    for name, body in (("a.html", "<p>Hi <b>you</b></p><script>x</script>"), ("b.txt", "plain"), ("c.pdf", "%PDF"), ("d.txt", "")):
        (tmp_path / name).write_text(body)
    rows = {r.path.rsplit("/", 1)[1]: r for r in connectors.uploads(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()}
    assert rows["a.html"].text == "Hi\nyou" and rows["b.txt"].text == "plain" and "no parser" in rows["c.pdf"].error and "d.txt" not in rows


def test_payload_merge_and_retries(spark):
    n = spark.createDataFrame([("p", 1, "Ann"), ("p", 2, "ANN"), ("p", 3, "Bob")], "payload string, ordinal int, label string")
    e = spark.createDataFrame([("p", 1, "ANN", "Ann", "R"), ("p", 2, "ANN", "Bob", "R"), ("p", 3, "Ann", "Bob", "R"), ("p", 4, "Ann", "Zed", "R")], "payload string, ordinal int, source string, target string, relation string")
    nodes, edges = ingest.merge_payload(n, e)
    assert {r.label for r in nodes.collect()} == {"Ann", "Bob"} and [(r.source, r.target) for r in edges.collect()] == [("Ann", "Bob")]
    a = spark.createDataFrame([(1, 0, 1, False), (1, 1, 3, True), (2, 0, 1, False), (2, 0, 4, True)], "doc_id int, chunk_no int, attempt int, ok boolean")
    good, bad = ingest.retries(a)
    assert [r.doc_id for r in good.collect()] == [1] and [r.doc_id for r in bad.collect()] == [2]


def test_similar_pairs_need_no_order(spark):
    n = star.vector_nodes(spark, SF)
    assert {(r.a, r.b) for r in similarity.similar_pairs(n, 0.3, rows=1000).collect()} == {(r.a, r.b) for r in similarity.similar_pairs(n, 0.3, rows=30).collect()}


def test_training_lines(spark):
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, ""), (3, "[1]"), (4, "{")], "line_no int, value string")
    assert {r.line_no: r.problem for r in training.validated_lines(lines).collect()} == {3: "not an object", 4: "not JSON"}
    ex = spark.createDataFrame([("do", None, "done")], "instruction string, context string, response string")
    assert json.loads(training.alpaca(ex).first().value) == {"instruction": "do", "input": "", "output": "done"}
    assert json.loads(training.openai(ex).first().value)["messages"][1]["content"] == "done"


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_streamed_limit_matches_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=i * 7 % 100), i % 3) for i in range(60)]
    schema = "event_id long, ts timestamp, user_id long"
    out = keyed.limited(_stream(spark, str(tmp_path / "in"), rows, schema), 5, 30)
    with keyed.keyed_state(spark):
        query = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    batch = analytics.rate_limit(spark.createDataFrame(rows, schema), 5, 30).select("event_id", "used").collect()
    # Events of equal time count together in the batch form, one after the other in the stream.
    streamed = {r.event_id: r.used for r in spark.table("limited").collect()}
    assert {r.event_id: r.used for r in batch} == streamed


def test_hourly_stream_matches_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=11 * i), i % 2, float(i)) for i in range(50)]
    schema = "ts timestamp, user_id long, value double"
    out = jobs.hourly_stream(_stream(spark, str(tmp_path / "in"), rows, schema))
    query = out.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    batch = spark.createDataFrame(rows, schema).groupBy(F.date_trunc("HOUR", "ts").alias("start"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.collect()))


def test_upsert_sink_is_idempotent(spark, tmp_path):
    schema = "id string, v int, ordinal int"
    source = _stream(spark, str(tmp_path / "in"), [("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], schema)
    table = BucketedTable.create(spark.createDataFrame([], schema), str(tmp_path / "t"))
    rows = lambda: sorted(tuple(r) for r in table.read().collect())

    def merge(old, new):
        return old.join(new.select("id"), "id", "left_anti").unionByName(new)

    sink = jobs.upsert_sink(table, merge)
    query = source.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    first = rows()
    sink(spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], schema), 0)
    assert rows() == first == [("a", 2, 1), ("b", 3, 0)]


def test_triage(spark):
    m = spark.createDataFrame([(1, 0, False, False), (2, 0, True, False), (3, 2, True, False), (4, 0, False, True)], "id int, attempts int, failed boolean, fatal boolean")
    done, again, dead = jobs.triage(m, F.col("failed"), F.col("fatal"))
    assert [[r.id for r in x.orderBy("id").collect()] for x in (done, again, dead)] == [[1], [2], [3, 4]]
