"""Sources, sinks, streams and operators that need more than a table: against plain Python."""

import datetime as dt
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import texts
from loomspark.operators import access, analytics, context, graph, ingest, memory, retrieval, training, upkeep, writes
from loomspark.plans import context_queries
from loomspark.sources import connectors, star
from loomspark.streaming import jobs, keyed

SF = "/root/testdata/sf0.001"
NOW = "2024-01-31"


def at(spark, text=NOW):
    return F.lit(text).cast("timestamp")


def test_every_query_of_a_large_set_is_answered(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    asked = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for size in (32 << 20, 20_000):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        got = retrieval.vector_topk(df, asked, 3).toPandas()
        assert got.query_id.nunique() == 1500 and len(got) == 4500
        for q in (0, 700, 1499):
            want = np.argsort(-(unit @ unit[q]), kind="stable")[:3].tolist()
            assert got[got.query_id == q].sort_values("rank").id.tolist() == want
    with pytest.raises(Exception, match="differ in length"):
        retrieval.vector_topk(df, asked.select("query_id", F.slice("vector", 1, 3).alias("vector")), 3).collect()
    assert retrieval.vector_topk(df, asked.limit(0), 3).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def test_fuzzy_pairs_brute_force(spark):
    rng = np.random.default_rng(4)
    labels = []
    for _ in range(25):
        base = [chr(97 + c) for c in rng.integers(0, 5, rng.integers(3, 30))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.integers(0, 5)):
                i = int(rng.integers(0, len(copy)))
                copy[i : i + int(rng.integers(0, 2))] = [chr(97 + int(rng.integers(0, 5)))] * int(rng.integers(0, 2))
                copy = copy or ["a"]
            labels.append("".join(copy))
    df = spark.createDataFrame([(i, "t", s.upper() if i % 3 == 0 else s) for i, s in enumerate(labels)], "id long, agent_id string, label string")
    got = {(r.id, r.match_id) for r in retrieval.fuzzy_pairs(df, df, "agent_id").collect()}
    want = {(i, j) for i, a in enumerate(labels) for j, b in enumerate(labels) if a != b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.85 - 1e-12}
    assert got == want and len(want) > 20


def test_labels_with_a_common_part_do_not_all_meet(spark):
    names = spark.range(3000).select("id", F.lit("t").alias("agent_id"), F.format_string("Supplier#%09d", F.col("id") * 104_729 % 1_000_000_000).alias("label"))
    assert retrieval.label_candidates(names, names, "agent_id").count() < 3000 * 40  # nearly nine million meet by their parts


def test_labels_that_number_on_meet_few_others_and_are_never_broadcast(spark):
    """What labels meet by is many times their size, whatever the optimizer takes it for."""
    names = spark.range(2000).select("id", F.lit("t").alias("agent_id"), F.format_string("Supplier#%09d", "id").alias("label"))
    names = names.unionByName(names.where("id < 50").withColumn("label", F.expr("left(label, length(label) - 1 - cast(id % 2 as int))")))
    met = retrieval.label_candidates(names, names, "agent_id")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    apart = F.levenshtein("l", "kl")
    assert met.where((F.length("l") == F.length("kl")) & (apart > 2)).isEmpty()
    labels = names.select("agent_id", F.lower("label").alias("l")).distinct()
    near = labels.join(labels.select(F.col("l").alias("kl")), F.col("l") != F.col("kl")).where(apart <= 2)
    assert met.where(apart <= 2).count() == near.count()


def test_products_of_vectors_are_bounded(spark, monkeypatch):
    """A block of scores holds a bounded number of queries and rows, and a task keeps no more than k rows for a query."""
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, (700, 4)).astype(float)  # many ties and zero vectors
    df = spark.createDataFrame([(i, "t", v.tolist()) for i, v in enumerate(x)], "id long, agent_id string, embedding array<double>").coalesce(1)
    asked = df.select(F.col("id").alias("query_id"), "agent_id", F.col("embedding").alias("vector"))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    want = np.round(-np.sort(-(u @ u.T), axis=1)[:, :5], 9)
    for name in ("ROWS_AT_ONCE", "QUERIES_AT_ONCE", "ASKED_AT_ONCE"):
        monkeypatch.setattr(retrieval, name, 64)
    best = retrieval._best_of(df.select("id", "embedding"), asked.select("query_id", "vector"), 5, "query_id long, id long, score double").toPandas()
    assert len(best) == 700 * 5
    near = retrieval.nearest_of_tenant(asked, df, 5, rows=128, least=0.8765).toPandas()
    for found, low in ((best, -2), (near, 0.8765)):
        got = {q: np.round(-np.sort(-g["score"].to_numpy()), 9).tolist() for q, g in found.groupby("query_id")}
        assert got == {q: w for q, row in enumerate(want) if (w := [v for v in row.tolist() if v >= low])}


def test_fuzzy_labels_with_copies_of_names_match_their_sql(spark, tmp_path):
    import duckdb
    from conftest import same_rows

    from loomspark.plans import graph_queries
    from loomspark.plans.catalog import SQL

    s = spark.read.parquet(f"{SF}/supplier.parquet")
    s.unionByName(s.withColumn("s_suppkey", (F.col("s_suppkey") + 1000).cast(s.schema["s_suppkey"].dataType))).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    same_rows(graph_queries.fuzzy_labels(spark, str(tmp_path)).toPandas(), con.sql(SQL["fuzzy_labels"]).df())


def test_diverse_context_is_the_greedy_choice(spark):
    got = context_queries.context_diverse(spark, SF).toPandas().sort_values("rank")
    n = star.document_nodes(spark, SF).join(star.vector_nodes(spark, SF).select("id", "embedding"), "id").toPandas()
    e = star.document_edges(spark, SF).toPandas()
    use = e.groupby("source_id").weight.mean()
    n = n[n.agent_id.isin(["agent0", "agent1", "agent3"]) & (n.clearance.fillna(1) <= 3)].copy()
    n["s"] = n.id.map(use).fillna(1.0) * n.energy * np.exp(-0.05 / (1 + 0.1 * np.sqrt(n.retrieval_count)))
    n = n[n.s >= 0.3].sort_values(["s", "id"], ascending=[False, True]).head(40).reset_index(drop=True)
    x = np.stack(n.embedding) / np.linalg.norm(np.stack(n.embedding), axis=1)[:, None]
    s = ((n.s - n.s.min()) / (n.s.max() - n.s.min())).to_numpy()
    chosen = [0]
    while len(chosen) < min(15, len(n)):
        chosen.append(max((i for i in range(len(n)) if i not in chosen), key=lambda i: (0.5 * s[i] - 0.5 * max(x[i] @ x[j] for j in chosen), -i)))
    assert got.id.tolist() == (n.id[chosen].tolist() if len(n) > 15 else n.id.tolist())


def test_context_limits_and_empty_context(spark):
    assert (context.context_limit(None), context.context_limit(8), context.context_limit(3)) == (20, 20, 8)
    assert context.terms_of("Is it THE one, the one?") == ["the", "one"]
    n = star.document_nodes(spark, SF).withColumns({"score": F.lit(0.0), "ordinal": F.col("id")}).limit(0)
    assert [r.line for r in context.subgraph_lines(n, star.document_edges(spark, SF)).collect()] == [context.NOTHING]


def test_fusion_keeps_facts_and_verbs(spark):
    n = spark.createDataFrame([(1, "A", "x", [1.0, 0.0]), (2, "A", "x", [1.0, 0.001]), (3, "FACT", "x", [1.0, 0.0]), (4, "A", "y", [1.0, 0.0]), (5, "A", "x", None)], "id long, type string, agent_id string, embedding array<double>")
    e = spark.createDataFrame([("a", 2, 4, "KNOWS", 0.5), ("b", 2, 1, "OWNS", 0.9), ("c", 5, 2, "KNOWS", 0.2), ("d", 5, 1, "KNOWS", 0.7)], "id string, source_id long, target_id long, relation string, weight double")
    pairs = upkeep.fusion_pairs(n, e)
    assert [(r.keep_id, r.drop_id) for r in pairs.collect()] == [(2, 1)]  # 2 has more edges
    nodes, edges, _ = upkeep.fused(n, e, pairs)
    assert {r.id for r in nodes.collect()} == {2, 3, 4, 5} and {(r.source_id, r.target_id, r.relation, r.weight) for r in edges.collect()} == {(2, 4, "KNOWS", 0.5), (5, 2, "KNOWS", 0.7)}


def test_orphans_need_age(spark):
    n = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 30)), (3, None), (4, dt.datetime(2023, 1, 1))], "id long, created_at timestamp")
    e = spark.createDataFrame([(4, 2)], "source_id long, target_id long")
    assert [r.id for r in upkeep.pruned(n, e, at(spark)).collect()] == [1]


def test_unconnected_by_length(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (5, 4)], "source_id long, target_id long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 9)], "a long, b long")
    for longest, want in ((1, {3, 4, 5, 9}), (2, {4, 5, 9}), (3, {5, 9}), (4, {9})):
        assert {r.b for r in upkeep.unconnected(pairs, e, longest).collect()} == want


def test_paths_first_in_first_out(spark):
    e = spark.createDataFrame([("a", "b", "R"), ("b", "c", "S"), ("c", "a", "T"), ("c", "d", "U")], "source_id string, target_id string, relation string")
    n = spark.createDataFrame([(x, x.upper()) for x in "abcd"], "id string, label string")
    paths = graph.breadth_first_paths(e, n, 2, 3, 6)
    assert {"".join(r.path) for r in paths.collect()} == {"abc", "bca", "bcd", "cab", "abcd"}
    assert sorted(r.line for r in training.chain_lines(paths, n).collect())[:2] == ["A --[R]--> B --[S]--> C", "A --[R]--> B --[S]--> C --[U]--> D"]
    spark.udtf.register("sub_paths", graph.SubPaths)
    rows = spark.sql("SELECT * FROM sub_paths(array('a', 'b', 'c'), array('R', 'S'))").collect()
    assert {(r.start, r.finish, r.n_edges, r.relations) for r in rows} == {("a", "b", 1, "R"), ("a", "c", 2, "R>S"), ("b", "c", 1, "S")}


def test_budget_over_ranges(spark):
    rows = [(i, 3) for i in range(100)]
    got = analytics.until_budget(spark.createDataFrame(rows, "k long, size long"), "size", 100, [F.col("k")]).collect()
    assert sorted((r.k, r.before) for r in got) == [(i, 3 * i) for i in range(34)]


def test_resolution_and_traps(spark):
    known = spark.createDataFrame([(1, "Acme Corp", "ORGANIZATION", "t", ["ACME"], [1.0, 0.0], '{"a": 1}')], "id long, label string, type string, agent_id string, aliases array<string>, embedding array<double>, properties string").withColumn("ordinal", F.col("id"))
    new = spark.createDataFrame(
        [("a", "acme corp", "ORGANIZATION", "t", None, '{"b": 2}'), ("b", "Acme Corps", "ORGANIZATION", "t", None, '{"b": 3}'), ("c", "acme", "ORGANIZATION", "t", None, None), ("d", "Else", "ORGANIZATION", "t", [2.0, 0.1], "{}"), ("e", "Acme Corp", "FACT", "t", [1.0, 0.0], "{}"), ("f", "Acme Corp", "ORGANIZATION", "u", [1.0, 0.0], "{}")],
        "id string, label string, type string, agent_id string, embedding array<double>, properties string")
    found = retrieval.resolve(new, known)
    assert {(r.id, r.match_id, r.stage) for r in found.collect()} == {("a", 1, 1), ("b", 1, 2), ("c", 1, 1), ("d", 1, 3)}
    row = retrieval.merged_matches(new, known, found).first()  # all matches of one node are folded in order
    import json

    assert json.loads(row.properties) == {"a": 1, "b": 3} and row.aliases == ["ACME", "Acme Corps", "acme", "Else"]


def test_checked_vectors_in_strict_mode(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id long, embedding array<double>")
    assert {r.id: r.vector_state for r in ingest.checked_vectors(rows, 2, False).collect()} == {1: "ready", 2: "to_embed", 3: "to_embed"}
    with pytest.raises(Exception, match="expected vectors of 2"):
        ingest.checked_vectors(rows, 2, True).collect()


def test_keyset_pages_go_on_until_a_short_one(spark):
    rows = spark.createDataFrame([(i, f"n{i}", None if i % 2 else "x") for i in range(10)], "id long, name string, note string")
    pages = [[(r.cursor, r.text) for r in p.collect()] for p in connectors.keyset_pages(rows, "id", 2, 3, ["name", "note"], "id")]
    assert [len(p) for p in pages] == [3, 3, 1] and pages[0] == [(3, "n3"), (4, "n4\nx"), (5, "n5")]


def test_sql_pages_source(spark, tmp_path):
    path = str(tmp_path / "shop.db")
    with sqlite3.connect(path) as db:
        db.execute("create table products (id integer, name text)")
        db.executemany("insert into products values (?, ?)", [(i, f"p{i}") for i in range(1, 11)])
    spark.dataSource.register(connectors.SqlPages)
    read = spark.read.format("sql_pages").schema("id long, name string").option("database", path).option("query", "select * from products").option("cursor", "id").option("batch", "3")
    assert sorted(r.id for r in read.load().collect()) == list(range(1, 11)) and sorted(r.id for r in read.option("after", "7").load().collect()) == [8, 9, 10]
    with pytest.raises(Exception, match="reading query"):
        read.option("query", "delete from products").load().collect()


def test_files_and_lists(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"a": 1}\nno\n{"a": 2}\n')
    assert sorted(r.a for r in connectors.json_lines(spark, f"file://{tmp_path}/runs.jsonl", "a long").collect()) == [1, 2]
    got = connectors.listed(spark, "- {date: 2024-01-05, text: one, extra: 1}\n- {text: two}\n- nothing\n", "date string, text string").collect()
    assert [tuple(r) for r in got] == [("2024-01-05", "one"), (None, "two")]
    assert connectors.plain_markdown("# Head\n\n- **one** [two](u) `x`\n> said\n```\ncode\n```") == "Head\n\none two x\nsaid\ncode"
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.md").write_text("## Hi *you*")
    (tmp_path / "up" / "b.pdf").write_text("%PDF")
    good, bad = connectors.split_uploads(spark.read.format("binaryFile").load(f"file://{tmp_path}/up"), at(spark))
    assert [r.text for r in good.collect()] == ["Hi you"] and "no parser" in bad.first().reason


def test_kafka_options(spark):
    assert connectors.kafka_source("h:1", "t")["maxOffsetsPerTrigger"] == "100" and connectors.kafka_sink("h:1", "t")["kafka.enable.idempotence"] == "true"
    assert connectors.kafka_range("h:1", "t", 5, 9) == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingTimestamp": "5", "endingTimestamp": "9"}
    row = connectors.kafka_rows(spark.createDataFrame([("a", 1)], "agent_id string, n int")).first()
    assert (row.key, row.value) == ("a", '{"agent_id":"a","n":1}')


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 5), "x" * 2000), (dt.datetime(2024, 2, 5), "y")], "ts timestamp, error string")
    writes.append_by_month(rows, f"file://{tmp_path}/m", error="error")
    back = spark.read.parquet(f"file://{tmp_path}/m")
    assert {str(r.month): len(r.error) for r in back.collect()} == {"202401": 1000, "202402": 1}
    seen = []
    writes.write_twice(lambda df, e: seen.append(df.count()), lambda df, e: seen.append(-df.count()))(rows, 0)
    assert seen == [2, -2]
    tries, waits = [], []

    def send():
        tries.append(1)
        if len(tries) < 3:
            raise OSError

    assert jobs.retried(send, wait=waits.append) == 3 and waits == [0.5, 1.0]
    with pytest.raises(ZeroDivisionError):
        jobs.retried(lambda: 1 / 0, wait=waits.append)
    dead = spark.createDataFrame([("m", "a", "{}", "fatal", 3, "s")], "message_id string, agent_id string, body string, reason string, attempts int, source string")
    row = jobs.dead_letters(dead, "in", at(spark)).first()
    assert row.key == "a" and len(row.headers) == 7 and {h.key: h.value for h in row.headers}["attempts"] == "3"


def test_small_writes(spark):
    rows = spark.createDataFrame([("same",), ("same",), (None,), ("other",)], "t string")
    calls = spark.sparkContext.accumulator(0)

    def embed(batch):
        calls.add(len(batch))
        return [[float(len(t))] for t in batch]

    assert sorted(r.embedding[0] for r in retrieval.embed_once(rows, "t", embed).where("t is not null").collect()) == [4.0, 4.0, 5.0] and calls.value == 2
    first = training.first_of_each(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int"), ["k"], "n")
    assert {(r.k, r.n) for r in first.collect()} == {("a", 1), ("b", 3)}
    n = spark.createDataFrame([("1", "x")], "id string, label string")
    assert writes.reembedded(n, F.col("label"), embed, dry_run=True).first().n_texts == 1
    leases = memory.claim_leases(spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "node_id long, agent_id string, at timestamp"), spark.createDataFrame([], "node_id long, until timestamp"), at(spark))
    assert writes.release_leases(leases, spark.createDataFrame([(1, "b")], "node_id long, agent_id string"))[0].count() == 1
    assert access.caller_clearance(spark.createDataFrame([("q",)], "agent_id string"), spark.createDataFrame([("q", 9)], "agent_id string, clearance_level int"), closed=True).first().clearance == 0


def test_texts(spark):
    row = spark.range(1).select(
        texts.accepted_span(F.lit(" none ")).alias("none"), texts.accepted_span(F.lit("x")).alias("x"), texts.prefix_query(F.lit("is it")).alias("q"), texts.search_words(F.lit("To be")).alias("w"),
        texts.retrieval_hit(F.lit(None).cast("string"), F.lit("Berlin"), F.array().cast("array<string>")).alias("hit")).first()
    assert row.none is None and row.x == "x" and row.q is None and row.w == ["to be"] and row.hit == 0
    assert texts.common_run("a b c d".split(), "b x d a".split()) == 2 and texts.common_run([], ["a"]) == 0


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_consumer_log(spark, tmp_path):
    rows = [(1, "added", "{}"), (1, "acked", None), (2, "added", "{}"), (3, "added", "junk")]
    out = keyed.consumer_log(_stream(spark, f"file://{tmp_path}/in", rows, "entry_id long, kind string, body string"))
    with keyed.keyed_state(spark):
        query = out.writeStream.format("memory").queryName("log").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted((r.entry_id, r.action) for r in spark.table("log").collect()) == [(1, "deliver"), (1, "done"), (2, "deliver"), (3, "dropped")]


def test_session_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, 1), (t + dt.timedelta(minutes=30), 1), (t + dt.timedelta(hours=3), 1), (t + dt.timedelta(days=9), 2)]
    out = jobs.session_stream(_stream(spark, f"file://{tmp_path}/in", rows, "ts timestamp, user_id long"))
    query = out.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted((r.user_id, r.n) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2)]
