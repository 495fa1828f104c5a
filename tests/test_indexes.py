"""Indexes on disk: the same answers as scans, little read, little rewritten."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import retrieval
from loomspark.operators.folders import drop, scratch
from loomspark.operators.text_index import TextIndex, best_of_texts, question_terms
from loomspark.operators.vector_index import VectorIndex

VECTORS = "id long, agent_id string, clearance int, embedding array<double>"


def vectors(n, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, 8))
    x = centres[rng.integers(0, 10, n)] + spread * rng.standard_normal((n, 8))
    return [(i, f"t{i % 3}", i % 5, [float(v) for v in row]) for i, row in enumerate(x)]


def exact(rows, queries, k):
    def unit(x):
        x = np.array(x, float)
        return x / n if (n := np.sqrt((x * x).sum())) else x

    out = {}
    for q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(r[3])), 9), r[0]) for r in rows)[:k]
        out[q] = [i for _, i in scored]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture
def folder(spark):
    path = scratch(spark, "test-index")
    yield path
    drop(spark, path)


def files(path):
    local = path.removeprefix("file://")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, names in os.walk(f"{local}/vectors") for f in names if f.startswith("part-")}


def test_vector_index_is_exact_through_writes(spark, folder):
    rows = vectors(900, 4)
    rows[7] = (7, "t1", 0, [0.0] * 8)
    frame = spark.createDataFrame([*rows, (5000, "t0", 0, None)], VECTORS)
    index = VectorIndex.build(frame, folder, cells=12)
    queries = [(i, rows[i][3]) for i in range(0, 900, 60)] + [(-1, [0.0] * 8)]
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    assert answers(index.search(asked, 5, probe=1)) == exact(rows, queries, 5)
    allowed = [r for r in rows if r[1] == "t1" and r[2] <= 2]
    assert answers(index.search(asked, 7, (F.col("agent_id") == "t1") & (F.col("clearance") <= 2))) == exact(allowed, queries, 7)

    before = files(folder)
    moved = [(3, "t9", 0, rows[500][3]), (9000, "t9", 0, rows[500][3])]
    touched = index.upsert(spark.createDataFrame(moved, VECTORS))
    after = files(folder)
    assert 1 <= len(touched) <= 2
    assert {f for f, i in before.items() if after.get(f) != i} <= {f for f in before if any(f"/cell={c}/" in f for c in touched)}
    now = [r for r in rows if r[0] != 3] + moved
    assert answers(index.search(asked, 5)) == exact(now, queries, 5)
    index.delete(spark.createDataFrame([(9000,), (4,), (123456,)], "id long"))
    assert answers(VectorIndex(spark, folder).search(asked, 5)) == exact([r for r in now if r[0] not in (4, 9000)], queries, 5)
    index.delete(frame.select("id"))
    assert VectorIndex(spark, folder).vectors().count() == 0


def test_vector_search_reads_few_cells(spark, folder):
    index = VectorIndex.build(spark.createDataFrame(vectors(2000, 8, 0.05), VECTORS), folder, cells=10)
    asked = spark.createDataFrame([(1, vectors(2000, 8, 0.05)[17][3])], "query_id long, vector array<double>")
    assert index.search(asked, 3, probe=1).count() == 3
    visits = spark.createDataFrame([(1, vectors(1, 8)[0][3], [2])], "query_id long, vector array<double>, cells array<int>")
    scan = index._scan_block(visits, 3, None)
    assert "PartitionFilters: [isnotnull(cell" in scan._jdf.queryExecution().toString()
    bounds = index._bounds(asked, np.array([0.3] * 10)).first()
    assert sum(c.least <= 0.3 for c in bounds.cells) < 5


def test_empty_vector_index(spark, folder):
    index = VectorIndex.build(spark.createDataFrame([], VECTORS), folder)
    assert index.search(spark.createDataFrame([], "query_id long, vector array<double>"), 3).count() == 0


def docs_of(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "alphabet", "beta", "Beta2", "ÉTÉ", "été", "news", "newsletter", "x", "_y", "the", "theatre", "then", "𐐀lpha", "zz"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30))), "title " + rng.choice(vocabulary)) for i in range(200)] + [(200, None, None), (201, "", "-"), (202, "the " * 5000, None)]
    return spark.createDataFrame(rows, "id long, text string, label string")


@pytest.mark.parametrize("ranges", [1, 6, 64])
def test_text_index_gives_the_scores_of_a_scan(spark, folder, ranges):
    docs = docs_of(spark)
    index = TextIndex.build(docs, "id", [F.col("label"), F.col("text")], folder, ranges)
    for terms in (["alpha"], ["the", "news"], ["été", "x", "_"], ["nothing"], ["title", "zz", "b"]):
        want = {r.id: r.score for r in retrieval.fulltext(docs, "id", [F.col("label"), F.col("text")], terms).collect()}
        got = {r.key: r.score for r in index.search(terms).collect()}
        assert got == pytest.approx(want)
        for t in terms:
            ranges_read = {int(r[0]) for r in spark.read.parquet(f"{folder}/postings").where(F.startswith("term", F.lit(t))).select("range").distinct().collect()}
            assert ranges_read <= set(index.ranges_of(t))
    assert {r.term for r in index.words("the").collect()} == {"the", "theatre", "then"}
    many = spark.createDataFrame([(1, ["the", "news"]), (2, ["alpha"]), (3, []), (4, None), (5, ["the", "the"])], "query_id long, terms array<string>")
    got = {}
    for r in index.search_many(many).collect():
        got.setdefault(r.query_id, {})[r.key] = r.score
    assert set(got) == {1, 2, 5} and got[2] == pytest.approx({r.key: r.score for r in index.search(["alpha"]).collect()})
    assert got[1] == pytest.approx({r.key: r.score for r in index.search(["the", "news"]).collect()})
    top = index.top(many, 3).where("query_id = 1").orderBy("rank").collect()
    assert [r.key for r in top] == [k for k, _ in sorted(got[1].items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]]


def test_best_of_texts_gives_the_top_of_the_index_without_one(spark, folder, monkeypatch):
    docs, fields = docs_of(spark), [F.col("label"), F.col("text")]
    many = spark.createDataFrame([(1, ["the", "news"]), (2, ["alpha"]), (3, []), (4, None), (5, ["the", "the"]), (6, ["nothing"]), (7, ["Été", "x", "_", "a", "t"])], "query_id long, terms array<string>")
    want = {(r.query_id, r["rank"]): (r.key, r.score) for r in TextIndex.build(docs, "id", fields, folder, 6).top(many, 9).collect()}
    monkeypatch.setattr(TextIndex, "build", None)  # no index is made
    for size in (16_384, 2):
        monkeypatch.setattr("loomspark.operators.text_index.QUESTIONS", size)
        got = {(r.query_id, r["rank"]): (r.key, r.score) for r in best_of_texts(docs, "id", fields, many, 9).collect()}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1]) for x in want)
    assert best_of_texts(docs.limit(0), "id", fields, many, 9).count() == 0


def test_text_index_opens_only_the_ranges_of_a_prefix(spark, folder):
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    docs = spark.createDataFrame([(i, " ".join(words[i::7])) for i in range(7)], "id long, text string")
    index = TextIndex.build(docs, "id", F.col("text"), folder, 16)
    assert len(index.bounds) == 15 and len(index.ranges_of("ca")) <= 3
    plan = index._with_prefix("postings", ["ca"])._jdf.queryExecution().toString()
    assert "PushedFilters: [StringStartsWith(term,ca)]" in plan or "StringStartsWith(term,ca)" in plan
    assert "PartitionFilters: [range" in plan or "PartitionFilters: [isnotnull(range" in plan
    read = {r[0] for r in index._with_prefix("postings", ["ca"]).select("range").distinct().collect()}
    assert read <= set(index.ranges_of("ca"))


def test_empty_text_index_and_terms(spark, folder):
    index = TextIndex.build(docs_of(spark).limit(0), "id", F.col("text"), folder)
    assert index.search(["a"]).count() == 0 and index.search([]).count() == 0
    row = spark.createDataFrame([("The THE new, news? of it",), (None,)], "q string").select(question_terms(F.col("q")).alias("t")).collect()
    assert [r.t for r in row] == [["the", "new", "news"], []]
