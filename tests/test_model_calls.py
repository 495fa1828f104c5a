"""The cache of model calls, attempts with the error handed back, and the bootstrap as one aggregate."""

import math
import statistics
import time

import pytest
from pyspark.sql import functions as F

from loomspark.operators import analytics, model_calls
from loomspark.operators.folders import parts_of
from loomspark.operators.model_calls import CallCache


def test_nothing_is_asked_twice(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def lengths(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, "other"), (5, "")], "id long, t string").repartition(3)
    cache = CallCache.create(spark, str(tmp_path / "c"))
    got = {r.id: r.answer for r in cache.ask(rows, "t", "m", lengths).collect()}
    assert got == {1: [4.0], 2: [4.0], 3: None, 4: [5.0], 5: [0.0]} and calls.value == 3
    again = CallCache(spark, str(tmp_path / "c")).ask(rows.unionByName(rows.withColumn("t", F.lit("new one"))), "t", "m", lengths)
    assert again.count() == 10 and calls.value == 4  # only the new text
    cache.ask(rows, "t", "another model", lengths).count()
    assert calls.value == 7
    parts_of(spark, str(tmp_path / "c/answers")).where("model = 'm'").write.mode("append").partitionBy("part").parquet(str(tmp_path / "c/answers"))  # as by two runs at one time
    assert cache.ask(rows, "t", "m", lengths).count() == 5 and calls.value == 7


def test_a_failing_call_writes_nothing(spark, tmp_path):
    cache = CallCache.create(spark, str(tmp_path / "c"), "string")

    def broken(texts):
        raise OSError("service is down")

    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    with pytest.raises(Exception, match="service is down"):
        cache.ask(rows, "t", "m", broken)
    assert cache.answers("m").count() == 0
    assert sorted(r.answer for r in cache.ask(rows, "t", "m", lambda ts: [t.upper() for t in ts]).collect()) == ["A", "B"]


def test_only_failed_chunks_are_tried_again_and_told_why(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(texts, errors):
        calls.add(len(texts))
        if "raise" in texts:
            raise RuntimeError("no service")
        return [None if t == "silent" else "{}" if t == "good" or e == "not an object: [1]" else "[1]" if t == "learns" else "never" for t, e in zip(texts, errors, strict=True)]

    check = lambda a: F.when(~a.startswith("{"), F.concat(F.lit("not an object: "), a))
    chunks = spark.createDataFrame([(1, 0, "good"), (1, 1, "learns"), (1, 2, "stubborn"), (2, 0, "stubborn"), (2, 1, "silent")], "doc_id long, chunk_no int, text string").coalesce(1)
    done, aside = model_calls.attempted(chunks, call, check)
    assert sorted(map(tuple, done.collect())) == [
        (1, 0, "{}", 1, None), (1, 1, "{}", 2, None), (1, 2, None, 3, "not an object: never"), (2, 0, None, 3, "not an object: never"), (2, 1, None, 3, "no answer")]
    assert [r.doc_id for r in aside.collect()] == [2]
    assert calls.value == 5 + 4 + 3
    done, aside = model_calls.attempted(spark.createDataFrame([(1, 0, "raise")], chunks.schema), call, check, 2)
    assert [tuple(r) for r in done.collect()] == [(1, 0, None, 2, "RuntimeError: no service")] and aside.count() == 1
    assert model_calls.attempted(chunks.limit(0), call, check)[0].count() == 0


def test_bootstrap_brute_force(spark):
    import hashlib

    scores = [(a, t, float((t * 7 + len(a)) % 11)) for a in ("x", "yy") for t in range(40)] + [("x", 3, 100.0), ("z", 1, 5.0), ("z", None, None)]
    got = {r.arm: r for r in analytics.bootstrap(spark.createDataFrame(scores, "arm string, task long, score double").repartition(5), 300).collect()}
    for arm in ("x", "yy", "z"):
        tasks = {}
        for a, t, s in scores:
            if a == arm and s is not None:
                tasks.setdefault(t, []).append(s)
        m = {t: statistics.fmean(v) for t, v in tasks.items()}
        code = {t: int(hashlib.md5(str(t).encode()).hexdigest()[:8], 16) % analytics.PRIME for t in m}
        means = []
        for b in range(300):
            w = {t: sum(analytics.drawn(b, code[t], 7) >= c for c in analytics.COPIES) for t in m}
            if sum(w.values()):
                means.append(sum(w[t] * m[t] for t in m) / sum(w.values()))
        means.sort()
        assert got[arm].mean == pytest.approx(statistics.fmean(m.values()))
        assert got[arm].low == pytest.approx(means[int(0.025 * len(means))]) and got[arm].high == pytest.approx(means[int(0.975 * len(means))])


def test_draws_follow_the_law_and_the_interval_covers(spark):
    n = [sum(analytics.drawn(b, i, 7) >= c for c in analytics.COPIES) for b in range(200) for i in range(200)]
    share = [n.count(k) / len(n) for k in range(4)]
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.01)
    rows = spark.range(2000).select(F.lit("a").alias("arm"), F.col("id").alias("task"), (F.col("id") % 100).cast("double").alias("score"))
    began = time.perf_counter()
    r = analytics.bootstrap(rows, 10_000).first()
    half = 1.96 * statistics.pstdev(range(100)) / math.sqrt(2000)
    assert r.low == pytest.approx(49.5 - half, abs=0.15) and r.high == pytest.approx(49.5 + half, abs=0.15)
    assert time.perf_counter() - began < 60


def test_texts_stay_where_they_are_once_answers_are_held(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def lengths(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    made = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, "other"), (5, "")], "id long, t string")
    made.write.parquet(str(tmp_path / "rows"))
    cache = CallCache.create(spark, str(tmp_path / "c"))
    first = cache.ask(spark.read.parquet(str(tmp_path / "rows")), "t", "m", lengths, "one", "call_key")
    out = cache.ask(first, "t", "m", lengths, "two", "call_key").select("id", "one", "two")
    assert sorted(map(tuple, out.collect())) == [(1, [4.0], [4.0]), (2, [4.0], [4.0]), (3, None, None), (4, [5.0], [5.0]), (5, [0.0], [0.0])] and calls.value == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2") == 1  # one key by text, and it is joined without the text
    assert plan.index("sha2") > plan.rindex("Join LeftOuter")
