"""Importance resampling, prefix trie and exact top-k against brute force, on odd rows and in small blocks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import prefix_trie, resampling, topk


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 11 importance resampling
def grams_of(text, orders):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, orders, buckets, percent, least_words):
    def placed(text):
        n, grams = grams_of(text, orders)
        return n, [zlib.crc32(g.encode()) % buckets for g in grams]

    rows = [(k, *placed(t)) for k, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in placed(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for k, n, places in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in places) // len(places) if places else 0
        h = int(hashlib.sha256(f"2024:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, n, len(places), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return out, [r[4] for r in able[: int(percent * len(able) // 100)]]


@pytest.mark.parametrize(("orders", "block"), [(1, 1 << 16), (2, 7), (3, 2)])
def test_resampling_brute_force(spark, orders, block):
    rng = random.Random(orders)
    vocabulary = "Alpha beta-gamma ΔELTA été eps9 x1 zeta _ é".split()
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, " .. "), (63, "...one two. "), docs[3], docs[3], (None, docs[4][1]), (None, docs[5][1]), (65, "alpha " * 3000), (66, "\x00a\x7fb")]
    target = ["alpha eps9 été", None, "", "Zeta zeta x1 beta"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("_doc", "_th", "_row", "_gram", "_pos", "rank", "_bucket", "times", "score")}).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, goal, orders, buckets=97, percent=30, least_words=5, block=block).collect()
    want, scores = drawn(docs, target, orders, 97, 30, 5)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(scores) + 1)) and [r.score for r in ranked] == scores
    assert all(r.n_words >= 5 for r in ranked)
    ties = [(-r.score, -1 if r.doc_id is None else r.doc_id) for r in ranked]
    assert ties == sorted(ties)


def test_resampling_without_rows_and_with_many_copies(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d")] * 50 + [(2, "a b x y")], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0 and resampling.resample(some, none).count() == 51
    monkeypatch.setattr(resampling, "COPIES", 8)
    got = resampling.resample(some, some, percent=50, least_words=4).collect()
    assert len(got) == 51 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 26))
    with pytest.raises(ValueError):
        resampling.resample(some, some, buckets=0)


# 12 prefix trie
def rebuilt(rows, every=20, most=4):
    own = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        out[c] = turns.get(c - int(math.fmod(c, every)), [])[:h] + turns[c][h:]
    return turns, out


def trie_of(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids, out = Counter(p[:-1] for p in members if p), []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below),
            sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(out)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(12)
    rows = []
    for c in list(range(50)) + [100, 101, 102, 205, -7, 1 << 40]:
        stem = rng.randrange(3)
        for turn in range(rng.choice((1, 1, 2, 3, 5, 9))):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"say {stem} now" if turn < 2 + stem else f"word {rng.randrange(2)}  x"))
    rows += [(300 + i, t, "user", f"same {t}") for i in range(12) for t in range(40)]  # long ones, alike
    rows += [(320, t, "user", f"same {t}" if t != 25 else "other") for t in range(45)]
    rows += [(330, None, "user", "first"), (330, 0, None, None), (330, 0, "user", "tie"), (330, 0, "assistant", "tie"), (331, 1, "", ""), (None, 0, "user", "no id"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_trie_brute_force(spark, talks, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    names = ("conv", "at", "depth", "digest", "start", "n", "h", "k", "words", "block")
    frame = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(7) for c in names}).repartition(3)
    plain, forks = rebuilt(talks)
    ordered = prefix_trie.ordered(frame)
    assert trie_of(forks) == Counter(tuple(r) for r in prefix_trie.trie(*prefix_trie.forked(*ordered), block).drop("digest").collect())
    assert trie_of(plain) == Counter(tuple(r) for r in prefix_trie.trie(*prefix_trie.as_they_are(*ordered), block).drop("digest").collect())


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = prefix_trie.ordered(spark.createDataFrame([], schema))
    assert prefix_trie.trie(*prefix_trie.forked(*empty)).count() == 0
    lone = [(c, 0, "user", "hi") for c in range(21, 40)]  # their host is absent, so those with h > 0 have no turns
    got = prefix_trie.trie(*prefix_trie.forked(*prefix_trie.ordered(spark.createDataFrame(lone, schema)))).drop("digest").collect()
    assert Counter(tuple(r) for r in got) == trie_of(rebuilt(lone)[1])


# 13 exact top-k
def best(rows, every, k):
    ints = {i: [math.floor(256.0 * x) for x in v] for i, v in rows}
    out = []
    for q in ints:
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return Counter(out)


def near(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    x = centres[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, dims))
    return x * rng.uniform(0.2, 2, (n, 1))


@pytest.mark.parametrize(("spread", "bucket"), [(0.1, 64), (3.0, 100), (0.1, 4096)])
def test_topk_brute_force(spark, monkeypatch, spread, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "GROW", 2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near(700, 12, 5, spread))]
    rows[10:40] = [(i, rows[500][1]) for i in range(10, 40)]  # ties
    rows[20] = (20, [0.0] * 12)
    bad = [(1000, None), (1040, [float("nan")] + [0.0] * 11), (1060, [None] + [0.0] * 11), (1080, [float("inf")] * 12), (1100, [1.0] * 3), (None, [1.0] * 12), (60, rows[60][1])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("id", "v", "norm", "bucket", "q", "rank", "asks", "salt")})
    got = topk.search(frame, F.col("vec_id") % 20 == 0, 5).collect()
    assert Counter(tuple(r) for r in got) == best(rows, 20, 5)


def test_few_steps_of_lengths_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "STEPS", 2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near(600, 8, 9, 0.5))]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert Counter(tuple(r) for r in got) == best(rows, 50, 5)


def test_coordinates_prune_and_lose_nothing():
    vectors = np.floor(256 * near(2000, 16, 3, 0.05))
    norms = np.sort(np.sqrt((vectors * vectors).sum(1)))[::-1]
    vectors = vectors[np.argsort(-np.sqrt((vectors * vectors).sum(1)), kind="stable")]
    units = vectors / norms[:, None]
    by_axis = np.argsort(units, axis=0, kind="stable")
    kept = 0
    for q in vectors[::50]:
        scores = vectors @ q
        bound = float(np.sort(scores)[-5])
        rows = topk._at_least(q, float(np.sqrt(q @ q)), bound, vectors, norms, by_axis, np.take_along_axis(units, by_axis, 0), units)
        assert set(np.flatnonzero(scores >= bound)) <= set(rows)
        kept += len(rows)
    assert kept < 0.5 * 2000 * 40


def test_topk_of_few_and_of_large_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    assert topk.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    few = topk.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [-1.0, 0.2])], schema), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, few)) == [(0, 1, 1, 256 * 128), (0, 2, 50, -256 * 256), (50, 1, 1, -256 * 128 + 51 * 128), (50, 2, 0, -256 * 256)]
    rows = [(0, [3e6 + 1 / 256, 1.0]), (1, [3e6 + 1 / 256, 3.0]), (2, [3e6 + 1 / 256, 2.0]), (3, [1e300, 0.0]), (4, [-1e300, 0.0])]
    got = topk.search(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()
    a = 256 * 3_000_000 + 1
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 2**63 - 1), (1, a * a + 256 * 768), (2, a * a + 256 * 512), (4, -(2**63))]
