"""The operators for training data against SQL, brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import blind_pages
import corpus_pipeline
import held_out_pages
from loomspark.llm import bpe, chat, fingerprints, html_text, jaccard, language, links, mixing, neighbours, registry, sharding, suffixes
from loomspark.llm._words import shingle_set, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = "/opt/tokenizers/word_bpe_49k.json"


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names operators might use."""
    rng = random.Random(3)
    base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(400)]
    long = " ".join(base * 40)
    edited = base[:]
    edited[200] = "other"
    texts = [
        None, "", "  \n", "one", "One two three four", " ".join(base), " ".join(base), " ".join(edited), " ".join(base[:120]), "x " + " ".join(base[30:110]) + " y",
        long, "a b c d e f", "A B C D E F", "w" * 400_000, "tail " * 300, None, " ".join(base),
    ]
    rows = [(i, t, ("en", None, "de")[i % 3], (None, "s", "t", "")[i % 4], 0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[3], (None, "a null key", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("_key", "size", "shard", "_h", "rep", "n", "spans", "_text", "_bad", "_gone", "_again", "_had", "_node", "_row", "doc", "th", "_same", "_doc")})


@pytest.fixture(scope="module")
def plain(odd):
    return [(r.doc_id, r.text, r.source) for r in odd.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(check_query, name):
    check_query(name, registry.queries()[name], registry.oracle_sql()[name])


# 1 mixing
def test_mix_on_odd_rows(odd, plain, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == len(plain) and mixing.mix(empty).count() == 0
    by = {}
    for r in got:
        assert r["size"] == len(words(next(t for k, t, _ in plain if k == r.doc_id))) and 0 <= r.copies <= 3
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows) * 2 and rows[0].target <= 3 * rows[0].source_size + 1e-6
    assert sum(r[0].target for r in by.values()) == pytest.approx(sum(r["size"] for r in got))
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in mixing.mix(odd.repartition(5)).collect())


def test_mix_refines_the_boundary(spark, monkeypatch):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("source"))
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "FEW", 1)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    assert {r.doc_id: r.copies for r in mixing.mix(docs).collect()} == want
    rows = mixing.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {k: v for k, v in want.items() if v}


def test_mix_without_broadcast(spark, odd, monkeypatch):
    want = sorted(map(str, mixing.mix(odd).collect()))
    from loomspark.llm import _shared

    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", -1)
    assert sorted(map(str, mixing.mix(odd).collect())) == want


# 2 language
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").withColumn("said", F.lit(None).cast("string"))
    got = language.identify(held, model, "doc_id", "text", F.col("said"), F.col("source"), F.lit(None)).join(held, "doc_id")
    assert got.where("language = lang and kept").count() >= 0.98 * held.count()


def test_declarations_decide_only_without_text(spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(i, "the and of in that with for are this", "en", "h") for i in range(40)] + [(100, "der die und nicht eine sich auch", "en", "h"), (101, None, "en", "h"), (102, "12 34", "en", "h")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, d string, host string"), model, "doc_id", "text", F.col("d"), F.col("host"), F.lit("com")).collect()}
    assert got[100].language == "de" and got[1].language == "en" and got[101].language == "en" and not got[101].kept and not got[102].kept and got[1].kept


def test_rare_languages_are_known(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAINING_ROWS", 20)
    monkeypatch.setattr(language, "LANGUAGE_ROWS", 5, raising=False)
    monkeypatch.setattr(language, "TRAINING_CHARS", 400)
    rng = random.Random(4)
    said = {"en": "the and of in that with for are this was".split(), "de": "der die und nicht eine sich auch werden".split(), "fi": "joka kuin olla mutta niin sitten kaikki".split(), "pl": "jest nie tylko przez bardzo wszystko jako".split()}
    text = lambda lang, n=30: " ".join(rng.choice(said[lang]) for _ in range(n))
    same = text("pl")
    rows = [text("en") for _ in range(900)], [text("de") for _ in range(60)], [text("fi", 200) for _ in range(6)], [same] * 40
    rows = [(t, lang) for lang, texts in zip(("en", "de", "fi", "pl"), rows, strict=True) for t in texts]
    docs = spark.createDataFrame([(i if lang != "pl" else None, t, lang, "s", len(t)) for i, (t, lang) in enumerate(rows)], DOCS)
    langs, table = language.fit(docs)
    assert langs == ["de", "en", "fi", "pl"] and np.allclose(np.exp(table).sum(0), 1)
    got = language.identify_documents(docs).groupBy("language").count().collect()
    assert dict(got) == Counter(lang for _, lang in rows)


def test_unknown_languages_and_junk_are_rejected(spark):
    import base64

    rng = random.Random(6)
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    junk = [
        "Все люди рождаются свободными и равными в своём достоинстве и правах.", "Привет, как дела", "人人生而自由，在尊严和权利上一律平等。", "すべての人間は、生まれながらにして自由である", "😀😀 🎉🎉",
        base64.b64encode(rng.randbytes(150)).decode(), base64.b64encode(rng.randbytes(3000)).decode(), "asdfjkl qwrtzp xcvbnm dfghjk wqxz sdfkj", "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(60)),
    ]
    clean = ["the and of in that", "The other ones are there and", "der die und nicht eine", "la de los y que las", "les des et la que", "and"]
    rows = [(i, t, None, "h") for i, t in enumerate(junk + clean)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, d string, host string"), model, "doc_id", "text", F.col("d"), F.col("host"), F.lit("com")).collect()}
    assert [got[i].kept for i in range(len(rows))] == [False] * len(junk) + [True] * len(clean)
    assert all(got[i].confidence < 0.5 and got[i].language is not None for i in range(len(junk)))


def brute_identify(rows, model, least=0.5):
    """key, language, confidence, kept of rows (key, text, declared, host, suffix), row by row with floats."""
    import math

    langs, table = model
    sums, sizes = language.likelihoods([t or "" for _, t, *_ in rows], table)
    posts, others = [], []
    for ll, n in zip(sums, sizes, strict=True):
        other = math.log(language.UNKNOWN) - math.log(language.CELLS) * min(n, language.EVIDENCE) if n else -math.inf
        top = max(max(ll), other)
        total = sum(math.exp(x - top) for x in [*ll, other])
        posts.append([math.exp(x - top) / total if n else 0.0 for x in ll])
        others.append(other)
    whole = np.sum(posts, axis=0)
    wide = (whole + 1) / (whole.sum() + len(langs))
    by = [{}, {}, {}]
    for row, p in zip(rows, posts, strict=True):
        for sums_by, v in zip(by, row[2:], strict=True):
            sums_by[v] = sums_by.get(v, 0) + np.array(p)
    out = []
    for row, p, ll, n, other in zip(rows, posts, sums, sizes, others, strict=True):
        p = np.array(p)
        d, h, x = (sums_by[v] - p for sums_by, v in zip(by, row[2:], strict=True))
        by_suffix = (np.maximum(x, 0) + language.STRENGTH * wide) / (max(x.sum(), 0) + language.STRENGTH)
        by_host = (np.maximum(h, 0) + language.STRENGTH * by_suffix) / (max(h.sum(), 0) + language.STRENGTH)
        score = (ll if n else 0) + np.log(by_host) + np.log((np.maximum(d, 0) + 1) / (whole - p + 2))
        best, ref = score.max(), max(score.max(), other)
        sure = math.exp(best - ref) / (np.exp(score - ref).sum() + math.exp(other - ref))
        out.append((row[0], langs[int(score.argmax())], sure, bool(n and sure >= least)))
    return out


def test_fusion_brute_force(spark, odd):
    from urllib.parse import urlparse

    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    tree = html_text.grow(html_text.labelled_table())
    pages = [(r.page_id, html_text.main_text(r.html, tree), (re.search(r"<html[^>]*\slang=\"?([a-z]+)", r.html) or ["", ""])[1], urlparse(r.url).hostname) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = brute_identify([(k, t, d, h, h.rsplit(".", 1)[-1]) for k, t, d, h in pages], model)
    got = {r.page_id: r for r in language.page_languages(spark, SF).collect()}
    assert len(got) == len(want) and len({h for *_, h in pages}) > 1
    rows = [(r.doc_id, r.text, (r.lang or "").lower(), (r.source or "").lower(), "") for r in docs.collect()]
    rest = brute_identify(rows, model)
    for found, brute in ((got, want), ({r.doc_id: r for r in language.identify_documents(docs).collect()}, rest)):
        for k, lang, sure, kept in brute:
            assert (found[k].language, found[k].kept) == (lang, kept) and found[k].confidence == pytest.approx(sure, abs=2e-6)


def test_language_on_odd_rows(odd, plain, empty):
    assert language.identify_documents(odd).count() == len(plain) and language.identify_documents(empty).count() == 0
    kept = language.accept(odd, language.identify_documents(odd))
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0


# 3 chat
def python_digest(rows):
    rows = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "", r[2] or ""))
    turns = "".join(f"{r[1] or ''}\n{r[2] or ''}\n" for r in rows)
    return len(rows), turns, "".join(r[2] or "" for r in rows if r[1] == "assistant")


def test_chat_round_trip_with_blocks(spark):
    rng = random.Random(5)
    rows = []
    for conv in (1, 2, None):
        for turn in range(70 if conv == 1 else 9):
            rows.append((conv, turn, ("system" if turn == 0 else ("user", "assistant", "a<b>\\")[turn % 3]), rng.choice(["", None, r"\l <turn x> </turn>", "é" * 700, "plain words here", r"\\b\g"])))
    rows += [rows[3], rows[4], (2, None, None, None), (3, 5_000_000, "user", "far"), (3, 0, "assistant", "near")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("window", F.lit(1))
    want = {c: python_digest([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    for block in (1024, 16):
        windows = chat.format_windows(df, stride=60, history_tokens=40, block_turns=block)
        got = {r.conv_id: (r.n_turns, r.turns, r.loss) for r in chat.read_back(windows).collect()}
        assert got == want
        first = windows.where("conv_id = 1").orderBy("block", "window").collect()
        assert len(first) > 5 and all(w.text.startswith("<past system>") for w in first[1:]) and all("<past " in w.text for w in first[1:])
    assert chat.format_windows(df.limit(0)).count() == 0


# 4 sharding
def test_shards_on_odd_rows(odd, plain, empty, spark):
    got = sharding.assign(odd, 5).collect()
    assert len(got) == len(plain) and sharding.assign(empty, 5).count() == 0
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, _ in plain)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.assign(docs, 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and (abs(sizes - sizes.mean()) <= got["size"].max()).all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    copies = got.groupby("text_crc32").agg({"size": "sum", "shard": "nunique"})
    assert (copies[copies["size"] < 0.05 * sizes.mean()]["shard"] == 1).all()


def test_shards_brute_force(spark):
    import xxhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10_000 + i, docs[3][1]) for i in range(9)] + [(20_000, None), (20_001, "")]
    shards = 7
    rows = sorted((int.from_bytes(xxhash.xxh64(((t or "").encode()), seed=42).digest(), "big", signed=True), k, len((t or "").encode()) + 16) for k, t in docs)
    total, at, own = sum(n for *_, n in rows), 0, []
    place = lambda twice: min(twice * shards // (2 * total), shards - 1)
    for g, k, n in rows:
        own.append([g, k, place(2 * at + n), at, n])
        at += n
    groups = {}
    for g, k, shard, start, n in own:
        groups.setdefault(g, []).append((shard, start, n))
    whole = {g: place(2 * x[0][1] + sum(n for *_, n in x)) for g, x in groups.items() if x[0][0] < x[-1][0] and sum(n for *_, n in x) <= 0.05 * total / shards}
    want, seen = {}, Counter()
    for g, k, shard, *_ in own:
        shard = whole.get(g, shard)
        want[k] = (shard, seen[shard])
        seen[shard] += 1
    got = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), shards).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want


def test_written_shards_hold_all_rows(spark, odd, tmp_path):
    sharding.write_shards(odd, f"file://{tmp_path}/s", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == odd.count() and set(back.columns) == set(odd.columns) | {"_shard"} and back.where("shard <> 7 or _same <> 7").count() == 0


# 5 fingerprints
def test_fingerprints_brute_force(odd, plain, empty, spark):
    got = fingerprints.compare_with_edits(odd).collect()
    ordered = sorted(plain, key=lambda r: (0 if r[0] is None else 1, r[0] or 0), reverse=True)
    ordered = sorted(((k, t or "") for k, t, _ in ordered), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for i, (k, t) in enumerate(ordered):
        after, half = ordered[(i + 1) % len(ordered)][1], len(t) // 2
        want[(k, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert fingerprints.compare_with_edits(empty).count() == 0
    one = fingerprints.compare_with_edits(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def brute_anchors(text, k, s):
    points = np.array([ord(c) for c in text], np.uint64)
    if len(points) < k:
        return []
    inner, outer = fingerprints.mix(fingerprints.stretches(points, s)), fingerprints.mix(fingerprints.stretches(points, k)) >> np.uint64(32)
    w = k - s + 1
    return [int(outer[i]) for i in range(len(points) - k + 1) if min(x := inner[i : i + w]) in (x[0], x[-1])]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for i, y in enumerate(b, 1):
            corner, row[i] = row[i], corner + 1 if x == y else max(row[i], row[i - 1])
    return row[-1]


def test_likeness_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(rng.choice((3, 8, 20, 60, 200)))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        after, half = texts[i - 1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        for name, (a, b) in {"near_edited": (t, edited), "near_next": (t, after)}.items():
            k, s = (fingerprints.FINE_K, fingerprints.FINE_S) if max(len(a), len(b)) < fingerprints.SHORT else (fingerprints.K, fingerprints.S)
            x, y = brute_anchors(a, k, s), brute_anchors(b, k, s)
            most = 2 * longest_common(x, y) / (len(x) + len(y))
            assert got[i][name] <= most + 1e-9
            if len(set(x)) == len(x) and len(set(y)) == len(y):
                assert got[i][name] == pytest.approx(most)
        coarse, fine = fingerprints.from_text(got[i].fingerprint)
        assert coarse.tolist() == brute_anchors(t, fingerprints.K, fingerprints.S) or len(t) < 2 * fingerprints.K
        assert (fine is None) == (len(t) >= fingerprints.SHORT) and (fine is None or fine.tolist() == brute_anchors(t, 6, 2) or len(t) < 12)
        if len(t) >= 20 and len(after) >= half:
            assert got[i].near_edited > 0.2


def test_syncmers_are_context_free():
    rng = random.Random(1)
    middle = "".join(rng.choice("abcdefgh ") for _ in range(500))
    extra = "".join(rng.choice("abcdefgh ") for _ in range(90))
    a, b, m = fingerprints.anchors([extra + middle, middle + extra, middle])
    assert set(m.tolist()) <= set(a.tolist()) & set(b.tolist()) and fingerprints.likeness((m, None), (m, None)) == 1
    assert fingerprints.likeness((a, None), (b, None)) > 0.7 and m.tolist() == brute_anchors(middle, fingerprints.K, fingerprints.S)
    runs = fingerprints.fingerprints(["x" * 200, "x" * 100_000, "ab " * 100, "ab " * 10_000])
    assert len(runs[1][0]) < 20 and 0.3 < fingerprints.likeness(*runs[:2]) < 0.9 and fingerprints.likeness(*runs[2:]) < 0.1
    assert fingerprints.likeness(*fingerprints.fingerprints(["one text", "zwölf Boxkämpfer"])) == 0


@pytest.mark.parametrize("size", [1, 7, 200])
def test_neighbours_in_any_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", size)
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, -(1 << 63), (1 << 63) - 1, 9]), "t" * rng.randrange(30)) for _ in range(60)]
    got = fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((k, len(t)) for k, t in rows)


# 6 suffixes
def brute_spans(rows, window=50):
    seen, marks, texts = {}, {}, sorted({(k, tuple(words(t))) for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, ws in texts:
        for i in range(len(ws) - window + 1):
            seen.setdefault(ws[i : i + window], []).append((k, ws, i))
    for places in seen.values():
        if len(places) > 1:
            for j, (k, ws, i) in enumerate(places):
                marks.setdefault((k, ws, j == 0), []).append(i)
    out = Counter()
    for (k, _, kept), starts in marks.items():
        begin = last = None
        for i in [*sorted(starts), None]:
            if begin is not None and (i is None or i - last > window):
                out[(k, begin, last + window, kept)] += 1
                begin = None
            if i is not None:
                begin, last = i if begin is None else begin, i
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_spans_brute_force(odd, plain, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = Counter((r.doc_id, r.start, r.end, r.kept) for r in suffixes.repeated_spans(odd).collect())
    assert got == brute_spans([(k, t) for k, t, _ in plain]) and got
    assert suffixes.repeated_spans(empty).count() == 0


def test_cut_leaves_no_repeats(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(9999)}" for _ in range(60))
    rows = [(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(80)) + f" \n{passage}\t" + " ".join(f"r{rng.randrange(10**6)}" for _ in range(30)), "en", None, 0) for i in range(6)] + [(9, None, "en", "s", 0), (10, "short", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.text for r in suffixes.cut_repeats(docs).collect()}
    assert got[0] == rows[0][1] and got[9] is None and got[10] == "short"
    for i in range(1, 6):
        assert got[i] == rows[i][1].replace(passage + "\t", "")
    assert suffixes.cut_repeats(docs).columns == docs.columns


# 7 BPE
def test_bpe_equals_the_library(odd, plain):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCAB)
    own = bpe.WordBpe(VOCAB)
    rng = random.Random(4)
    pool = ["a", "é", "e\u0301", "'S", "'ll", " ", "\n", "\x1c", "ΣΑΣ", "İ", "ß", "中文", "½", "7", "<|endoftext|>", "<|startoftext|>", "<|", "😀", "!?", "ing", "\u200b", "\xa0", "z" * 300]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = bpe.encode_texts(odd.where("length(text) < 100000 or text is null"), VOCAB, ids=True)
    for r in got.collect():
        t = next(t for k, t, _ in plain if k == r.doc_id)
        assert list(r.ids) == lib.encode(t or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert {r.doc_id: r.text for r in bpe.decode_ids(got, VOCAB).collect()}[3] == "one</w>"


def test_short_and_long_words_agree(monkeypatch):
    own = bpe.WordBpe(VOCAB)
    rng = random.Random(6)
    for n in (1, 2, 17, 300, 2000):
        word = "".join(rng.choice("abthein") for _ in range(n))
        monkeypatch.setattr(bpe, "LONG", 10**9)
        short = own.word(word)
        monkeypatch.setattr(bpe, "LONG", 0)
        assert own.word(word) == short


# 8 Jaccard
def brute_components(rows):
    sets, up = {}, {}
    for i, (_, t) in enumerate(rows):
        ws = words(t)
        sets[i] = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
        up[i] = i

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), (10**9,)), (-1 if k is None else k,))
    return Counter((k, len(sets[i]), None if least[top(i)][0] < 0 else least[top(i)][0]) for i, (k, _) in enumerate(rows))


def near_copies(n=140, size=90, seed=8):
    rng = random.Random(seed)
    rows = []
    bases = [[f"w{rng.randrange(400)}" for _ in range(size)] for _ in range(6)]
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.randrange(8)):
            ws[rng.randrange(size)] = f"e{rng.randrange(50)}"
        rows.append((i * 3 + 1, " ".join(ws)))
    return rows


@pytest.mark.parametrize("size", [256, 4])
def test_components_brute_force(spark, odd, plain, empty, monkeypatch, size):
    monkeypatch.setattr(jaccard, "GROUP", size)
    monkeypatch.setattr(jaccard, "QUERIES", size // 2)
    monkeypatch.setattr(jaccard, "OFTEN", 1)
    rows = near_copies()
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    got = jaccard.similar(odd).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(k, t) for k, t, _ in plain])
    if size == 4:
        assert jaccard.similar(empty).count() == 0


def test_matrix_finds_links_without_bands(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "bands", lambda s: [])
    rows = near_copies(70, seed=9)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_hot_tokens_are_met_by_pairs(spark, monkeypatch):
    rng = random.Random(13)
    head = "one shared run of words"
    rows = [(i, head + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(7))) for i in range(400)]
    for i in range(0, 60, 2):  # links whose only common first token may be the shared one
        rows.append((1000 + i, rows[i][1] + f" y{i}"))
        rows.append((1001 + i, rows[i][1].replace(head, head + " " + head)))
    (shared,) = shingle_set(next(iter(word_hashes([head]))), 5)
    table = np.full(jaccard.CELLS, 9, np.uint8)
    table[int(shared >> np.uint64(64 - 21))] = 0  # the shared token comes first in every set
    monkeypatch.setattr(jaccard, "_frequency_table", lambda features: table)
    monkeypatch.setattr(jaccard, "bands", lambda s: [])
    monkeypatch.setattr(jaccard, "FLUSH_PAIRS", 50)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for hot in (20, 10**6):
        monkeypatch.setattr(jaccard, "HOT", hot)
        got = jaccard.similar(df).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(k != c for k, _, c in want) >= 30


def test_null_keys_are_documents_of_their_own(spark):
    base = near_copies(3, 60, 14)
    rows = [(None, base[0][1]), (None, base[0][1]), (None, "five plain words stand here"), (4, base[0][1] + " end"), (6, "nothing like it"), (7, "text one of this key now"), (7, "quite another text it has"), (8, "quite another text it has")]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(None, None): 3, (4, None): 1, (6, 6): 1, (7, 7): 2, (8, 7): 1})


def test_one_text_many_times(spark):
    text = " ".join(f"w{i}" for i in range(30))
    copies = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(text)).otherwise(F.concat(F.lit(text), F.lit(" x y"))).alias("text"))
    got = jaccard.similar(copies)
    assert got.count() == 3000 and [tuple(r) for r in got.select("component_id").distinct().collect()] == [(None,)]
    spans = suffixes.repeated_spans(copies.where("doc_id is null"), window=20, k=8)
    got = sorted((r.start, r.end) for r in spans.where("kept").collect())  # by which of the two texts comes first
    assert got in ([(0, 32)], [(0, 30), (11, 32)])


def test_two_texts_of_one_key(spark):
    a, b = near_copies(2, 60, 10)[0][1], " ".join(f"z{i}" for i in range(60))
    rows = [(5, a), (5, b), (9, b), (7, a), (8, "alone")]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (9, 5), (7, 5), (8, 8)}


def test_both_ways_of_joining_links(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    df = spark.createDataFrame(pairs, "u long, v long")
    few, stars = ({(r.node, r.label) for r in links.components(df, n).collect()} for n in (10**6, 0))
    assert few == stars and (1200, 1000) in few


def test_word_hashes():
    texts = ["", "a b\x0bC  é\n", "x \0 y", "A B\nc É", "q" * 300_000 + " b", "b"]
    got = list(word_hashes(texts))
    assert [len(g) for g in got] == [0, 4, 3, 4, 2, 1] and (got[1][:3] == got[3][:3]).all() and got[4][1] == got[5][0]
    assert len(shingle_set(got[1], 5)) == 1 and len(shingle_set(got[0], 5)) == 0


# 9 neighbours
def brute_nearest(rows, k):
    use = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in sorted(use):
        if q % 20 == 0:
            out[q] = [i for _, i in sorted((-float((use[q] * use[i]).sum()), i) for i in use if i != q)[:k]]
    return out


def test_walk_finds_all_boxes_in_reach():
    rng = np.random.default_rng(5)
    points = rng.standard_normal((400, 8))
    tree = neighbours.cut_tree(points, 32)
    at = neighbours.leaf_of(tree, points)
    low, high = ({int(b): f(points[at == b], 0) for b in np.unique(at) if b != 3} for f in (np.min, np.max))
    queries, reach = rng.standard_normal((50, 8)), rng.uniform(0, 6, 50)
    got = {(int(q), b) for rows, b in neighbours.visits(neighbours.hulls(tree, low, high), queries, reach) for q in rows}
    assert got == {(q, b) for b in low for q in range(50) if (np.maximum(0, np.maximum(low[b] - queries[q], queries[q] - high[b])) ** 2).sum() < reach[q]}
    assert neighbours.visits(neighbours.hulls([0], {}, {}), queries, reach) == []


def test_neighbours_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    vectors[300:900] = vectors[300]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2020, [0.0] * 16), (2040, [1.0] * 15 + [None]), (2060, [float("nan")] * 16), (None, [1.0] * 16), (2080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(got[r.query_id]) and r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), rel=1e-12, abs=1e-12)
    want = brute_nearest(rows, 20)
    assert set(got) == set(want) and np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    assert got[300] == want[300]
    few = neighbours.search(df.where("vec_id in (0, 7, 8)"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2 and neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 10 HTML
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top <a href=x>Home</a></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice"><p>We use cookies and want you to read all of this long sentence.</p></div>
<article class="post"><h1>Head &amp; line</h1><p>First <b>bold</b>word<br>next&nbsp;line.<p>Short.</p><aside>Related stories</aside><ul><li>point one</li><li>point two</li></ul>
<script>if (a < b) x("</p>");</script><!-- <p>no</p> --><form>Mail <input><button>Go</button></form><section id="comments"><p>I think that this is a very long comment about the article above.</p></section></article>
<div class="sidebar">Side</div><footer>&copy; 2024</footer><p"""


def test_main_text():
    tree = html_text.grow(html_text.labelled_table())
    assert html_text.main_text(PAGE, tree) == "Head & line\n\nFirst boldword next line.\n\nShort.\n\npoint one\n\npoint two"
    assert html_text.main_text("", tree) == ""
    for name in ("alert-free story", "social-quote", "post", "has-sidebar"):
        assert html_text.main_text(f'<nav><a href=x>A</a></nav><article><p class="{name}">Some plain words.</p></article>', tree) == "Some plain words."
    for name in ("cookie-notice", "ad", "site-footer", "CommentList", "share links"):
        assert html_text.main_text(f'<article><p>Some plain words.</p><div class="{name}">Other words</div></article>', tree) == "Some plain words."


def test_tree_is_bounded_and_reads_the_neighbours():
    table = html_text.labelled_table()
    tree = html_text.grow(table)
    used = set()

    def depth(node):
        if isinstance(node, bool):
            return 0
        used.add(html_text.FEATURES[node.feature])
        return 1 + max(depth(node.low), depth(node.high))

    assert depth(tree) <= 8 and {"density behind", "words behind", "words before", "home", "box", "astray", "talk"} <= used
    assert sum(html_text.decide(tree, r) == bool(r[-1]) for r in table) >= 0.97 * len(table)
    assert html_text.labelled_table() == table
    assert html_text.grow([(1.0, 1.0), (2.0, 1.0)]) is True and html_text.grow([(1.0, 0.0)] * 5) is False


@pytest.mark.parametrize("pages", [held_out_pages.pages, blind_pages.pages])
def test_held_out_pages(pages):
    import re

    tree = html_text.grow(html_text.labelled_table())
    n = 0
    for name, html in pages():
        n += 1
        assert re.findall(r"\b[ko]\d+", html_text.main_text(html, tree)) == re.findall(r"\bk\d+", html), name
    assert n >= 30


def test_no_paragraph_is_lost_and_no_menu_kept_at_any_size():
    tree = html_text.grow(html_text.labelled_table())
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    for n in range(1, 90):
        assert html_text.main_text(f"<nav><a href=x>A</a></nav><article><p>{text(n)}.</p></article>", tree) == text(n) + ".", n
    for box in ("<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div>{}</div>"):
        for n in (13, 20, 30, 45, 80, 150):
            for m in (2, 4, 9):
                inner = f"<p>{text(n)}.</p><p>Read more: <a href=x>{text(m)}</a></p><p>{text(n)}.</p>"
                assert html_text.main_text(box.format(inner), tree).split("\n\n") == [text(n) + ".", f"Read more: {text(m)}", text(n) + "."], (box, n, m)


def test_pages_and_odd_rows(spark):
    import html as H
    import re

    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet"), keep=("page_id", "url", "html")).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (5, "u", "<nav>A</nav>"), (2, "u", "<p>" + "long text " * 200_000), (3, "u", "<" * 1000), (4, "u", '<a b="' * 300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = html_text.extract(df).collect()
    assert len(got) == 7 and sum(r.n_chars == 0 for r in got) >= 4 and html_text.extract(df.limit(0)).count() == 0


# pipeline
def test_pipeline_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    kept, at = [], docs
    for _, work in corpus_pipeline.STAGES[:-1]:
        rows = work(spark, at, SF).collect()
        at = spark.createDataFrame(rows, docs.schema)
        kept.append(rows)
    assert {r.doc_id for r in kept[0]} == {k for k, t in plain if any(c.isalpha() for c in t)}
    heads = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in kept[0]])}
    assert {r.doc_id for r in kept[1]} == heads and len(kept[1]) == len(heads)
    cut = {(r.doc_id, r.text) for r in kept[2]}
    again = {(k, s, e) for (k, s, e, first) in brute_spans([(r.doc_id, r.text) for r in kept[1]]) if not first}
    assert {k for k, t in cut if (k, t) not in {(r.doc_id, r.text) for r in kept[1]}} <= {k for k, _, _ in again}
    for r in kept[1]:
        mine = [(s, e) for k, s, e in again if k == r.doc_id]
        left = [w for i, w in enumerate(words(r.text)) if not any(s <= i < e for s, e in mine)]
        assert [words(t) for k, t in cut if k == r.doc_id] == ([left] if left else [])
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(kept[2], docs.schema)).collect() if r.copies}
    assert Counter(r.doc_id for r in kept[3]) == Counter(want)
    lib = Tokenizer.from_file(VOCAB)
    out = corpus_pipeline.run(spark, SF).collect()
    text = {r.doc_id: r.text for r in kept[2]}
    assert Counter(r.doc_id for r in out) == Counter(want)
    for r in out:
        assert list(r.ids) == lib.encode(text[r.doc_id], add_special_tokens=False).ids


def test_stages_on_odd_rows(spark, odd, empty):
    for name, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert all(r["_had"] == 7 and r["_bad"] == 7 and r["doc"] == 7 for r in rows), name
        assert work(spark, empty, SF).count() == 0, name


def test_pipeline_keeps_texts_that_share_an_id(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(9**6)}" for _ in range(80))
    null, shared, other = [text() for _ in range(5)], [text(), text()], text()
    near = lambda t: t + " end"
    rows = [(None, t) for t in null] + [(7, t) for t in shared] + [(8, near(null[1])), (9, near(shared[1])), (3, near(shared[0])), (1, other), (1, other), (None, null[2])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.STAGES[1][1](spark, docs, SF).collect())
    assert got == Counter([(None, t) for t in null] + [(3, near(shared[0])), (7, shared[1]), (1, other)])
