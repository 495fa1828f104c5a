"""Repeated passages by a sparse suffix array over words.

1. Suffixes are retained only where a minimiser says so: the place of the least hash of K words among the WINDOW - K + 1
   such places of each window of WINDOW words. Equal windows retain the same suffix, so a repeated passage of WINDOW
   words or more has a retained suffix in each copy.
2. Retained suffixes are put together by their first K words; those without an equal go.
3. Each remaining suffix is extended left and right to all windows whose minimiser it is; these are sorted, and
   neighbours compared: the first of equal windows, by document and place, is kept, the others repeat it.
4. Windows that overlap are merged into spans of words.

Equal texts are one class: its first document stands for all in these steps, the others repeat it whole. Windows of
suffixes that occur HOT times or more are sorted in parts by document and the first ones of the parts once more; the
parts grow in number with the most frequent suffix. A text is told by its document's key and a hash of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._shared import BROADCAST_ROWS, WORD, arrow_batches, by_group, checked, distinct_texts, read, stage
from loomspark.llm._words import word_hashes
from loomspark.llm.fingerprints import least, mix, stretches

WINDOW, K = 50, 16
HOT, SALTS = 20_000, 64  # times of a suffix, and parts at least
NULL_KEY = -(1 << 63)
PLACE_BITS = 22


def minimisers(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all k words, and for each window the place of its least one, the leftmost of equals."""
    grams = mix(stretches(words, k) + np.uint64(k))
    width = window - k + 1
    if len(grams) < 1 << PLACE_BITS:
        bits = np.uint64(PLACE_BITS)
        packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        places = (least(packed, width) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    else:
        view = np.lib.stride_tricks.sliding_window_view(grams >> np.uint64(PLACE_BITS), width)
        step = 1 << 16
        places = np.concatenate([view[i : i + step].argmin(axis=1) + np.arange(i, min(i + step, len(view))) for i in range(0, len(view), step)])
    return grams, places


def _sequence(words: np.ndarray) -> tuple[int, int]:
    """Two hashes of a word sequence."""
    n = np.uint64(len(words))
    at = np.arange(len(words), dtype=np.uint64)
    a = mix(words + at * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + n
    b = mix(words ^ mix(at + np.uint64(0x632BE59BD9B4E019))).sum(dtype=np.uint64)
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))


def _retained(texts: DataFrame, window: int, k: int) -> DataFrame:
    """doc, th, n, s1, s2 (hashes of the whole sequence) and grams, the hashes at the retained places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            grams, sizes = [np.empty(0, np.int64)], [0]
            for words in word_hashes([x or "" for x in batch.column(2).to_pylist()]):
                for row, x in zip(rows, (len(words), *_sequence(words)), strict=True):
                    row.append(x)
                if len(words) >= window:
                    g, places = minimisers(words, window, k)
                    grams.append(g[np.unique(places)].view(np.int64))
                    sizes.append(len(grams[-1]))
                else:
                    sizes.append(0)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.concatenate(grams)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(r, pa.int64()) for r in rows], lists], ["doc", "th", "n", "s1", "s2", "grams"])

    return stage(texts.select("doc", "th", "text").mapInArrow(run, "doc long, th long, n long, s1 long, s2 long, grams array<long>"), "op6-retained")


def _windows(texts: DataFrame, live: DataFrame, window: int, k: int, salts: int) -> DataFrame:
    """hash, salt, doc, v (the text's hash), place of every window whose minimiser is live; salt is -1 unless it is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (np.int64, np.int32, np.int64, np.int64, np.int32)]
            doc, v, grams, hot, texts = (c.to_pylist() for c in batch.columns)
            for d, version, alive, hots, words in zip(doc, v, grams, hot, word_hashes([x or "" for x in texts]), strict=True):
                g, places = minimisers(words, window, k)
                of = g[places].view(np.int64)
                at = np.flatnonzero(np.isin(of, np.array(alive, np.int64)))
                part = np.full(len(at), -1, np.int32)
                if hots:
                    part[np.isin(of[at], np.array(hots, np.int64))] = int(mix(np.array([d ^ version], np.int64).view(np.uint64))[0] % np.uint64(salts))
                hashes = mix(stretches(words, window) + np.uint64(window))[at].view(np.int64)
                for o, x in zip(out, (hashes, part, np.full(len(at), d), np.full(len(at), version), at.astype(np.int32)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["hash", "salt", "doc", "v", "place"])

    found = texts.join(live, ["doc", "th"]).select("doc", "th", "live", "hot", "text")
    return found.mapInArrow(run, "hash long, salt int, doc long, v long, place int")


def _neighbours(rows: DataFrame) -> DataFrame:
    """The rows sorted by (hash, salt, doc, v, place), each with first (no equal hash and salt before it) and more (an equal one beside it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: np.ndarray | None = None  # of the row before those at hand
        held: list[np.ndarray] | None = None  # the last row, whose next is not known
        for batch in _with_end(batches):
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch is not None else None
            rows = got if held is None else held if got is None else [np.concatenate([a, b]) for a, b in zip(held, got, strict=True)]
            if rows is None or not len(rows[0]):
                continue
            same = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            twin = same & (rows[2][1:] == rows[2][:-1]) & (rows[3][1:] == rows[3][:-1]) & (rows[4][1:] == rows[4][:-1])
            up = np.concatenate([[before is not None and before[0] == rows[0][0] and before[1] == rows[1][0]], same])
            again = np.concatenate([[before is not None and all(before[i] == rows[i][0] for i in range(5))], twin])
            down = np.concatenate([same & ~twin, [False]])
            last = len(rows[0]) - (batch is not None)
            keep = ~again[:last]
            first = ~up[:last]
            yield pa.RecordBatch.from_arrays([*[pa.array(r[:last][keep]) for r in rows], pa.array(first[keep]), pa.array((~first | down[:last])[keep])], ["hash", "salt", "doc", "v", "place", "first", "more"])
            held = [r[last:] for r in rows] if batch is not None else None
            if last:
                before = [r[last - 1] for r in rows]

    dealt = rows.repartition("hash", "salt").sortWithinPartitions("hash", "salt", "doc", "v", "place")
    return dealt.mapInArrow(run, "hash long, salt int, doc long, v long, place int, first boolean, more boolean")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _spans(rows: DataFrame, window: int, k: int) -> DataFrame:
    """doc, th, spans (start, end, kept) for each distinct text of a document that has any. rows (doc, th, text)."""
    once, counts = distinct_texts(rows, "op6-counts")
    own = _retained(once, window, k)
    again = counts.where("times > 1").select("doc", "th", F.lit(True).alias("again"))
    whole = own.where(F.col("n") >= window).select("doc", "th", "n", "s1", "s2").join(checked(again), ["doc", "th"], "left")
    classes = whole.groupBy("s1", "s2").agg(F.min(F.struct("doc", "th")).alias("rep"), F.count("*").alias("times"))
    texts = by_group(whole, stage(classes, "op6-classes"), ["s1", "s2"], "times")
    several = (F.col("times") > 1) | F.coalesce("again", F.lit(False))
    texts = stage(texts.select("doc", "th", "n", (F.struct("doc", "th") != F.col("rep")).alias("copy"), several.alias("several")), "op6-texts")
    reps = own.join(checked(texts.where("copy").select("doc", "th")), ["doc", "th"], "left_anti")
    suffixes = reps.select("doc", "th", F.posexplode("grams").alias("i", "gram"))
    place = F.xxhash64("doc", "th", "i")
    live = suffixes.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("times")).where("a <> b")
    live = stage(live.select("gram", "times"), "op6-live")
    n_live, most = live.agg(F.count("*"), F.max("times")).first()
    salts = max(SALTS, (most or 0) // HOT)
    met = suffixes.join(F.broadcast(live), "gram") if n_live <= BROADCAST_ROWS else by_group(suffixes, live, ["gram"], "times")
    by_text = met.groupBy("doc", "th").agg(F.collect_set("gram").alias("live"), F.collect_set(F.when(F.col("times") >= HOT, F.col("gram"))).alias("hot"))
    rows = stage(_neighbours(_windows(once, by_text, window, k, salts)).where("more or salt >= 0"), "op6-windows")
    sure = rows.where("salt < 0 or not first").select("doc", "v", "place", "first")
    parted = _neighbours(rows.where("salt >= 0 and first").select("hash", F.lit(0).alias("salt"), "doc", "v", "place"))
    lone = rows.where("salt >= 0 and first").select("hash", "doc", "v", "place", F.col("more").alias("had"))
    parted = parted.join(lone, ["hash", "doc", "v", "place"]).where("more or had").select("doc", "v", "place", "first")
    found = sure.unionByName(parted).groupBy("doc", F.col("v").alias("th")).agg(F.collect_list(F.col("place") * 2 + F.col("first").cast("int")).alias("places"))
    both = texts.join(found, ["doc", "th"], "left").where("places is not null or several")

    def merged(starts: np.ndarray) -> list[tuple[int, int]]:
        if not len(starts):
            return []
        cuts = np.flatnonzero(np.diff(starts) > window)
        return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(), (starts[np.concatenate([cuts, [-1]])] + window).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept", pa.bool_())]))
        for batch in batches:
            out = []
            for n, copy, several, places in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                code = np.array(places or [], np.int64)
                again, first = np.unique(code[code % 2 == 0] // 2), np.unique(code[code % 2 == 1] // 2)
                if copy:
                    again, first = np.arange(n - window + 1), first[:0]
                elif several:
                    first = np.setdiff1d(np.arange(n - window + 1), again, assume_unique=True)
                out.append([{"start": a, "end": b, "kept": kept} for kept, s in ((False, again), (True, first)) for a, b in merged(s)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, kind)], ["doc", "th", "spans"])

    both = both.select("doc", "th", "n", "copy", "several", "places")
    return both.mapInArrow(run, "doc long, th long, spans array<struct<start:int,end:int,kept:boolean>>")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    arrow_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Return key, start, end, kept: maximal runs of words (from 0, end excluded) covered by windows of `window` words that stand in several places.

    kept tells runs that stand there for the first time, by key and place; the others can go. Words are compared with
    A-Z as a-z. Keys are integers; a null key comes first. Rows repeated whole count as copies of each other with
    one key and give their spans once; texts that share a key are told apart and stand in the order of a hash. Null,
    empty and short texts have no spans; an empty table gives no rows. Other columns are ignored.
    """
    found = _spans(_rows(docs, key, text), window, k).select("doc", F.explode("spans").alias("s"))
    return found.select(F.when(F.col("doc") != NULL_KEY, F.col("doc")).alias(key), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kept").alias("kept"))


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """Return docs without the words that repeat earlier ones; texts without such words stay as they are, null ones too.

    A span goes with the white space behind it. A row whose text repeats another whole keeps an empty text; rows
    repeated whole keep theirs, or lose the same, together. All columns and rows stay, whatever the names; an empty
    table gives an empty one.
    """
    spans = _spans(_rows(docs, key, text), window, k)
    spans = stage(spans.select("doc", "th", F.filter("spans", lambda s: ~s["kept"]).alias("spans")).where("size(spans) > 0"), "op6-cuts")
    weight = spans.agg(F.count("*") + F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    names = docs.columns
    doc = F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))
    inner = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), doc.alias("doc"), F.xxhash64(F.col(text)).alias("th"))
    found = inner.join(checked(spans, weight), ["doc", "th"], "left")
    word = re.compile(WORD)

    def cut(texts, cuts):  # noqa: ANN001, ANN202
        out = []
        for t, spans in zip(texts, cuts, strict=True):
            if spans and t:
                at = [m.start() for m in word.finditer(t)] + [len(t)]
                pieces, last = [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    pieces.append(t[last : at[s["start"]]])
                    last = at[s["end"]]
                t = "".join(pieces) + t[last:]  # noqa: PLW2901
            out.append(t)
        return out

    @F.arrow_udf("string")
    def without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array(cut(texts.to_pylist(), cuts.to_pylist()), pa.string())

    fresh = F.when(F.col("spans").isNotNull(), without(F.col(f"_row.`{text}`"), F.col("spans"))).otherwise(F.col(f"_row.`{text}`"))
    return found.select(*[(fresh if c == text else F.col(f"_row.`{c}`")).alias(c) for c in names])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of 50 words or more that stand in several places of the documents."""
    return repeated_spans(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS h FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) = 1 AS kept, count(*) OVER (PARTITION BY h) AS n FROM h),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, kept ORDER BY i) <= 50 THEN 0 ELSE 1 END AS cut FROM r WHERE n > 1),
k AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, kept ORDER BY i) AS run FROM g)
SELECT doc_id, min(i)::INT AS start, (max(i) + 50)::INT AS "end", kept FROM k GROUP BY doc_id, kept, run
"""
