"""Document fingerprints from closed syncmers.

A stretch of K code points is an anchor when the least hash among its inner stretches of S code points lies at its
first or last place. That depends on the stretch alone, so an edit elsewhere moves no anchor, and gaps between anchors
are bounded: 2 K - S - 1 code points hold one at least. A fingerprint is the sequence of all anchors of the whole text,
eight hex digits each, in text order; two are compared by the longest run of common anchors that keeps the order of
both. Texts of less than SHORT code points have a second, finer sequence behind a full stop, by which two such texts
are compared. Of a run of one character the anchors at distances 0, 1, 2, 4, 8 ... from its start stay.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._shared import arrow_batches, partitions, prefix_sums, read, stage

K, S = 20, 6
SHORT, FINE_K, FINE_S = 160, 6, 2
BLOCK_BYTES = 64 << 20  # of text in a block, at most about
CHUNK = 1 << 17  # code points hashed at a time
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all n neighbouring values, by doubling."""
    out, done, have, size = None, 0, x, 1
    while True:
        if n & size:
            out = have if out is None else out[: len(out) - size] * np.uint64(pow(BASE, size, 1 << 64)) + have[done:][: len(out) - size]
            done += size
        if size * 2 > n:
            return out
        have = have[: len(have) - size] * np.uint64(pow(BASE, size, 1 << 64)) + have[size:]
        size *= 2


def least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring values."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :])


def anchors(texts: Sequence[str], k: int = K, s: int = S) -> list[np.ndarray]:
    """For each text its anchors' 32-bit hashes in order; a text too short to have any gets one for its whole, an empty one none."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= CHUNK:
            out += _anchors(held, k, s)
            held, size = [], 0
    return out + _anchors(held, k, s)


def _anchors(texts: list[str], k: int, s: int) -> list[np.ndarray]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) >= k:
        inner = mix(stretches(points, s))
        w = k - s + 1
        low = least(inner, w)
        at = np.flatnonzero((low == inner[: len(low)]) | (low == inner[w - 1 :]))
        owner = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[owner]
        at, owner = at[inside], owner[inside]
        values = (mix(stretches(points, k)[at]) >> np.uint64(32)).astype(np.uint32)
        run = np.zeros(len(at), np.int64)  # the anchors right before that are equal: within a run of one character
        if len(at):
            fresh = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))
            starts = np.flatnonzero(fresh)
            run = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        stays = run & (run - 1) == 0
        values, owner = values[stays], owner[stays]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        out = [values[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
    else:
        out = [np.empty(0, np.uint32) for _ in texts]
    for i in np.flatnonzero((lengths > 0) & (np.array([len(x) for x in out]) == 0)):
        whole = stretches(points[ends[i] - lengths[i] : ends[i]], int(lengths[i]))
        out[i] = (mix(whole) >> np.uint64(32)).astype(np.uint32)
    return out


Fingerprint = tuple[np.ndarray, np.ndarray | None]


def fingerprints(texts: Sequence[str]) -> list[Fingerprint]:
    """For each text its anchors, and those of the finer scale if it is short."""
    short = [i for i, t in enumerate(texts) if len(t) < SHORT]
    fine = dict(zip(short, anchors([texts[i] for i in short], FINE_K, FINE_S), strict=True))
    return [(a, fine.get(i)) for i, a in enumerate(anchors(texts))]


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1, by the finer scale where both have it."""
    return _likeness(a[1], b[1]) if a[1] is not None and b[1] is not None else _likeness(a[0], b[0])


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the longest common run of anchors in the order of both, over the number of anchors; 1 for two empty ones.

    The k-th of equal anchors on one side stands for the k-th on the other.
    """
    total = len(a) + len(b)
    if not total:
        return 1.0
    m = min(len(a), len(b))
    unlike = np.flatnonzero(a[:m] != b[:m])
    head = int(unlike[0]) if len(unlike) else m
    a, b, m = a[head:], b[head:], m - head
    unlike = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
    tail = int(unlike[0]) if len(unlike) else m
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    same = head + tail
    if len(a) and len(b):
        shared = np.intersect1d(a, b)
        if len(shared):
            a, b = a[np.isin(a, shared)], b[np.isin(b, shared)]
            places = defaultdict(list)
            for i, x in enumerate(b.tolist()):
                places[x].append(i)
            turn: dict[int, int] = defaultdict(int)
            best: list[int] = []
            for x in a.tolist():
                n = turn[x]
                turn[x] += 1
                if n < len(places[x]):
                    i = places[x][n]
                    j = bisect_left(best, i)
                    best[j : j + 1] = [i]
            same += len(best)
    return 2.0 * same / total


def as_text(fingerprint: Fingerprint) -> str:
    return ".".join(x.astype(">u4").tobytes().hex() for x in fingerprint if x is not None)


def from_text(fingerprint: str) -> Fingerprint:
    parts = [np.frombuffer(bytes.fromhex(x), dtype=">u4").astype(np.uint32) for x in fingerprint.split(".")]
    return parts[0], parts[1] if len(parts) > 1 else None


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key and fingerprint for each row; equal texts have equal ones, null and empty texts a full stop. Other columns are ignored."""
    schema = f"_key {docs.schema[key].dataType.simpleString()}, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(x) for x in fingerprints([x or "" for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["_key", "fingerprint"])

    arrow_batches(docs.sparkSession)
    return docs.select(docs[key].alias("_key"), docs[text]).mapInArrow(run, schema).withColumnRenamed("_key", key)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_block, _tail, _key, _text such that, sorted by these (keys falling, equal ones by a hash of the text), each row without _tail is followed by its next.

    Blocks have nearly equal bytes: global prefix sums over (key, hash) cut them, and only each block's first (key,
    hash) comes to the driver. The first row of a block goes along to the block above as its tail, and the first of
    all to the lowest block, so neighbours meet with one exchange of the texts. There are as many blocks as shuffle
    partitions, or more for BLOCK_BYTES, each a partition of its own.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    bare, falling = F.col("_key").isNull(), F.coalesce(F.bitwise_not(F.col("_key").cast("long")), F.lit(0))
    sized = rows.select(bare.alias("_n"), falling.alias("_k"), "_th", (F.octet_length("_text") + 16).cast("long").alias("_b"))
    placed = prefix_sums(sized, [F.col("_n"), F.col("_k"), F.col("_th")], {"_at": F.col("_b")}, "op5-order")
    placed = stage(placed.select("_n", "_k", "_th", "_at", "_b"), "op5-placed")
    total = placed.agg(F.max(F.col("_at") + F.col("_b"))).first()[0] or 0
    blocks = max(partitions(docs.sparkSession), -(-total // BLOCK_BYTES))
    number = F.floor(F.col("_at") / F.lit(max(1, -(-total // blocks))))
    found = placed.groupBy(number.alias("b")).agg(F.min(F.struct("_n", "_k", "_th")).alias("f")).select("f.*").distinct().toPandas()
    found = found.astype({"_n": "bool", "_k": "int64", "_th": "int64"}).sort_values(["_n", "_k", "_th"])
    null, low, hashes = (found[c].to_numpy() for c in ("_n", "_k", "_th"))
    n, n_keys = len(found), int((~null).sum())

    @F.pandas_udf("array<int>")
    def places(nulls: pd.Series, keys: pd.Series, texts: pd.Series) -> pd.Series:
        bare, k, th = nulls.to_numpy(), keys.to_numpy(), texts.to_numpy()
        a = np.where(bare, n_keys, np.searchsorted(low[:n_keys], k, side="left"))
        b = np.where(bare, n, np.searchsorted(low[:n_keys], k, side="right"))
        block = a - 1
        for i in np.unique(a[a < b]).tolist():  # keys at which a block begins
            same = np.flatnonzero((a == i) & (a < b))
            block[same] = i - 1 + np.searchsorted(hashes[i : b[same[0]]], th[same], side="right")
        block = np.maximum(block, 0)
        first = (hashes[block] == th) & (null[block] == bare) & (bare | (low[block] == k))
        return pd.Series([[x, (x - 1) % n] if f else [x] for x, f in zip(block.tolist(), first.tolist(), strict=True)])

    dealt = rows.select(F.posexplode(places(bare, falling, "_th")).alias("_tail", "_block"), "_key", "_th", "_text")
    return dealt.repartitionById(max(n, 1), F.col("_block")).sortWithinPartitions("_block", "_tail", F.col("_key").desc_nulls_last(), "_th")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, whose last floor(n / 2) code points are the first of the next document.

    The next document has the next lower key (a null key comes last); after the last comes the first. Rows of equal
    keys follow each other by a hash of the text, so repeated rows are neighbours. Null texts count as empty. A table of one row
    is its own next; an empty table gives no rows. Other columns are ignored.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # block, tail, key, text, anchors
        for batch in batches:
            blocks, tails, keys, texts = (c.to_pylist() for c in batch.columns)
            own = fingerprints(texts)
            rows = [*([last] if last else []), *zip(blocks, tails, keys, texts, own, strict=True)]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
            last = rows[-1] if rows else None
            halves = [len(a[3]) // 2 for a, _ in pairs]
            edits = [a[3][: len(a[3]) - h] + b[3][:h] for (a, b), h in zip(pairs, halves, strict=True)]
            others = fingerprints(edits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], batch.column(2).type), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits], pa.string()),
                    pa.array([as_text(a[4]) for a, _ in pairs], pa.string()), pa.array([as_text(o) for o in others], pa.string()),
                    pa.array([likeness(a[4], o) for (a, _), o in zip(pairs, others, strict=True)], pa.float64()), pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                ],
                [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    arrow_batches(docs.sparkSession)
    return with_next(docs, key, text).select("_block", "_tail", "_key", "_text").mapInArrow(run, schema)


def op5_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and how near it is to its edited text's and to the next document's."""
    return compare_with_edits(read(spark, sf_dir, "documents"))
