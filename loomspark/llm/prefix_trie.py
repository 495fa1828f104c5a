r"""A trie of conversation prefixes: chained digests, nodes by (depth, digest), subtree sums over ancestors.

Turns are numbered by prefix sums over ranges and reduced to a digest of role and text and a count of words, so no
text is shuffled. Each prefix's digest is the hash of the one before it and the turn's; within blocks of BLOCK turns
the chain is made by one task, and each block's chain hangs on the last digest of the block before it, so a
conversation of any length is dealt over many tasks. Every prefix is a row; groups by (depth, digest) are the nodes.

A node goes to all its ancestors along the prefixes of its smallest member, its owner. The nodes that a conversation
owns are a run down to its end, so they are summed first (suffix sums), and the run is sent to the ancestors once
instead of each of its nodes alone: as many rows as there are prefixes, where single nodes would take as many as the
square of the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.llm._shared import arrow_batches, by_group, checked, prefix_sums, read, stage
from loomspark.llm.mixing import n_words
from loomspark.llm.resampling import CRC, CRC_TABLE

BLOCK = 1024  # turns of a conversation that one task chains
IDS = 1024  # conversation ids that are joined at a time
EMPTY_SHA256 = hashlib.sha256().hexdigest()


def root_digest() -> Column:
    return F.unhex(F.lit(""))



def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of the role, told off by its length, and the text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def ordered(turns: DataFrame, conv: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, at, digest, words) with a number over all rows in order, and conversations (conv, start, n).

    A conversation's turns are ordered by turn (null first), then role and digest, null roles and texts counting as
    empty; repeated rows all stand. Rows without a conversation id take no part; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col("turn").alias("_turn"), role.alias("_role"), turn_digest(role, text).alias("digest"), n_words(text).alias("words"),
    )
    order = [F.col("conv"), F.col("_turn"), F.col("_role"), F.col("digest"), F.monotonically_increasing_id()]
    rows = stage(prefix_sums(rows, order, {"at": F.lit(1)}, "op12-ranges").select("conv", "at", "digest", "words"), "op12-turns")
    return rows, stage(rows.groupBy("conv").agg(F.min("at").alias("start"), F.count("*").alias("n")), "op12-conversations")


def as_they_are(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of ordered() without change: (conv, depth, length, digest, words) and (conv, length)."""
    placed = by_group(rows, convs, ["conv"], "n").select("conv", (F.col("at") - F.col("start") + 1).alias("depth"), F.col("n").alias("length"), "digest", "words")
    return placed, convs.select("conv", F.col("n").alias("length"))


def forked(rows: DataFrame, convs: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The conversations of ordered(), each rebuilt on the first turns of its host: (conv, depth, length, digest, words) and (conv, length).

    The host of c is c - c % every; its first h = crc32(decimal c) % most turns replace the first h of c.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    mine = convs.select("*", h, (F.col("conv") - F.col("conv") % every).alias("host"))
    hosts = convs.where(F.col("conv") % every == 0).select(F.col("conv").alias("host"), F.col("n").alias("_n"))
    mine = mine.join(hosts, "host", "left").withColumn("k", F.least("h", F.coalesce("_n", F.lit(0)))).drop("_n")  # at most 2 * every conversations have one host
    mine = stage(mine.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "op12-forks")
    placed = by_group(rows, mine, ["conv"], "n").withColumn("p", F.col("at") - F.col("start"))
    own = placed.where(F.col("p") >= F.col("h")).select("conv", (F.col("k") + F.col("p") - F.col("h") + 1).alias("depth"), "length", "digest", "words")
    heads = placed.where((F.col("conv") % every == 0) & (F.col("p") < most - 1)).select(F.col("conv").alias("host"), "p", "digest", "words")
    guests = mine.where("k > 0").select("conv", "length", "host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("p"))
    return own.unionByName(guests.join(heads, ["host", "p"]).select("conv", (F.col("p") + 1).alias("depth"), "length", "digest", "words")), mine.select("conv", "length")


def _sha(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, block, length, turns) to a row a prefix, with its digest within the block and the one before."""
    for b in batches:
        turns = b.column(3)
        counts, flat = np.diff(turns.offsets.to_numpy()), turns.flatten()
        digests, out, before = flat.field("digest").to_pylist(), [], []
        at = 0
        for n in counts:
            last = b""
            for d in digests[at : at + n]:
                before.append(last)
                last = _sha(last, d)
                out.append(last)
            at += n
        repeat = pa.array(np.repeat(np.arange(b.num_rows), counts))
        columns = [b.column(0).take(repeat), b.column(1).take(repeat), b.column(2).take(repeat), flat.field("depth"), pa.array(out, pa.binary()), pa.array(before, pa.binary()), flat.field("words")]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "block", "length", "depth", "digest", "parent", "words"])


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, block, digest) of whole blocks' ends, sorted, to the digest of all turns before the next block."""
    conv = last = None
    for b in batches:
        out = []
        for c, end in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            last = _sha(last, end) if c == conv else end
            conv = c
            out.append(last)
        blocks = pa.array(b.column(1).to_numpy(zero_copy_only=False) + 1, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), blocks, pa.array(out, pa.binary())], ["conv", "block", "base"])


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, block, length, depth, digest, parent, words) from turns (conv, depth from 1, length, digest, words): equal digests at a depth are equal prefixes."""
    arrow_batches(turns.sparkSession)
    at = F.floor((F.col("depth") - 1) / block).alias("block")
    turn = F.struct(F.col("depth").cast("long").alias("depth"), "digest", F.col("words").cast("long").alias("words"))
    gathered = turns.groupBy("conv", at).agg(F.max("length").cast("long").alias("length"), F.array_sort(F.collect_list(turn)).alias("turns"))  # at most block rows each
    rows = gathered.select("conv", "block", "length", "turns").mapInArrow(_chained, "conv long, block long, length long, depth long, digest binary, parent binary, words long")
    rows = stage(rows, "op12-chains")
    ends = rows.where((F.col("depth") % block == 0) & (F.col("length") > F.col("depth"))).select("conv", "block", "digest")
    bases = stage(ends.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_hung, "conv long, block long, base binary"), "op12-bases")
    first = rows.where("block = 0").withColumn("parent", F.when(F.col("depth") == 1, root_digest()).otherwise(F.col("parent")))
    n = bases.count()
    if not n:
        return first
    hung = lambda c: F.unhex(F.sha2(F.concat("base", c), 256))
    later = rows.where("block > 0").join(checked(bases, n), ["conv", "block"])
    later = later.withColumns({"digest": hung("digest"), "parent": F.when((F.col("depth") - 1) % block == 0, F.col("base")).otherwise(hung("parent"))})
    return stage(first.unionByName(later.drop("base")), "op12-prefixes")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, digest, chunk, ids), sorted, to one row a node: the hash of all its ids. One state is held, however many there are."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.binary()), pa.array([state.hexdigest()])], ["depth", "digest", "ends_sha256"])

    for b in batches:
        done: list[pa.RecordBatch] = []
        for depth, digest, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if (depth, digest) != key:
                if key:
                    done.append(row())
                key, state = (depth, digest), hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if key:
        yield row()


def _owned_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, digest, n_leaves, saved: what each owner's run of nodes, from that depth on, brings to a node on its way."""
    brings = nodes.where("depth > 0").select(F.col("conv_id").alias("conv"), "depth", F.col("leaf").alias("_leaf"), F.col("saved").alias("_saved"))
    rows = rows.select("conv", "block", "depth", "digest").join(brings, ["conv", "depth"], "left")  # a row each on both sides
    below = W.partitionBy("conv", "block").orderBy(F.desc("depth"))
    sums = {x: F.coalesce(F.sum(f"_{x}").over(below), F.lit(0)) for x in ("leaf", "saved")}
    rows = rows.withColumns(sums)
    blocks = stage(rows.groupBy("conv", "block").agg(F.max("leaf").alias("_l"), F.max("saved").alias("_s")).where("block > 0 AND (_l > 0 OR _s > 0)"), "op12-blocks")
    if not blocks.isEmpty():  # only long conversations have more than one
        later = blocks.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1))).groupBy("conv", F.col("_to").alias("block")).agg(F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
        rows = rows.join(later, ["conv", "block"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))})
    return rows.where("leaf > 0 OR saved > 0").groupBy("depth", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Return one row a node, the root included: conv_id (smallest member), depth, digest, parent_conv_id (root: null), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    turns (conv, depth from 1 without gaps, length, digest, words) and convs (conv, length), each conversation once,
    come from as_they_are() or forked(); conversations without turns are members of the root. Equal conversations
    share all their nodes. No conversations give no rows.
    """
    rows = prefixes(turns, block)
    convs = convs.select("conv", "length")
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("parent").alias("parent"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), root_digest().alias("digest"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("binary").alias("parent"))
    nodes = stage(nodes.unionByName(root), "op12-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "digest"], "left").fillna(0, ["n_children"])
    nodes = stage(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "op12-families")

    whole = nodes.agg(F.count("*").alias("_n"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).where("_n > 0")
    sums = _owned_sums(rows, nodes).unionByName(whole.select(F.lit(0).cast("long").alias("depth"), root_digest().alias("digest"), "n_leaves", "saved_tokens"))

    ends = rows.where("depth = length").select("depth", "digest", "conv")
    ends = ends.unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), root_digest().alias("digest"), "conv"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy("depth", "digest", F.floor(F.col("conv") / IDS).alias("chunk")).agg(ids.alias("ids"))
    hashed = chunks.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "chunk").mapInArrow(_ends, "depth long, digest binary, ends_sha256 string")

    parents = nodes.where("n_children > 0").select(F.col("depth").alias("_depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("times"))
    below = by_group(nodes.where("depth > 0").withColumn("_depth", F.col("depth") - 1), parents, ["_depth", "parent"], "times")
    families = below.drop("_depth", "times").unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = families.join(sums, ["depth", "digest"], "left").join(hashed, ["depth", "digest"], "left")
    return out.select(
        "conv_id", "depth", "digest", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its host."""
    return trie(*forked(*ordered(read(spark, sf_dir, "conversations")))).drop("digest")


ORACLE = rf"""
WITH {CRC_TABLE},
t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS n FROM t GROUP BY c),
forks AS (SELECT c, n, {CRC.format(x="c::VARCHAR")} % 4 AS h FROM own, crc),
k AS (SELECT f.*, least(f.h, coalesce(o.n, 0)) AS k FROM forks f LEFT JOIN own o ON o.c = f.c - f.c % 20),
rebuilt AS (
  SELECT k.c, p + 1 AS d, role, text FROM k JOIN t ON t.c = k.c - k.c % 20 AND p < h
  UNION ALL SELECT k.c, k.k + p - h + 1, role, text FROM k JOIN t ON t.c = k.c AND p >= h),
chain AS (
  SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         sha256(string_agg(sha256(len(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS key FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM own),
pre AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS last FROM chain),
nodes AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words, min(parent) AS parent FROM pre GROUP BY d, key),
kin AS (SELECT n.*, coalesce(m.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT d - 1 AS d, parent AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL) m USING (d, key)),
sums AS (
  SELECT p.d, p.key, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.words)::BIGINT AS saved
  FROM kin k JOIN pre p ON p.c = k.conv_id AND p.d <= k.d GROUP BY p.d, p.key),
ends AS (SELECT d, key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM pre WHERE last GROUP BY d, key)
SELECT k.conv_id, k.d::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM kin k JOIN sums s USING (d, key) LEFT JOIN ends e USING (d, key) LEFT JOIN nodes u ON u.d = k.d - 1 AND u.key = k.parent
"""
