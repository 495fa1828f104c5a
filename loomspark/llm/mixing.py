"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each document has a fixed 60-bit hash of its id. A source whose target is t of its size s is read floor(t / s) times
in whole, and the rest of the target is met by the documents whose hash is under a threshold: sums of size by
(source, first 12 bits) place the threshold in one bucket, and only that bucket's documents are looked at again, by
their next 12 bits, until few are left in it. Nothing is sorted over all documents, and the final pass is a filter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.llm._shared import BROADCAST_ROWS, WORD, checked, prefix_sums, read, stage

DIGITS = 3  # hex digits of the hash that a histogram tells apart
HASH_DIGITS = 15
FEW = 4096  # a bucket of at most so many documents is resolved exactly
SALTS = 64  # the parts that a source's documents are joined in when thresholds are not broadcast


def n_words(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_digits(key: Column) -> Column:
    """15 hex digits that depend on the key alone."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, HASH_DIGITS)


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last; the sum of sizes is shared
    by weight, none above cap times its size, what lies above reshared until none is above.

    Each round caps the sources whose share at the current level is above their limit, so the level only rises; sums
    of a round come from one aggregate, and no source leaves the executors.
    """
    ranked = prefix_sums(sources, [F.col("source").isNull(), F.col("source")], {"_rank": F.lit(1)}, "op1-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * float(cap)).alias("_max")), "op1-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("_w") * F.lit(level) > F.col("_max")
        full, weight_left, n = ranked.agg(F.sum(F.when(above, F.col("_max")).otherwise(0.0)), F.sum(F.when(~above, F.col("_w")).otherwise(0.0)), F.sum(above.cast("int"))).first()
        if not weight_left or n == capped:
            break
        level, capped = (total - full) / weight_left, n
    return ranked.select("source", "source_size", F.least(F.col("_w") * F.lit(level), F.col("_max")).alias("target"))


def _thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """source, _full, _upto: documents are read _full times, and once more when their digits are at most _upto.

    Digits compare as text. The boundary document is read where that brings the source nearer to its target.
    """
    # What is left of the target after whole readings, and the digits known so far to lie under the threshold.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("_full", whole).withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size"))
    state = stage(goals.select(F.col("source").alias("_s"), "_full", F.col("_rest"), F.lit("").alias("_at")), "op1-state")
    n = state.count()
    depth = 0
    while True:
        open_rows = _at_boundary(sized, state, n, depth).select("_s", F.substring("_h", 1, depth + DIGITS).alias("_b"), "_size")
        sums = open_rows.groupBy("_s", "_b").agg(F.sum("_size").alias("_sum"), F.count("*").alias("_rows"))
        by = W.partitionBy("_s").orderBy("_b")
        before = F.coalesce(F.sum("_sum").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # The boundary is the last bucket that begins under the target.
        goal = state.select(F.col("_s").alias("_g"), "_full", "_rest")
        found = sums.withColumn("_before", before).join(checked(goal, n), F.col("_s").eqNullSafe(F.col("_g"))).where(F.col("_before") < F.col("_rest"))
        best = found.groupBy("_s", "_full", "_rest").agg(F.max_by(F.struct("_b", "_before", "_rows"), F.col("_b")).alias("_m"))
        state_next = best.select("_s", "_full", (F.col("_rest") - F.col("_m._before")).alias("_rest"), F.col("_m._b").alias("_at"), F.col("_m._rows").alias("_rows"))
        state = stage(state_next, "op1-state")
        depth += DIGITS
        most = state.agg(F.max("_rows")).first()[0] or 0
        if most <= FEW or depth >= HASH_DIGITS:
            break
    rest = _at_boundary(sized, state, n, depth)
    rest = rest.groupBy("_s", "_h", "_rest", "_at").agg(F.sum("_size").alias("_sum"))  # equal ids go together
    upto = F.sum("_sum").over(W.partitionBy("_s").orderBy("_h"))
    take = rest.withColumn("_mid", 2 * upto - F.col("_sum")).where(F.col("_mid") <= 2 * F.col("_rest"))
    last = take.groupBy("_s").agg(F.max("_h").alias("_last"))
    out = goals.select("source", "source_size", "target", "_full").join(checked(state.select("_s", "_at"), n), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    out = out.join(checked(last, n), F.col("source").eqNullSafe(F.col("_s")), "left")
    # Without a document to take in the boundary bucket, all that lies before that bucket is taken: "0ab" is under "0ab0...".
    return out.select("source", "source_size", "target", F.col("_full").cast("long").alias("_full"), F.coalesce("_last", "_at", F.lit("")).alias("_upto"))


def _at_boundary(sized: DataFrame, state: DataFrame, n: int, depth: int) -> DataFrame:
    """The documents of each source's boundary bucket."""
    return _by_source(sized, state.select("_s", "_rest", "_at"), n).where(F.substring("_h", 1, depth) == F.col("_at"))


def _by_source(rows: DataFrame, by_source: DataFrame, n: int, key: str = "_source") -> DataFrame:
    """rows with the columns of their source, whose key is _s. A hot source is joined in SALTS parts if there are too many to broadcast."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(by_source), F.col(key).eqNullSafe(F.col("_s")))
    spread = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt0", F.pmod(F.xxhash64("_h"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, F.col(key).eqNullSafe(F.col("_s")) & (F.col("_salt0") == F.col("_salt"))).drop("_salt", "_salt0")


def _goals(docs: DataFrame, weights: Sequence[float], cap: float, source: str, key: str, size: Callable[[Column], Column], text: str) -> tuple[DataFrame, DataFrame]:
    """Sizes (_key, _source, _size, _h) and limits (source, source_size, target, _full, _upto), both staged."""
    sized = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), size(F.col(text)).alias("_size"), hash_digits(F.col(key)).alias("_h"))
    sized = stage(sized, "op1-sized")  # the texts are read once
    sources = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    goals = stage(targets(sources, weights, cap), "op1-targets")
    return sized, stage(_thresholds(sized, goals), "op1-limits")


def _copies() -> Column:
    return F.col("_full") + (F.col("_h") <= F.col("_upto")).cast("long")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, source: str = "source", key: str = "doc_id",
    size: Callable[[Column], Column] = n_words, text: str = "text",
) -> DataFrame:
    """Return one row per document: key, source, size, source_size, target, copies (0 to ceil(cap)), taken = size * copies.

    Null texts have size 0, a null source is a source of its own and comes last, a null key hashes as the text
    "null"; rows with equal keys in a source are read or left together. Empty tables give no rows; sources without
    words get target 0. Other columns are ignored, so none can clash.
    """
    sized, limits = _goals(docs, weights, cap, source, key, size, text)
    joined = _by_source(sized, limits.withColumnRenamed("source", "_s"), limits.count())
    return joined.select(
        F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target",
        _copies().alias("copies"), (F.col("_size") * _copies()).alias("taken"),
    )


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, source: str = "source", key: str = "doc_id",
    size: Callable[[Column], Column] = n_words, text: str = "text",
) -> DataFrame:
    """Return the rows of docs as often as the mix reads them, with all their columns; the texts are not shuffled for few sources."""
    _, limits = _goals(docs, weights, cap, source, key, size, text)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[source].cast("string").alias("_source"), hash_digits(docs[key]).alias("_h"))
    joined = _by_source(row, limits.withColumnRenamed("source", "_s"), limits.count())
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), _copies().cast("int"))).alias("_")).select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed 5 : 2 : 1, repeating over sources."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS h FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
ratio AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source) AS k FROM src),
runs AS (
  SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE - (sum(most) OVER (ORDER BY k) - most))
            / (sum(w) OVER (ORDER BY k DESC)) AS level FROM ratio),
lv AS (SELECT coalesce(min_by(level, k) FILTER (WHERE level * w <= most), 0) AS level FROM runs),
goal AS (
  SELECT source, source_size, least(w * level, most) AS target,
         CASE WHEN source_size > 0 THEN floor(least(w * level, most) / source_size) ELSE 0 END::BIGINT AS whole FROM ratio, lv),
runsum AS (
  SELECT source, h, sum(size) AS s, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h)
SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
       g.whole + CASE WHEN 2 * r.upto - r.s <= 2 * (g.target - g.whole * g.source_size)
                       AND r.upto - r.s < g.target - g.whole * g.source_size THEN 1 ELSE 0 END AS copies,
       d.size * (g.whole + CASE WHEN 2 * r.upto - r.s <= 2 * (g.target - g.whole * g.source_size)
                       AND r.upto - r.s < g.target - g.whole * g.source_size THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
JOIN runsum r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h
"""
