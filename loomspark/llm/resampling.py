r"""Target-distribution importance resampling over a position table of n-grams, in DataFrame operations only.

posexplode gives one row a word; window lead() per document puts the following words beside it, so each order's
n-grams are a concatenation; their hash buckets are grouped for the raw texts and for the target texts, and the gains,
one row a bucket, are joined to the n-grams again. Weights are means of gains; a document's score adds Gumbel noise
that its id alone decides, and the highest scores are a draw without replacement.

A document's words are exploded and summed within one task, so only one row a document is shuffled; for orders above
1 the window needs its rows together, in blocks of positions that repeat the first words of the next block, so a
text of any length is dealt over many tasks. Ranks come from totals per range, not from one sorted partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.llm._shared import BROADCAST_ROWS, partitions, prefix_sums, read, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 1 << 16  # positions of a text that one window holds
COPIES = 100_000  # rows that one row stands for are written in parts of so many


def word_in_lower_case(word: Column) -> Column:
    """A-Z as a-z, all else as it is; empty: null. lower() is the quicker way where it does the same."""
    lower = F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))
    return F.when(word != "", lower)


def ngrams(rows: DataFrame, keys: list[str], orders: int, block: int = BLOCK) -> DataFrame:
    """Return keys, _first, _order, _gram: all runs of 1 to orders words of rows' text, each row once.

    Words are runs of ASCII letters and digits and of all beyond ASCII, A-Z as a-z. Where a text begins or ends
    between words, and where it is null or empty, there are rows with a null _gram. _first marks one row of each
    text. keys must tell rows apart if orders is above 1.
    """
    table = rows.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), BETWEEN)).alias("_pos", "_word"))
    table, first = table.withColumn("_word", word_in_lower_case(F.col("_word"))), F.col("_pos") == 0
    if orders == 1:
        return table.select(*keys, first.alias("_first"), F.lit(1).alias("_order"), F.col("_word").alias("_gram"))
    at = F.floor(F.col("_pos") / block)
    ahead = F.array_compact(F.array(at, F.when((at > 0) & (F.col("_pos") % block < orders - 1), at - 1)))
    table = table.select(*keys, "_pos", "_word", at.alias("_own"), F.explode(ahead).alias("_block"))
    order = W.partitionBy(*keys, "_block").orderBy("_pos")
    following = [F.lead("_word", i).over(order) for i in range(1, orders)]
    table = table.withColumns({f"_w{i}": c for i, c in enumerate(following, 1)}).where(F.col("_own") == F.col("_block"))
    run, grams = F.col("_word"), [F.struct(F.lit(1).alias("order"), F.col("_word").alias("gram"))]
    for i in range(1, orders):
        run = F.concat(run, F.lit(" "), F.col(f"_w{i}"))  # null once the text has ended
        grams.append(F.struct(F.lit(i + 1).alias("order"), run.alias("gram")))
    each = F.filter(F.array(*grams), lambda g: g["gram"].isNotNull() | (g["order"] == 1))
    table = table.select(*keys, first.alias("_first"), F.explode(each).alias("_g"))
    return table.select(*keys, (F.col("_first") & (F.col("_g.order") == 1)).alias("_first"), F.col("_g.order").alias("_order"), F.col("_g.gram").alias("_gram"))


def bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(gram.cast("binary")) % buckets


def _told_apart(docs: DataFrame, text: str, key: Column, orders: int) -> tuple[DataFrame, list[str]]:
    """Texts with the columns that tell them apart: key and hash of the text do for sums, windows need a number of the row."""
    rows = docs.select(key.alias("_doc"), F.xxhash64(text).alias("_th"), F.col(text).alias("text"))
    if orders == 1:
        return rows, ["_doc", "_th"]
    return stage(rows.withColumn("_row", F.monotonically_increasing_id()), "op11-rows"), ["_doc", "_th", "_row"]


def _bucket_counts(grams: DataFrame, buckets: int, name: str) -> DataFrame:
    return grams.where(F.col("_gram").isNotNull()).groupBy(bucket(F.col("_gram"), buckets).alias("_bucket")).agg(F.count("*").alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """_bucket, _gain for each bucket that raw n-grams fall in: how much likelier the target is to use it, in thousandths of a natural log."""
    counts = stage(_bucket_counts(raw, buckets, "s").join(_bucket_counts(target, buckets, "t"), "_bucket", "full").fillna(0, ["s", "t"]), "op11-buckets")
    n_raw, n_target = (x or 0 for x in counts.agg(F.sum("s"), F.sum("t")).first())
    up, down = (F.col("t") + 1).cast("double") * F.lit(float(n_raw + buckets)), (F.col("s") + 1).cast("double") * F.lit(float(n_target + buckets))
    return counts.where("s > 0").select("_bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("_gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256("seed:key")."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, seed: int = 2024, percent: float = 10, least_words: int = 20,
    key: str = "doc_id", text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """Return key, n_words, n_features, weight, score, rank (null if not drawn): one row for each row of docs.

    Of the rows with at least least_words words, floor(percent * their number / 100) of the highest scores are drawn;
    ties go to the smaller key, null first, then to a hash of the text. Null and empty texts have no features and
    weight 0. A null key draws the noise of the text "null"; repeated rows have one score and ranks next to each
    other. An empty table gives no rows, an empty target gains from raw counts alone. Other columns of docs and
    target are ignored, whatever their names. buckets is bounded by BROADCAST_ROWS, as the gains are broadcast.
    """
    if not 1 <= buckets <= BROADCAST_ROWS:
        raise ValueError(f"buckets must lie between 1 and {BROADCAST_ROWS}")
    rows, keys = _told_apart(docs, text, F.col(key), orders)
    wanted, wanted_keys = _told_apart(target, text, F.lit(0), orders)
    grams = ngrams(rows, keys, orders, block)
    gain = F.broadcast(gains(grams, ngrams(wanted, wanted_keys, orders, block), buckets))  # a row a bucket
    joined = grams.withColumn("_bucket", bucket(F.col("_gram"), buckets)).join(gain, "_bucket", "left")
    sums = joined.groupBy(*keys).agg(
        F.count_if("_first").alias("times"), F.count_if(F.col("_gram").isNotNull() & (F.col("_order") == 1)).alias("w"), F.count("_gram").alias("f"), F.coalesce(F.sum("_gain"), F.lit(0)).alias("g"),
    )
    floor_mean = F.when(F.col("f") > 0, F.expr("(g - pmod(g, f)) div f")).otherwise(F.lit(0)).cast("long")
    scored = sums.select("_doc", "_th", "times", F.expr("w div times").alias("n_words"), F.expr("f div times").alias("n_features"), floor_mean.alias("weight"))
    scored = stage(scored.withColumn("score", F.col("weight") + noise(F.col("_doc"), seed)), "op11-scored")
    enough = F.col("n_words") >= least_words
    drawn = int(percent * (scored.where(enough).agg(F.sum("times")).first()[0] or 0) // 100)
    ranked = prefix_sums(scored.where(enough), [-F.col("score"), F.col("_doc"), F.col("_th")], {"_before": F.col("times")}, "op11-ranked")
    out = ranked.select(*scored.columns, "_before").unionByName(scored.where(~enough).withColumn("_before", F.lit(drawn).cast("long")))
    if (scored.agg(F.max("times")).first()[0] or 1) > COPIES:  # rows alike by the hundred thousand are written by several tasks
        out = out.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"), F.lit(COPIES).cast("long")))).repartition(partitions(docs.sparkSession))
        upto = F.least(F.col("_from") + COPIES - 1, F.col("times"))
    else:
        out, upto = out.withColumn("_from", F.lit(1).cast("long")), F.col("times")
    out = out.withColumn("_copy", F.explode(F.sequence(F.col("_from"), upto))).withColumn("_rank", F.col("_before") + F.col("_copy"))
    return out.select(F.col("_doc").alias(key), "n_words", "n_features", "weight", "score", F.when((F.col("_rank") <= drawn) & (F.col("n_words") >= least_words), F.col("_rank")).alias("rank"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the benchmark's words."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of the bytes of a text x, by its table of 256 remainders (CTE crc, to be joined).
CRC_TABLE = "crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) ORDER BY i) AS rest FROM range(256) r(i))"
CRC = """xor(list_reduce(list_transform(range(len(hex({x})) // 2), lambda i: ('0x' || substr(hex({x}), 2 * i + 1, 2))::BIGINT),
            lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"""

ORACLE = rf"""
WITH {CRC_TABLE},
grams AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS gram FROM documents
  UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
hashed AS (SELECT gram, {CRC.format(x="gram")} % 10000 AS bucket FROM (SELECT DISTINCT gram FROM grams), crc),
placed AS (SELECT side, doc_id, bucket FROM grams JOIN hashed USING (gram)),
counts AS (SELECT bucket, count(*) FILTER (WHERE side = 'd')::DOUBLE AS s, count(*) FILTER (WHERE side = 'b')::DOUBLE AS t FROM placed GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
         coalesce(floor(g / n), 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r <= floor(10 * n / 100) THEN r END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""
