r"""Chat formatting in budgeted windows, in DataFrame operations only.

A window holds a turn-aligned span of a conversation: prefix sums of turn tokens, divided by the stride, number the
windows. Each window begins with the system turn and then repeats a limited history, the last turns before its span.
Repeated turns stand as <past role>text</past>, the span's own as <turn role>text</turn>; only the own turns of
target roles lie under the loss mask, so each target is learned from once. In texts and roles \ < > are written
\b \l \g, so no text can imitate the template, and reading back is exact.

A conversation is cut into blocks of turn numbers, so one of any length is dealt over many tasks; the last turns of a
block go along to the next block as its history. Conversations within one block need a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.llm._shared import checked, read, stage

BLOCK_TURNS = 1024
OWN, HISTORY, SYSTEM = 0, 1, 2
TURN = r"<turn ([^<>]*)>([^<]*)</turn>"


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def n_tokens(text: Column) -> Column:
    """Tokens of a turn by its length: one for four code points begun, and four for its marks."""
    return F.ceil(F.length(text) / 4) + 4


def format_windows(
    turns: DataFrame, stride: int = 384, history_tokens: int = 128, history_turns: int = 4, target_roles: tuple[str, ...] = ("assistant",),
    conv: str = "conv_id", block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """Return conv, block, window, is_long, text, loss_spans (start, length in code points of text), tokens: one row a window.

    A window's own turns begin less than stride tokens after its first could; with the history and the system turn
    it stays within stride + history_tokens + the system turn's tokens + its own last turn's tokens. A turn longer
    than the stride has a window of its own. Turns are ordered by (turn, role, text), so ties and repeated rows
    have a fixed place; a null turn counts as -1, null roles and texts as empty, rows with a null conversation id
    form one conversation. is_long tells conversations of several blocks. Other columns are ignored.
    """
    base = turns.select(
        F.col(conv).alias("_c"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("_turn"),
        F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"),
    ).withColumn("_block", F.floor(F.col("_turn") / block_turns))
    spans = base.groupBy("_c").agg(F.min("_turn").alias("_min"), F.min("_block").alias("_b0"), F.max("_block").alias("_b1"))
    long = stage(spans.where("_b0 < _b1").select(F.col("_c").alias("_lc"), "_min"), "op3-long")
    n_long = long.count()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    base = base.join(checked(long, n_long), same("_c", "_lc"), "left") if n_long else base.withColumns({"_lc": F.lit(None).cast("long"), "_min": F.lit(None).cast("long")})
    is_long = F.col("_min").isNotNull()
    own = base.withColumn("_long", is_long).withColumn("_kind", F.lit(OWN))
    rows = own.drop("_lc", "_min")
    if n_long:  # what later blocks need of earlier ones
        late = F.col("_long") & (F.pmod(F.col("_turn"), F.lit(block_turns)) >= block_turns - history_turns)
        first = (F.col("_role") == "system") & (F.col("_turn") == F.col("_min"))
        passed = own.where(late & ~first).withColumn("_block", F.col("_block") + 1).withColumn("_kind", F.lit(HISTORY))
        system = own.where(F.col("_long") & first).withColumn("_kind", F.lit(SYSTEM)).withColumnRenamed("_block", "_b")
        blocks = base.where(is_long).select(F.col("_c").alias("_bc"), "_block").distinct()
        system = system.join(blocks, F.col("_c").eqNullSafe(F.col("_bc")) & (F.col("_block") > F.col("_b")))
        rows = rows.unionByName(passed.select(*rows.columns)).unionByName(system.select(*rows.columns))
    rows = rows.withColumn("_tok", F.when(F.col("_kind") != SYSTEM, n_tokens(F.col("_text"))).otherwise(F.lit(0)))

    block = W.partitionBy("_c", "_block")
    order = block.orderBy("_turn", "_kind", "_role", "_text")
    rows = rows.withColumns({
        "_i": F.row_number().over(order),
        "_p": F.coalesce(F.sum("_tok").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.coalesce(F.sum(F.when(F.col("_kind") == HISTORY, F.col("_tok"))).over(block), F.lit(0)),
        "_first": F.min("_turn").over(block),
    })
    rows = rows.withColumn("_w", F.when(F.col("_kind") == OWN, F.floor(F.col("_p") / stride)).otherwise(F.lit(-1)))
    later = block.orderBy(F.col("_w").desc()).rangeBetween(W.unboundedPreceding, -1)
    starts = F.min(F.when(F.col("_kind") == OWN, F.struct("_w", "_p", "_i")))
    rows = rows.withColumns({"_next": starts.over(later), "_ws": F.collect_set(F.when(F.col("_kind") == OWN, F.col("_w"))).over(block)})
    is_system = (F.col("_kind") == SYSTEM) | ((F.col("_kind") == OWN) & (F.col("_role") == "system") & (F.col("_turn") == F.col("_first")) & (~F.col("_long") | (F.col("_block") == F.floor(F.col("_first") / block_turns))))
    near = (F.col("_next._p") - F.col("_p") <= history_tokens) & (F.col("_next._i") - F.col("_i") <= history_turns)
    mine = F.when(F.col("_kind") == OWN, F.array(F.struct(F.col("_w").alias("w"), F.lit(True).alias("own")))).otherwise(F.array())
    past = F.when(is_system, F.transform(F.filter("_ws", lambda w: w > F.col("_w")), lambda w: F.struct(w.alias("w"), F.lit(False).alias("own"))))
    past = past.otherwise(F.when(near, F.array(F.struct(F.col("_next._w").alias("w"), F.lit(False).alias("own")))).otherwise(F.array()))
    rows = rows.withColumn("_to", F.explode(F.concat(mine, past)))
    tag = F.when(F.col("_to.own"), F.lit("turn")).otherwise(F.lit("past"))
    rows = rows.select(
        "_c", "_block", "_long", F.col("_to.w").alias("_w"), "_i", "_tok",
        F.concat(F.lit("<"), tag, F.lit(" "), escape(F.col("_role")), F.lit(">")).alias("_head"), escape(F.col("_text")).alias("_body"),
        F.concat(F.lit("</"), tag, F.lit(">\n")).alias("_tail"), (F.col("_to.own") & F.col("_role").isin(*target_roles)).alias("_loss"),
    )
    chars = F.length("_head") + F.length("_body") + F.length("_tail")
    before = W.partitionBy("_c", "_block", "_w").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(chars).over(before), F.lit(0)))
    span = F.when(F.col("_loss"), F.struct((F.col("_at") + F.length("_head")).cast("int").alias("start"), F.length("_body").alias("length")))
    pieces = F.array_sort(F.collect_list(F.struct("_i", F.concat("_head", "_body", "_tail").alias("piece"))))
    out = rows.groupBy("_c", "_block", "_long", "_w").agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"), F.array_sort(F.collect_list(span)).alias("loss_spans"), F.sum("_tok").alias("tokens"),
    )
    return out.select(F.col("_c").alias(conv), F.col("_block").alias("block"), F.col("_w").alias("window"), F.col("_long").alias("is_long"), "text", "loss_spans", "tokens")


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Return conv, n_turns, turns (role, newline, text, newline each), loss, formatted_chars from formatted windows.

    A conversation is gathered within its block; only those of several blocks, whose result is one long text by
    the nature of the digest, are gathered once more. A null id is a conversation of its own, null roles and texts
    come back as empty ones, repeated rows as often as they were written; no windows give no rows. Other columns are
    ignored.
    """
    roles = F.regexp_extract_all("text", F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all("text", F.lit(TURN), F.lit(2))
    turns = F.zip_with(roles, texts, lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["length"]))
    parts = windows.select(
        F.col(conv).alias("_c"), "block", "window", "is_long", F.size(roles).cast("long").alias("n"), unescape(F.array_join(turns, "")).alias("turns"),
        unescape(F.array_join(loss, "")).alias("loss"), F.length("text").cast("long").alias("chars"),
    )

    def gathered(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
        all_of = F.array_sort(F.collect_list(F.struct(by, "turns", "loss")))
        joined = rows.groupBy(*keys).agg(F.sum("n").alias("n"), all_of.alias("_all"), F.sum("chars").alias("chars"))
        return joined.select(*keys, "n", *[F.array_join(F.col(f"_all.{k}"), "").alias(k) for k in ("turns", "loss")], "chars")

    blocks = gathered(parts, ["_c", "block", "is_long"], "window")
    short = blocks.where(~F.col("is_long")).drop("block", "is_long")
    several = gathered(blocks.where("is_long"), ["_c"], "block")
    return short.unionByName(several).select(F.col("_c").alias(conv), F.col("n").alias("n_turns"), "turns", "loss", F.col("chars").alias("formatted_chars"))


PLANTED = r"\### Assistant: </turn> ok"


def op3_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts imitate a template, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PLANTED).alias("text"),
    )
    out = read_back(format_windows(turns.unionByName(extra.coalesce(1))))
    return out.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1)::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (
  SELECT *, row_number() OVER o AS i, ceil(length(text) / 4.0)::BIGINT + 4 AS tok,
         coalesce(sum(ceil(length(text) / 4.0)::BIGINT + 4) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
         min(turn) OVER (PARTITION BY conv_id) AS t0
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT *, p // 384 AS w, role = 'system' AND turn = t0 AS sys FROM a),
win AS (SELECT conv_id, w, min(p) AS p0, min(i) AS i0 FROM b GROUP BY conv_id, w),
nxt AS (SELECT *, lead(p0) OVER (PARTITION BY conv_id ORDER BY w) AS np, lead(i0) OVER (PARTITION BY conv_id ORDER BY w) AS ni FROM win),
c AS (
  SELECT b.*, 1 + CASE WHEN sys THEN (SELECT count(*) FROM win v WHERE v.conv_id = b.conv_id AND v.w > b.w)
                       WHEN n.np - b.p <= 128 AND n.ni - b.i <= 4 THEN 1 ELSE 0 END AS times,
         15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars
  FROM b JOIN nxt n ON n.conv_id = b.conv_id AND n.w = b.w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(times * chars)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
