"""Streams over the tables, run to their end: each reads a table as a stream, and its result is read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators.bucketed import BucketedTable
from loomspark.operators.folders import scratch
from loomspark.plans.catalog import query, table
from loomspark.streaming import jobs, keyed


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "stream")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, one a batch. A pattern for a name, as a stream's folder may be a single file."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", "1").parquet(f"{sf_dir}/{name}.parque[t]")


def _drained(out: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream puts out until its source is used up."""
    spark = out.sparkSession
    folder = _folder(spark)

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")  # a batch that comes again replaces itself

    with keyed.keyed_state(spark):
        run = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(*out.columns)


@query("SELECT date_trunc('hour', ts) AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hours(spark, sf_dir):
    """Hourly windows in update mode; of each window the state of its last batch counts. Files come in no order of time, so rows may be late by the whole span."""
    out = _drained(jobs.hourly_stream(_stream(spark, sf_dir, "events"), "400 days"), "update")
    best = out.groupBy("start", "user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("x"))
    return best.select("start", "user_id", "x.n", F.round("x.total", 4).alias("total"))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) - 1 AS tied FROM events")
def stream_limit(spark, sf_dir):
    """The sliding log in keyed state; requests of one moment count in the order of their ids."""
    e = _stream(spark, sf_dir, "events")
    out = _drained(keyed.limited(e, 2, 6 * 3600))
    b = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    tied = F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id")) - 1
    b = b.withColumn("tied", tied.cast("long"))
    return out.join(b.select("event_id", "tied"), "event_id").select("event_id", "user_id", (F.col("used") - F.col("tied")).alias("before"), "tied")


@query("""WITH RECURSIVE c AS (SELECT event_id AS claim_id, event_id % 40 AS node_id, 'a' || (user_id % 7) AS agent_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_id % 40 ORDER BY epoch_us(ts), event_id) AS r FROM events),
s(claim_id, node_id, agent_id, r, granted, holder, until) AS (SELECT claim_id, node_id, agent_id, r, true, agent_id, t + 86400000000 FROM c WHERE r = 1
  UNION ALL SELECT c.claim_id, c.node_id, c.agent_id, c.r, s.until <= c.t OR s.holder = c.agent_id, CASE WHEN s.until <= c.t OR s.holder = c.agent_id THEN c.agent_id ELSE s.holder END, CASE WHEN s.until <= c.t OR s.holder = c.agent_id THEN c.t + 86400000000 ELSE s.until END
  FROM s JOIN c ON c.node_id = s.node_id AND c.r = s.r + 1)
SELECT claim_id, node_id, agent_id, granted FROM s""")
def stream_leases(spark, sf_dir):
    """Exclusive leases of a day in keyed state."""
    e = _stream(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), (F.col("event_id") % 40).alias("node_id"), F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("agent_id"), "ts")
    return _drained(keyed.leases(e, 86_400))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id AS session_id, md5(string_agg(s, chr(10) ORDER BY turn)) AS turns FROM t WHERE r <= 6 GROUP BY 1""")
def stream_sessions(spark, sf_dir):
    """The last six turns of each conversation in keyed state (digests)."""
    c = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = _drained(keyed.sessions_memory(c), "update")
    return out.groupBy("session_id").agg(F.max_by("turns", F.length("turns")).alias("turns")).select("session_id", F.md5(F.col("turns").cast("binary")).alias("turns"))


@query("""WITH d AS (SELECT doc_id AS id, 'agent' || (doc_id % 5) AS agent_id, md5(text) AS label FROM documents WHERE doc_id % 5 <> 4)
SELECT 'node' AS kind, id::VARCHAR AS id, agent_id, label, NULL AS to_id FROM d
UNION ALL SELECT 'edge', d.id || '>', d.agent_id, CASE WHEN d.id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END, o.id::VARCHAR FROM d JOIN d o ON o.id = d.id - 5
UNION ALL SELECT 'left', d.id || '>', d.agent_id, NULL, (d.id - 5)::VARCHAR FROM d WHERE d.id - 5 NOT IN (SELECT id FROM d)""")
def stream_tenants(spark, sf_dir):
    """Batches of several tenants, nodes and edges, upserted into buckets; rows without a tenant and edges without ends are set aside, and edges offered again when all batches are in."""
    folder = _folder(spark)
    k = F.col("doc_id")
    d = _stream(spark, sf_dir, "documents").select(
        k.alias("id"), F.when(k % 5 != 4, F.concat(F.lit("agent"), (k % 5).cast("string"))).alias("agent_id"), F.md5(F.col("text").cast("binary")).alias("label"), F.lit(0).alias("ordinal"))
    nodes = BucketedTable.create(spark.createDataFrame([], "id long, agent_id string, label string, updated_at timestamp"), f"{folder}/nodes")
    edges = BucketedTable.create(spark.createDataFrame([], "id string, source_id long, target_id long, relation string, agent_id string, updated_at timestamp"), f"{folder}/edges")

    def reject(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/left-{'edges' if 'source_id' in rows.columns else 'nodes'}/epoch={epoch}")  # a batch that comes again replaces itself

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        n = F.col("id")
        return rows, rows.select(F.concat(n.cast("string"), F.lit(">")).alias("id"), n.alias("source_id"), (n - 5).alias("target_id"), F.when(n % 2 == 0, "EVEN").otherwise("ODD").alias("relation"), "agent_id")

    at = F.lit("2024-01-31").cast("timestamp")
    step = jobs.tenant_batches(nodes, edges, split, at, reject)
    d.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    aside = spark.read.schema("id string, source_id long, target_id long, relation string, agent_id string").parquet(f"{folder}/left-edges")
    left = jobs.offered_again(nodes, edges, aside, at)
    text = lambda c: F.col(c).cast("string")
    out = nodes.read().select(F.lit("node").alias("kind"), text("id").alias("id"), "agent_id", "label", F.lit(None).cast("string").alias("to_id"))
    out = out.unionByName(edges.read().select(F.lit("edge").alias("kind"), "id", "agent_id", F.col("relation").alias("label"), text("target_id").alias("to_id")))
    return out.unionByName(left.select(F.lit("left").alias("kind"), "id", "agent_id", F.lit(None).cast("string").alias("label"), text("target_id").alias("to_id")))
