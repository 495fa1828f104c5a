"""Analytics, audit, limits and benchmark queries over events, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomspark.operators import analytics
from loomspark.plans.catalog import query, table


@query("SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-17' GROUP BY 1, 2")
def ingest_timeseries(spark, sf_dir):
    return analytics.hourly(table(spark, sf_dir, "events"), "2024-01-10", "2024-01-17").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS mean, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS n_errors FROM events GROUP BY 1")
def query_timeseries(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("HOUR", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors"))


@query("SELECT count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 6) AS mean, max(value) AS most, count(DISTINCT user_id) AS n_users FROM events")
def overview(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.countDistinct("user_id").alias("n_users"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_agents(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT user_id, first(event_type ORDER BY ts, event_id) AS first_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1")
def workflow_summary(spark, sf_dir):
    return analytics.summary(table(spark, sf_dir, "events"))


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 8 AND ts BETWEEN '2024-01-05' AND '2024-01-20' AND event_type IN ('click', 'error') ORDER BY ts, event_id LIMIT 100")
def workflow_events_filtered(spark, sf_dir):
    return analytics.audit(table(spark, sf_dir, "events"), 8, "2024-01-05", "2024-01-20", ["click", "error"], 100).select("event_id", "ts", "event_type")


@query("""SELECT a.event_id, a.user_id, count(b.event_id) - 1 AS used, count(b.event_id) - 1 < 2 AS allowed, greatest(0, 2 - count(b.event_id)) AS remaining
FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts > a.ts - INTERVAL 6 HOUR AND b.ts <= a.ts GROUP BY 1, 2""")
def rate_limit_sliding(spark, sf_dir):
    return analytics.rate_limit(table(spark, sf_dir, "events"), 2, 6 * 3600)


@query("""WITH s AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_id, ts FROM s WHERE r = 1""")
def latest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("run_id", F.col("event_id"))
    return analytics.latest_runs(e, ["user_id"], "ts").select("user_id", "event_id", "ts")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS cost, CASE WHEN sum((value > 10)::INT) > 0 THEN round(sum(value) / sum((value > 10)::INT), 6) END AS cost_per_correct FROM r WHERE k = 1 GROUP BY 1""")
def latest_run_summary(spark, sf_dir):
    last = analytics.latest_runs(table(spark, sf_dir, "events").withColumn("run_id", F.col("event_id")), ["user_id", "event_type"], "ts")
    good = F.sum((F.col("value") > 10).cast("int"))
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("cost"), F.when(good > 0, F.round(F.sum("value") / good, 6)).alias("cost_per_correct"))


@query("""WITH a AS (SELECT user_id AS agent_id, user_id % 3 * 24 AS interval_hours, CASE WHEN user_id % 7 <> 0 THEN max(ts) END AS last_run FROM events GROUP BY user_id)
SELECT agent_id FROM a WHERE interval_hours > 0 AND (last_run IS NULL OR epoch(TIMESTAMP '2024-01-31') - floor(epoch(last_run)) >= interval_hours * 3600)""")
def due_agents(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("agent_id")).agg(F.max("ts").alias("m"))
    a = a.select("agent_id", (F.col("agent_id") % 3 * 24).alias("interval_hours"), F.when(F.col("agent_id") % 7 != 0, F.col("m")).alias("last_run"))
    return analytics.due(a, F.lit("2024-01-31").cast("timestamp"))


@query("SELECT event_id, user_id, (props::JSON ->> '$.k')::BIGINT AS k, event_id > 5000 AND (props::JSON ->> '$.k')::BIGINT > 50 AS big FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 1000")
def incremental_cursor(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").where("event_id > 500").orderBy("event_id").limit(1000)
    return e.select("event_id", "user_id", k.alias("k"), ((F.col("event_id") > 5000) & (k > 50)).alias("big"))


@query("SELECT substr(sha256(event_id::VARCHAR), 1, 32) AS id, event_id AS cursor, event_type || chr(10) || props AS text FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 500")
def keyset_pagination(spark, sf_dir):
    from loomspark.sources.connectors import keyset_page

    return keyset_page(table(spark, sf_dir, "events"), "event_id", 1000, 500, ["event_type", "props"], "event_id")


@query("""WITH s AS (SELECT doc_id AS uri, source AS modified, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0)
SELECT d.doc_id AS uri, CASE WHEN s.uri IS NOT NULL AND d.doc_id % 5 = 0 THEN 'fast_skip' WHEN s.uri IS NOT NULL AND d.doc_id % 7 <> 0 THEN 'hash_skip' ELSE 'emit' END AS action
FROM documents d LEFT JOIN s ON s.uri = d.doc_id""")
def incremental_hash_skip(spark, sf_dir):
    from loomspark.operators.ingest import incremental

    d = table(spark, sf_dir, "documents")
    state = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("uri"), F.col("source").alias("modified"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    now = d.select(F.col("doc_id").alias("uri"), F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise(F.lit("new")).alias("modified"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return incremental(now, state).select("uri", "action")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def session_last_turns(spark, sf_dir):
    r = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("r", r).where("r <= 6").select("conv_id", "turn", "role")


RESAMPLES = 500
BOOT = f""", t AS (SELECT arm, task, avg(score) AS m, ('0x' || substr(md5(task::VARCHAR), 1, 8))::BIGINT % 2147483647 AS i FROM scores GROUP BY 1, 2),
x AS (SELECT arm, m, i + 1 AS i, b + 1 AS b, ((b + 1) * 1103515245 + (i + 1) * 12345 + 7) % 2147483647 AS x FROM t, range({RESAMPLES}) r(b)),
y AS (SELECT *, (x * x + i * 69621) % 2147483647 AS y FROM x), z AS (SELECT *, (y * y + b * 48271) % 2147483647 AS z FROM y), u AS (SELECT arm, b, m, (z * z + x) % 2147483647 AS u FROM z),
w AS (SELECT arm, b, m, {" + ".join(f"(u >= {c})::INT" for c in analytics.COPIES)} AS w FROM u), s AS (SELECT arm, b, sum(w * m) / sum(w) AS m FROM w GROUP BY 1, 2 HAVING sum(w) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY m, b) - 1 AS r, count(*) OVER (PARTITION BY arm) AS n FROM s)
SELECT arm, round((SELECT avg(m) FROM t WHERE t.arm = k.arm), 5) AS mean, round(max(m) FILTER (WHERE r = floor(n * 0.025::DOUBLE)), 5) AS low, round(max(m) FILTER (WHERE r = floor(n * 0.975::DOUBLE)), 5) AS high"""
SCORES = "WITH scores AS (SELECT event_type AS arm, user_id AS task, value AS score FROM events)"


def _scores(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), F.col("user_id").alias("task"), F.col("value").alias("score"))


@query(SCORES + BOOT + " FROM k GROUP BY arm")
def bootstrap_ci(spark, sf_dir):
    out = analytics.bootstrap(_scores(spark, sf_dir), RESAMPLES)
    return out.select("arm", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


@query("""WITH base AS (SELECT event_type AS arm, user_id AS task, avg(value) AS m FROM events GROUP BY 1, 2),
scores AS (SELECT 'click - error' AS arm, a.task, a.m - b.m AS score FROM base a JOIN base b ON b.task = a.task AND a.arm = 'click' AND b.arm = 'error')"""
       + BOOT + ", max(m) FILTER (WHERE r = floor(n * 0.025::DOUBLE)) > 0 OR max(m) FILTER (WHERE r = floor(n * 0.975::DOUBLE)) < 0 AS significant FROM k GROUP BY arm")
def paired_lift(spark, sf_dir):
    out = analytics.paired_lift(_scores(spark, sf_dir), "click", "error", RESAMPLES)
    return out.select("arm", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")], "significant")


@query("""WITH u AS (SELECT user_id, min(ts) AS at FROM events GROUP BY 1), s AS (SELECT doc_id, quality, toxic FROM labels)
SELECT toxic, quality, count(*) AS n, count(u.user_id) AS n_users FROM s LEFT JOIN u ON u.user_id = s.doc_id GROUP BY 1, 2""")
def feedback_labels(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("at"))
    s = table(spark, sf_dir, "labels")
    return s.join(u, s["doc_id"] == u["user_id"], "left").groupBy("toxic", "quality").agg(F.count("*").alias("n"), F.count("user_id").alias("n_users"))


@query("""WITH c AS (SELECT event_id % 200 AS node_id, user_id AS agent_id, ts AS t0 FROM events WHERE event_type = 'click'),
f AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY t0, agent_id) AS r FROM c WHERE node_id % 3 <> 0)
SELECT node_id, agent_id FROM f WHERE r = 1""")
def lease_claims(spark, sf_dir):
    from loomspark.operators.memory import claim_leases

    c = table(spark, sf_dir, "events").where("event_type = 'click'").select((F.col("event_id") % 200).alias("node_id"), F.col("user_id").alias("agent_id"), F.col("ts").alias("at"))
    now = F.lit("2024-02-01").cast("timestamp")
    held = c.where("node_id % 3 = 0").select("node_id", F.lit("2024-02-02").cast("timestamp").alias("until")).distinct()
    return claim_leases(c, held, now).select("node_id", "agent_id")


@query("SELECT user_id AS agent_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY")
def presence(spark, sf_dir):
    from loomspark.streaming.jobs import active

    return active(table(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), "ts"), F.lit("2024-01-30").cast("timestamp"), 86_400)
