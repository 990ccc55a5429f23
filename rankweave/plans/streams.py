"""Streaming queries over the events, and sessions, phases and settling of the same events in batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankweave import streaming
from rankweave.operators import keys
from rankweave.sources.tables import table

from .registry import query


@query("SELECT epoch_us(ts) // 3600000000 * 3600000000 AS begin, event_type, count(*) AS n, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, sf):
    rows = streaming.tumbling(streaming.stream(spark, f"{sf}/events.parquet*"), "1 hour", "event_type")
    return streaming.latest_updates(rows, ["begin", "event_type"], "tumbling")


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value, count(*) AS writes FROM events GROUP BY user_id")
def stream_last_writes(spark, sf):
    rows = streaming.last_writes(streaming.stream(spark, f"{sf}/events.parquet*"), "user_id", "event_type", "event_id")
    return streaming.latest_updates(rows, ["key"], "last-writes")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS gap FROM events),
s AS (SELECT user_id, t, count(*) FILTER (gap > 86400000000) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session, count(*) AS n, min(t) AS begin, max(t) AS last FROM s GROUP BY ALL""")
def user_sessions(spark, sf):
    """Runs of a user's events with no pause of over a day."""
    w = Window.partitionBy("user_id").orderBy("t")
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("gap", F.col("t") - F.lag("t").over(w))
    s = e.withColumn("session", F.count(F.when(F.col("gap") > 86_400_000_000, 1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("t").alias("begin"), F.max("t").alias("last"))


_CHUNKS = "c AS (SELECT event_type, event_id // 100 AS chunk, median(value) AS m FROM events GROUP BY ALL), b AS (SELECT event_type, median(m) AS mid FROM c GROUP BY event_type)"


@query(f"""WITH {_CHUNKS}, k AS (SELECT c.event_type, chunk, CASE WHEN abs(m - mid) <= 0.25 * mid THEN 1 ELSE 0 END AS inside FROM c JOIN b USING (event_type)),
r AS (SELECT event_type, chunk, min(inside) OVER w AS run, count(*) OVER w AS seen FROM k WINDOW w AS (PARTITION BY event_type ORDER BY chunk ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT event_type, count(*) AS chunks, min(chunk) FILTER (run = 1 AND seen = 5) AS settled FROM r GROUP BY event_type""")
def settled_chunk(spark, sf):
    """The first of five chunks in a row whose median is within a quarter of the median chunk's."""
    c = table(spark, sf, "events").groupBy("event_type", F.expr("event_id div 100").alias("chunk")).agg(F.percentile("value", 0.5).alias("m"))
    b = c.groupBy("event_type").agg(F.percentile("m", 0.5).alias("mid"))
    w = Window.partitionBy("event_type").orderBy("chunk").rowsBetween(0, 4)
    k = c.join(b, "event_type").withColumn("inside", (F.abs(F.col("m") - F.col("mid")) <= 0.25 * F.col("mid")).cast("int"))
    r = k.select("event_type", "chunk", F.min("inside").over(w).alias("run"), F.count("*").over(w).alias("seen"))
    return r.groupBy("event_type").agg(F.count("*").alias("chunks"), F.min(F.when((F.col("run") == 1) & (F.col("seen") == 5), F.col("chunk"))).alias("settled"))


@query("""WITH m AS (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS mid FROM events)
SELECT event_type, round(1.4826 * median(abs(value - mid)) / any_value(mid), 6) AS spread FROM m GROUP BY event_type""")
def mad_spread(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    mid = keys.order_statistics(e, ["event_type"], "value", {"median": 0.5}).select("event_type", F.col("median").alias("mid"))  # a row per type
    away = e.join(mid, "event_type").select("event_type", "mid", F.abs(F.col("value") - F.col("mid")).alias("away"))
    return keys.order_statistics(away, ["event_type"], "away", {"median": 0.5}).join(mid, "event_type").select("event_type", F.round(1.4826 * F.col("median") / F.col("mid"), 6).alias("spread"))


@query("""SELECT begin, event_type, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(ts) // 3600000000 * 3600000000 - s * 3600000000 FOR s IN range(6)]) AS begin FROM events) GROUP BY ALL""")
def stream_sliding_counts(spark, sf):
    """Events per six hours, beginning every hour."""
    rows = streaming.sliding(streaming.stream(spark, f"{sf}/events.parquet*"), "6 hours", "1 hour", "event_type")
    return streaming.latest_updates(rows, ["begin", "event_type"], "sliding")


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 0.3 ELSE 0.0 END AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS j FROM events),
h AS (SELECT user_id, cast(1 AS BIGINT) AS j, cast(w AS DOUBLE) AS heat, w > 0.5 AS is_hot, CASE WHEN w > 0.5 THEN 1 ELSE 0 END AS flips FROM e WHERE j = 1
UNION ALL SELECT h.user_id, e.j, x.heat, y.now, h.flips + CASE WHEN y.now <> h.is_hot THEN 1 ELSE 0 END FROM h JOIN e ON e.user_id = h.user_id AND e.j = h.j + 1, LATERAL (SELECT h.heat * 0.7 + e.w AS heat) x, LATERAL (SELECT CASE WHEN h.is_hot THEN x.heat >= 0.25 ELSE x.heat > 0.5 END AS now) y)
SELECT user_id AS key, max(j) AS ops, round(arg_max(heat, j), 6) AS heat, arg_max(is_hot, j) AS is_hot, cast(arg_max(flips, j) AS BIGINT) AS flips FROM h GROUP BY user_id""")
def stream_write_heat(spark, sf):
    """Which users' writes (purchases and sign-ups) run hot, as state over the stream."""
    e = streaming.stream(spark, f"{sf}/events.parquet*").select("user_id", "event_id", F.col("event_type").isin("purchase", "signup").alias("write"))
    out = streaming.latest_updates(streaming.write_heat(e, "user_id", "write", "event_id", weight=0.3), ["key"], "heat")
    return out.select("key", "ops", F.round("heat", 6).alias("heat"), "is_hot", "flips")
