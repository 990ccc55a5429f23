"""Profiles of a key sequence: gaps, knots, quantile keys and integer widths."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import bit_width, sigmoid, varint_length
from rankweave.operators import keys
from rankweave.sources.tables import ranked_events, ranked_orders

from .registry import _E, _R, _gaps, query

LEVELS = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)  # percent


@query(f"WITH {_R}, n AS (SELECT count(*) AS n FROM r), l AS (SELECT unnest({list(LEVELS)}) AS level) SELECT cast(level AS INTEGER) AS level, rank, key FROM l, n JOIN r ON r.rank = level * (n - 1) // 100")
def quantile_keys(spark, sf):
    r = ranked_orders(spark, sf)
    levels = spark.createDataFrame([(v,) for v in LEVELS], "level int").crossJoin(r.agg(F.count("*").alias("n")))
    return r.join(F.broadcast(levels.select("level", F.expr("level * (n - 1) div 100").alias("rank"))), "rank").select("level", "rank", "key")


@query(f"""WITH {_E}, d AS (SELECT key - lag(key) OVER (ORDER BY key) AS gap FROM re), m AS (SELECT median(gap) AS mid, sum(gap) AS total FROM d),
t AS (SELECT sum(gap) AS top FROM (SELECT gap FROM d WHERE gap IS NOT NULL ORDER BY gap DESC LIMIT 16))
SELECT round(max(gap) / any_value(mid), 6) AS greatest_to_median, round(any_value(top) / any_value(total), 6) AS top_share, count(*) FILTER (gap > 10 * mid) AS wide FROM d, m, t""")
def gap_dominance(spark, sf):
    """How far few gaps make up the key range; the 16 widest are the measure's parameter."""
    gaps = _gaps(spark, sf).select("gap")
    mid = keys.order_statistics(gaps, [], "gap", {"median": 0.5}).select(F.col("median").alias("mid")).crossJoin(F.broadcast(gaps.agg(F.sum("gap").alias("total"))))  # one row each
    top = gaps.orderBy(F.desc("gap")).limit(16).agg(F.sum("gap").alias("top"))
    both = gaps.crossJoin(F.broadcast(mid.crossJoin(top)))  # one row
    return both.agg(
        F.round(F.max("gap") / F.first("mid"), 6).alias("greatest_to_median"), F.round(F.first("top") / F.first("total"), 6).alias("top_share"), F.count(F.when(F.col("gap") > 10 * F.col("mid"), 1)).alias("wide"),
    )


@query(f"""WITH {_E}, b AS (SELECT rank // 128 AS block, key, rank % 128 AS place FROM re), s AS (SELECT *, min(key) OVER w AS lo, max(key) OVER w AS hi, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY block))
SELECT block, any_value(n) AS n, round(max(abs(CASE WHEN hi > lo THEN (n - 1) * (cast(key - lo AS DOUBLE) / (hi - lo)) ELSE 0 END - place)), 6) AS max_error FROM s GROUP BY block""")
def knot_errors(spark, sf):
    """Rank error of straight lines between knots of equal counts."""
    b = ranked_events(spark, sf).select(F.expr("rank div 128").alias("block"), "key", (F.col("rank") % 128).alias("at"))
    ends = b.groupBy("block").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
    line = F.when(F.col("hi") > F.col("lo"), (F.col("n") - 1) * ((F.col("key") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")))).otherwise(0)
    return b.join(ends, "block").groupBy("block").agg(F.first("n").alias("n"), F.round(F.max(F.abs(line - F.col("at"))), 6).alias("max_error"))


@query(f"""WITH {_R}, w AS (SELECT CASE WHEN key = 0 THEN 0 ELSE length(bin(key)) END AS bits FROM r)
SELECT cast(bits AS INTEGER) AS bits, cast(greatest(1, ceil(bits / 7)) AS INTEGER) AS varint_bytes, count(*) AS n, round(1 / (1 + exp(-(bits - 20.0) / 4)), 6) AS weight FROM w GROUP BY bits""")
def width_histogram(spark, sf):
    k = F.col("key")
    rows = ranked_orders(spark, sf).select(bit_width(k).cast("int").alias("bits"), varint_length(k).alias("varint_bytes")).groupBy("bits", "varint_bytes").agg(F.count("*").alias("n"))
    return rows.select("*", F.round(sigmoid((F.col("bits") - 20.0) / 4), 6).alias("weight"))
