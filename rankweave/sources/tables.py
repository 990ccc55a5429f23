"""Key sequences taken from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.keys import canonical, ranked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key: total price in cents; value and pos: the order's number. Has equal keys."""
    return table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("pos"))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key: event time in microseconds; value and pos: the event's number. The session's time zone should be UTC."""
    return table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("pos"))


def order_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(order_cents(spark, sf_dir))


def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(order_store(spark, sf_dir))


def ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(canonical(event_times(spark, sf_dir)))
