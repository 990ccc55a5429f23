"""Structured Streaming over key and event tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankweave.sources.shared import shared_dir


def stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The Parquet files below path, or matching it, as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_updates(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """What a streaming aggregation over keys says once all present input is read.

    Each batch's changed groups are written to a folder of its number, so a batch that is run again replaces itself;
    of a group's rows the one of the last batch holds. Groups not changed in a batch are not written again."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, what)
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    running = df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    running.awaitTermination()
    others = [c for c in df.columns if c not in keys]
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__row")).select(*keys, "__row.*")


def tumbling(events: DataFrame, width: str, by: str, late: str | None = None) -> DataFrame:
    """Rows and cents of value per window of event time.

    Without a delay every row counts, in whatever order files come; the state is a row for each window and `by`. With one, Spark
    forgets windows that are over by so much and drops later rows of them: for endless streams in time order only."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    counted = timed.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return counted.select(F.unix_micros("w.start").alias("begin"), by, "n", "cents")


def last_writes(changes: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """Per key the value of the greatest seq, and how many writes there were: the state of a store under upserts."""
    return changes.groupBy(F.col(key).alias("key")).agg(F.max_by(value, seq).alias("value"), F.count("*").alias("writes"))


def sliding(events: DataFrame, width: str, step: str, by: str, late: str | None = None) -> DataFrame:
    """Rows per window of event time that begins every `step`: each row counts in width / step windows. late: see tumbling."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy(F.window("ts", width, step).alias("w"), by).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("begin"), by, "n")


def write_heat(ops: DataFrame, key: str, write: str, seq: str, weight: float = 0.1, hot: float = 0.5, cool: float = 0.25) -> DataFrame:
    """Per key after each batch: ops, heat, is_hot and flips. heat is a moving average of whether an operation writes (the boolean column
    `write`), each new one with `weight`; a key turns hot above `hot` and cool again only below `cool`.

    Operations of a key act in order of seq within a batch, so batches must come in that order too. The state is a row a key; a key's
    rows of one batch are sorted in one task, and files_per_batch of stream() bounds a batch."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, heat, is_hot, flips = state.get if state.exists else (0, 0.0, False, 0)
        for w in pd.concat(list(batches)).sort_values("seq")["w"].tolist():
            heat = heat * (1 - weight) + weight * bool(w)
            now = heat >= cool if is_hot else heat > hot
            n, flips, is_hot = n + 1, flips + (now != is_hot), now
        state.update((n, heat, is_hot, flips))
        yield pd.DataFrame({"key": [k[0]], "ops": [n], "heat": [heat], "is_hot": [is_hot], "flips": [flips]})

    rows = ops.select(F.col(key).cast("long").alias("key"), F.col(write).alias("w"), F.col(seq).cast("long").alias("seq"))
    shape = "n long, heat double, is_hot boolean, flips long"
    return rows.groupBy("key").applyInPandasWithState(step, "key long, ops long, heat double, is_hot boolean, flips long", shape, "update", GroupStateTimeout.NoTimeout)
