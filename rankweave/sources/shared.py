"""Tables in folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Without that setting a session on one machine (master local or local[n]) uses a folder below /tmp; any other raises ValueError,
    as its executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/rankweave-shared"
    return f"{base.rstrip('/')}/rankweave/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder and read again: later plans start from these files,
    so a lost executor costs no more than one read of them."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 500_000, numbers=None) -> DataFrame:
    """df for a join: broadcast if its rows hold at most `most` (counted) fixed-size rows or, with numbers, that sum of this
    column (of the lengths of its lists), else left to be shuffled. The bound holds in bytes too, some 16 to 48 each."""
    held = df.count() if numbers is None else df.agg(F.sum(numbers)).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def forget(*frames: DataFrame) -> None:
    """Delete what written() wrote for frames that nothing reads any longer."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        hadoop = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/rankweave/" in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(hadoop).delete(path, True)
