"""Binary key files, and a stream of several batches."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from rankweave import streaming
from rankweave.sources.binary_keys import read_keys


@pytest.mark.parametrize("width, code", [(8, "Q"), (4, "I")])
def test_read_keys(spark, tmp_path, width, code):
    keys = [0, 5, 5, 2 ** (8 * width) - 1]
    body = struct.pack(f"<4{code}", *keys)
    (tmp_path / "counted").write_bytes(struct.pack("<Q", 4) + body)
    (tmp_path / "raw").write_bytes(body)
    (tmp_path / "wrong").write_bytes(struct.pack("<Q", 5) + body)
    for name in ("counted", "raw"):
        got = read_keys(spark, str(tmp_path / name), width, counted=name == "counted").orderBy("pos").collect()
        assert [(r.pos, int(r.key)) for r in got] == list(enumerate(keys))
    with pytest.raises(ValueError):
        read_keys(spark, str(tmp_path / "wrong"), width)


def test_stream_in_batches_equals_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), (F.col("id") * 3).alias("v"))
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    out = streaming.last_writes(streaming.stream(spark, str(tmp_path / "in"), files_per_batch=2), "k", "v", "seq")
    got = {(r.key, r.value, r.writes) for r in streaming.latest_updates(out, ["key"], "test").collect()}
    assert got == {(r.key, r.value, r.writes) for r in streaming.last_writes(rows, "k", "v", "seq").collect()}


def test_tumbling_counts_rows_of_late_files(spark, tmp_path):
    from rankweave.plans.registry import QUERIES
    from rankweave.plans.streams import stream_tumbling_counts

    assert QUERIES["stream_tumbling_counts"] is stream_tumbling_counts
    rows = spark.range(700).selectExpr("timestamp_seconds(1704067200 + id * 1800) ts", "'a' event_type", "id * 0.25D value")
    rows.repartitionByRange(140, F.desc("ts")).write.parquet(str(tmp_path / "events.parquet"))
    for k, f in enumerate(sorted((tmp_path / "events.parquet").glob("part-*"))):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))  # the third batch, the first whose late rows a watermark would drop, is of the earliest hours
    got = {(r.begin, r.n, r.cents) for r in stream_tumbling_counts(spark, str(tmp_path)).collect()}
    assert got == {((1704067200 + h * 3600) * 10**6, 2, 25 * (4 * h + 1)) for h in range(350)}
