"""Key files, logs, ledgers, results, weights and digests: written and read again."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rankweave.sources import records
from rankweave.sources.binary_keys import read_keys, write_keys, write_sorted_distinct
from rankweave.sources.shared import shared_dir


@pytest.mark.parametrize("width", [4, 8])
def test_written_keys_are_read_again(spark, tmp_path, width):
    top = 2 ** (8 * width) - 1
    df = spark.createDataFrame([(str(k),) for k in [5, 3, 3, 0, top, *range(100, 400)]], "key string").select(F.col("key").cast("decimal(20,0)").alias("key"))
    said = write_keys(df, str(tmp_path / "all"), width).collect()
    assert sum(r["keys"] for r in said) == 305
    got = [int(r.key) for r in read_keys(spark, str(tmp_path / "all"), width).orderBy("pos").collect()]
    assert got == sorted([5, 3, 3, 0, top, *range(100, 400)])
    assert read_keys(spark, str(tmp_path / "all"), width, limit=7).count() == 7 and read_keys(spark, str(tmp_path / "all"), width, limit=0).count() == 0
    read_keys(spark, str(tmp_path / "all"), width, ascending="sorted")
    with pytest.raises(ValueError):
        read_keys(spark, str(tmp_path / "all"), width, ascending="distinct")
    write_sorted_distinct(df, str(tmp_path / "distinct"), width)
    assert read_keys(spark, str(tmp_path / "distinct"), width, ascending="distinct").count() == 304
    write_keys(df.filter("false"), str(tmp_path / "none"), width)
    assert read_keys(spark, str(tmp_path / "none"), width).count() == 0


def test_files_that_are_not_whole(spark, tmp_path):
    (tmp_path / "cut").write_bytes(b"\1" * 13)
    for counted in (True, False):
        with pytest.raises(ValueError):
            read_keys(spark, str(tmp_path / "cut"), 8, counted)
    with pytest.raises(ValueError):
        read_keys(spark, str(tmp_path / "cut"), 5)


def test_log_of_a_run(spark, tmp_path):
    (tmp_path / "run.log").write_text("## setup\nkind=read\n# note=none\nThroughput = 1.5e3\nno field\n## run\nThroughput = 1750.5\nsuccess_read: 99\ntrace_chunk: 0 10\ntrace_chunk: 1 12.5\ntrace_chunk: 1 13\na = b = c\n")
    lines = records.text_lines(spark, str(tmp_path / "run.log"))
    r = records.log_fields(lines, ["file"]).first()
    assert (r.throughput, r.success_reads, r.warmup, r["index"]) == (1750.5, 99, None, None)
    assert {(x.k, x.ns) for x in records.chunk_times(lines, ["file"]).collect()} == {(0, 10.0), (1, 13.0)}
    assert {(x.name, x.value) for x in records.key_values(lines, ["file"]).collect()} == {("kind", "read"), ("Throughput", "1750.5"), ("a", "b = c")}
    assert {x.section: x.n for x in records.sections(lines, ["file"]).groupBy("section").agg(F.count("*").alias("n")).collect()} == {"setup": 4, "run": 7}


def test_ledger_results_and_plan(spark, tmp_path):
    (tmp_path / "runs.tsv").write_text("repeat\tdataset\tindex\texit_code\n1\tfb\tpgm\t1\n1\tfb\talex\t0\n1\tfb\tpgm\t0\n")
    got = {(r.dataset, r["index"], r.exit_code) for r in records.read_ledger(spark, str(tmp_path / "runs.tsv"), ["repeat", "dataset", "index"]).collect()}
    assert got == {("fb", "pgm", "0"), ("fb", "alex", "0")}
    path = str(tmp_path / "results")
    schema = "dataset string, seed long, ops struct<n: long>"
    for rows in ([("fb", 1, (5,))], [("fb", None, (6,))]):
        records.append_results(spark.createDataFrame(rows, schema), path)
    (tmp_path / "results" / "cut.json").write_text('{"dataset": "osm", "se\n')
    done = records.read_results(spark, path, schema)
    assert {(r.dataset, r.seed, r.ops.n) for r in done.collect()} == {("fb", 1, 5), ("fb", None, 6)}
    planned = spark.createDataFrame([("fb", 1), ("fb", None), ("osm", 1)], "dataset string, seed long")
    assert [tuple(r) for r in records.still_to_run(planned, done, ["dataset", "seed"]).collect()] == [("osm", 1)]


def test_weights(spark):
    text = "2 2 2\n0 1\n2 2\n0.5\t0\n0.25\t1\n2 2\n1 0\n0 1\n"
    w = records.FlowWeights.parse(text)
    z = spark.createDataFrame([(2.75,), (math.nan,)], "key double").select(w.column(F.col("key")).alias("z")).collect()
    assert abs(z[0].z - (math.tanh(2.75 * 0.5 + 0.75 * 0.25) + math.tanh(0.75))) < 1e-12 and z[1].z == 0
    assert records.FlowWeights.parse(w.text()).layers == w.layers
    for bad in (text[:-3], text + "1", text.replace("0 1\n2 2", "0 0\n2 2", 1), text.replace("2 2\n0.5", "3 2\n0.5"), text.replace("0.25", "nan")):
        with pytest.raises(ValueError):
            records.FlowWeights.parse(bad)


def test_traces_summaries_and_digests(spark, tmp_path):
    ops = spark.createDataFrame([("read", 5, 1, 0), ("scan", 7, 2, 16)], "operation string, key long, value long, length int")
    records.write_trace(ops, str(tmp_path / "trace"))
    assert sorted((r.operation, int(r.key), int(r.value), r.length) for r in records.read_trace(spark, str(tmp_path / "trace")).collect()) == [("read", 5, 1, 0), ("scan", 7, 2, 16)]
    records.write_summary(ops, str(tmp_path / "summary"))
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).columns == ops.columns
    (tmp_path / "x.bin").write_bytes(b"abc")
    r = records.manifest(spark, str(tmp_path / "x.bin")).first()
    assert (r.bytes, r.sha256, r.md5) == (3, hashlib.sha256(b"abc").hexdigest(), hashlib.md5(b"abc").hexdigest()) and r.changed.endswith("Z")


def test_shared_folder_needs_a_setting_on_a_cluster(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: Elsewhere.conf)

    with pytest.raises(ValueError):
        shared_dir(Elsewhere, "x")
    assert "/rankweave/x-" in shared_dir(spark, "x")
