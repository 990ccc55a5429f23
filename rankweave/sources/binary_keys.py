"""Files of little-endian integer keys, with or without a count before them: read in splits, written a file per partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankweave.operators.keys import require_ascending
from rankweave.sources.shared import written

HEADER = 8  # bytes of the count
SPLIT = 64 << 20  # bytes of a split


def _place(path: str):
    """The file system of a path or URI that pyarrow knows, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Split(InputPartition):
    def __init__(self, path: str, offset: int, keys: int, first: int):
        self.path, self.offset, self.keys, self.first = path, offset, keys, first


class KeyFiles(DataSource):
    """spark.read.format("key_files"): pos and key of the files at `path` (a file, or a folder of .keys files in order of name).

    Options: path, width (8 or 4 bytes), counted (true: an 8-byte count comes first in each file), limit (the first so many keys)."""

    @classmethod
    def name(cls) -> str:
        return "key_files"

    def schema(self) -> str:
        return "pos long, key decimal(20,0)"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options.get("width", 8))
        self.counted, self.limit = options.get("counted", "true").lower() == "true", int(options.get("limit", -1))
        if self.width not in (4, 8):
            raise ValueError("width must be 4 or 8")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = _place(self.path)
        info = files.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [info] if info.is_file else sorted((f for f in files.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".keys")), key=lambda f: f.base_name)
        out: list[InputPartition] = []
        pos = 0
        for f in names:
            head = HEADER if self.counted else 0
            if (f.size - head) % self.width or f.size < head:
                raise ValueError(f"{f.path} ends within a key")
            n = (f.size - head) // self.width
            if self.counted:
                with files.open_input_file(f.path) as source:
                    said = int.from_bytes(source.read(HEADER), "little")
                if said != n:
                    raise ValueError(f"{f.path} says {said} keys and has {n}")
            take = n if self.limit < 0 else max(0, min(n, self.limit - pos))
            step = SPLIT // self.width
            out += [_Split(f.path, head + k * self.width, min(step, take - k), pos + k) for k in range(0, take, step)]
            pos += n
        return out or [_Split("", 0, 0, 0)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        files, _ = _place(self.path)
        kind, done = np.dtype(f"<u{self.width}"), 0
        if not partition.keys:
            return
        with files.open_input_file(partition.path) as source:
            source.seek(partition.offset)
            while done < partition.keys:
                n = min(1 << 18, partition.keys - done)
                keys = np.frombuffer(source.read(n * self.width), kind)
                pos = np.arange(partition.first + done, partition.first + done + n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(keys.astype(np.uint64)).cast(pa.decimal128(20, 0))], ["pos", "key"])
                done += n


def read_keys(spark: SparkSession, path: str, width: int = 8, counted: bool = True, limit: int | None = None, ascending: str | None = None) -> DataFrame:
    """pos (long, from 0) and key (decimal(20,0)) of a file of width-byte keys, or of a folder of such .keys files; counted: an 8-byte count comes first.

    The files are cut into splits at whole keys, so that size is no limit for a task. An empty file has no rows; a count that differs
    from the number of keys raises ValueError, and so does a file that ends within a key. limit: a prefix of the keys.
    ascending: 'sorted' or 'distinct' raise ValueError unless keys don't descend, or ascend strictly. Paths are those of pyarrow's file systems."""
    spark.dataSource.register(KeyFiles)
    reader = spark.read.format("key_files").option("path", path).option("width", width).option("counted", str(counted).lower())
    _Reader({"path": path, "width": str(width), "counted": str(counted).lower()}).partitions()  # what is wrong shows before the job
    df = (reader.option("limit", limit) if limit is not None else reader).load()
    if ascending is not None:
        if ascending not in ("sorted", "distinct"):
            raise ValueError("ascending must be sorted or distinct")
        require_ascending(df, "pos", distinct=ascending == "distinct")
    return df


def write_keys(df: DataFrame, folder: str, width: int = 8, counted: bool = True, key: str = "key") -> DataFrame:
    """Write df's keys, sorted, as .keys files of a folder, one per partition of the key order; path and keys of each are returned.

    Files are written under a temporary name and renamed, by names that depend on the partition alone, so that a task that runs
    again replaces what it wrote. Keys beyond the width raise OverflowError."""
    from pyspark import TaskContext

    most = (1 << (8 * width)) - 1

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = _place(folder)
        context = TaskContext.get()
        name = f"{at.rstrip('/')}/part-{context.partitionId():06d}.keys"
        mine, body, n = f"{name}.{context.taskAttemptId()}.tmp", f"{name}.{context.taskAttemptId()}.body", 0
        files.create_dir(at, recursive=True)
        with files.open_output_stream(body) as out:
            for pdf in batches:
                keys = [int(k) for k in pdf["key"]]
                if keys and not 0 <= min(keys) <= max(keys) <= most:
                    raise OverflowError(f"a key does not fit {width} bytes")
                out.write(np.array(keys, np.uint64).astype(f"<u{width}").tobytes())
                n += len(keys)
        with files.open_output_stream(mine) as out, files.open_input_stream(body) as source:
            if counted:
                out.write(n.to_bytes(HEADER, "little"))
            while block := source.read(1 << 20):
                out.write(block)
        files.delete_file(body)
        files.move(mine, name)
        yield pd.DataFrame({"path": [name], "keys": [n]})

    files, at = _place(folder)
    files.create_dir(at, recursive=True)  # there even if no key is
    rows = df.select(F.col(key).cast("decimal(20,0)").alias("key"))
    return written(rows.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(put, "path string, keys long"), "key-files")


def write_sorted_distinct(df: DataFrame, folder: str, width: int = 8, key: str = "key") -> DataFrame:
    """The sorted copy without repeated keys that a sequence out of order needs before it is measured."""
    return write_keys(df.select(F.col(key).alias("key")).distinct(), folder, width)
