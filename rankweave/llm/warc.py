"""WARC archives: written as one gzip stream, then normalised to one gzip member per record with an offset index.

1. Every page becomes a record: of pages with equal payloads the one of the smallest id is a response, the others
   revisit it. Each task writes its records as one monolithic gzip file.
2. The normaliser inflates each whole-file stream once, in blocks, cuts it into records by their Content-Length and
   writes each as a gzip member of its own, with a sidecar index of offsets and lengths.
3. Records are read back by the index, each from its own offset; tasks share out the index, not the files.

Files are written under a temporary name and renamed, by names that depend on the partition alone, so that a task
that runs again after a lost executor replaces what it wrote.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small, written

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def _place(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, key: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; key makes its id. A revisit has the HTTP head alone, whose Content-Length tells the payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:rankweave:{key}>",
        f"WARC-Target-URI: {''.join(c if ' ' < c < chr(127) else f'%{ord(c):X}' for c in url or '')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[6:6] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:rankweave:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's WARC head, its HTTP head and what follows it."""
    warc, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in warc.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def inflate_records(source) -> Iterator[bytes]:
    """Records of a gzip stream (any number of members), inflated once and in blocks; one record is held at a time."""
    inflater, buffer, need = zlib.decompressobj(31), bytearray(), None
    while True:
        block = source.read(1 << 18)
        data = bytes(block)
        while data:
            buffer += inflater.decompress(data)
            data = inflater.unused_data if inflater.eof else b""
            if inflater.eof:
                inflater = zlib.decompressobj(31)
            while True:
                if need is None:
                    end = buffer.find(b"\r\n\r\n")
                    if end < 0:
                        break
                    head = bytes(buffer[:end]).decode()
                    need = end + 4 + int(next(x for x in head.split("\r\n") if x.lower().startswith("content-length:")).split(":")[1]) + 4
                if len(buffer) < need:
                    break
                yield bytes(buffer[:need])
                del buffer[:need]
                need = None
        if not block:
            break
    if buffer:
        raise ValueError("the stream ends within a record")


def _write(path: str, blocks: Iterator[bytes]) -> None:
    """Write blocks under a temporary name of this attempt, then rename."""
    files, at = _place(path)
    mine = f"{at}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(mine) as out:
        for b in blocks:
            out.write(b)
    files.move(mine, at)


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write df's pages as monolithic gzip archives to folder; one row per archive: path, records.

    Payloads are the texts in UTF-8, null as empty. Of equal payloads of at least least_bytes bytes the page of the smallest id
    is the response (of repeated rows with that id, all are); pages with a null id are responses, and are the reference of none."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("sha", F.unhex(F.sha1("payload")))
    # Digests of several pages only, each counted per task before the shuffle; up to a bounded number of them payloads stay
    # where they are, beyond it they go to their digests, and the adaptive skew join splits one with very many pages.
    several = pages.filter(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = pages.join(small(written(several.select("sha", "first"), "repeated")), "sha", "left")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done = TaskContext.get().partitionId(), 0

        def blocks() -> Iterator[bytes]:
            nonlocal done
            deflater = zlib.compressobj(6, zlib.DEFLATED, 31)
            for pdf in batches:
                for page, url, payload, sha, to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["sha"], pdf["first"], strict=True):
                    page, to = (None if x != x or x is None else int(x) for x in (page, to))
                    revisit = to is not None and page is not None and to != page
                    digest = base64.b32encode(sha).decode()
                    yield deflater.compress(record(page, f"page:{page}" if page is not None else f"row:{part}:{done}", url, bytes(payload), len(payload), digest, to if revisit else None, revisit))
                    done += 1
            yield deflater.flush()

        path = f"{folder}/part-{part:06d}.warc.gz"
        _write(path, blocks())
        yield pd.DataFrame({"path": [path], "records": [done]})

    return marked.select("page_id", "url", "payload", "sha", "first").mapInPandas(put, "path string, records long")


def normalise(archives: DataFrame) -> DataFrame:
    """For each archive (path): rewrite it beside itself with every record as a gzip member of its own, and write the
    sidecar index (.idx: offset and length of each member, a line each). The index is returned too: path, offset, length."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                files, at = _place(path)
                to = path.replace("/part-", "/member-")
                index: list[tuple[int, int]] = []

                def members(files=files, at=at, index=index) -> Iterator[bytes]:
                    offset = 0
                    with files.open_input_stream(at, compression=None) as source:
                        for rec in inflate_records(source):
                            deflater = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = deflater.compress(rec) + deflater.flush()
                            index.append((offset, len(member)))
                            offset += len(member)
                            yield member

                _write(to, members())
                _write(f"{to}.idx", iter(["".join(f"{a} {b}\n" for a, b in index).encode()]))
                yield pd.DataFrame({"path": to, "offset": [a for a, _ in index], "length": [b for _, b in index]})

    return archives.select("path").mapInPandas(rewrite, "path string, offset long, length long")


def read_records(index: DataFrame) -> DataFrame:
    """The records at the index's places: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of a response the payload itself is measured and hashed again, and must agree with its head."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, part in pdf.groupby("path", sort=False):
                files, at = _place(path)
                with files.open_input_file(at) as source:
                    for offset, length in zip(part["offset"].tolist(), part["length"].tolist(), strict=True):
                        source.seek(offset)
                        rows.append(_row(zlib.decompress(source.read(length), 31)))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.select("path", "offset", "length").mapInPandas(get, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _row(data: bytes) -> tuple:
    warc, http, body = parse(data)
    digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
    if kind == "response" and (payload_digest(body) != digest or len(body) != int(http["Content-Length"])):
        raise ValueError(f"{warc['WARC-Record-ID']}: the payload does not agree with its head")
    to = warc.get("WARC-Refers-To", "").rpartition(":")[2].rstrip(">")
    return int(warc["X-Page-Id"]) if warc["X-Page-Id"] else None, int(http["Content-Length"]), digest, kind, int(to) if to else None


def archive_pages(df: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write, normalise, read back: a row per page. folder: shared by driver and executors; below spark.checkpoint.dir if not given."""
    folder = folder or shared_dir(df.sparkSession, "warc")
    archives = written(write_archives(df, folder, **columns), "archives")
    n = archives.count()
    index = written(normalise(archives.repartition(max(1, n))), "index")
    # the index is dealt by place, so that a task reads neighbouring members of few files
    parts = max(1, n)
    return read_records(index.repartitionByRange(parts, "path", "offset"))


__all__ = ["archive_pages", "inflate_records", "normalise", "parse", "payload_digest", "read_records", "record", "write_archives"]
