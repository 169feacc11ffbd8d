"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes its records, one gzip member each, to a new file of its own in a
folder that all executors see and hands out an index row per record.  Only index
rows of tasks that ended well are kept, so the file of a lost task is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ident, lean, slices, stored

ARCHIVE_BYTES = 256 << 20
GAP_BYTES, RUN_BYTES = 64 << 10, 4 << 20
#: Bytes of records that one task reads, about.
READER_BYTES = 8 << 20
_INDEX = "file string, offset bigint, length bigint, id bigint, url string, digest string, record_type string, refers_to bigint"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the file system that Spark takes it for, so that executors and driver mean the same."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def _filesystem(folder: str):
    """Store and path of a qualified folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _plain(url: str) -> str:
    """A URL fit for a header line: control characters and spaces by their code."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record(id: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n", digest


def archive(folder: str, date: str):
    """Write the records of a partition and hand out their index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        out, name, at = None, "", 0
        try:
            for b in slices(batches, "html"):
                rows = []
                for id, url, html, first in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "refers_to"))):
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    text, digest = _record(id, url, html.encode(), first, date)
                    packed = gzip.compress(text, 4, mtime=0)
                    out.write(packed)
                    rows.append((name, at, len(packed), id, url, digest, "response" if first is None else "revisit", first))
                    at += len(packed)
                yield pa.record_batch(
                    [pa.array(v, t) for v, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3, pa.int64()))],
                    ["file", "offset", "length", "id", "url", "digest", "record_type", "refers_to"],
                )
        finally:
            if out is not None:
                out.close()

    return run


def write_warc(
    pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write a record per page to ``folder`` and return the index.

    Of equal payloads of ``least`` bytes or more, the row with the smallest id is a
    response and the others revisit it; smaller ones are all responses.  Rows that
    repeat the smallest id of a payload are responses too.  A null payload is empty, a
    null id counts as the smallest bigint, a null URL has no header line.  The index has
    ``file``, ``offset``, ``length``, ``id``, ``url``, ``digest``, ``record_type`` and
    ``refers_to``.
    """
    folder = qualified(pages.sparkSession, folder)
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    rows = lean(pages).select(
        ident(id_col).alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("html")
    ).withColumn("sha", F.unhex(F.sha1("html")))
    groups = rows.filter(F.octet_length("html") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1").select("sha", "first"), "payloads")
    typed = rows.join(groups, "sha", "left").select("id", "url", "html", F.when(F.col("first") < F.col("id"), F.col("first")).alias("refers_to"))
    return stored(typed.mapInArrow(archive(folder, date), _INDEX), "index")


def _headers(text: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:] if ": " in line)


def _page(urn: str | None) -> int | None:
    return None if urn is None else int(urn[len("<urn:page:") : -1])


def fetch(folder: str, payload: bool):
    """Read the records of sorted index rows: near ranges of a file by one read."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        name, run = None, []
        for b in batches:
            for file, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if run and (file != name or at > run[-1][0] + run[-1][1] + GAP_BYTES or at + n - run[0][0] > RUN_BYTES):
                    yield name, run
                    run = []
                name = file
                run.append((at, n))
        if run:
            yield name, run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        source, opened = None, None
        try:
            for name, ranges in runs(batches):
                if name != opened:
                    if source is not None:
                        source.close()
                    source, opened = store.open_input_file(f"{root}/{name}"), name
                start, end = ranges[0][0], max(at + n for at, n in ranges)
                held = source.read_at(end - start, start)
                rows = []
                for at, n in ranges:
                    head, _, block = gzip.decompress(held[at - start : at - start + n]).partition(b"\r\n\r\n")
                    head = _headers(head)
                    http, _, body = block[: int(head["Content-Length"])].partition(b"\r\n\r\n")
                    kind, size, digest = head["WARC-Type"], int(_headers(http)["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"{name} at {at}: the payload is not what its digest says")
                    rows.append((
                        _page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, _page(head.get("WARC-Refers-To")), size, digest,
                        body if payload and kind == "response" else None,
                    ))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.record_batch(
                    [pa.array(v, t) for v, t in zip(zip(*rows), kinds)],
                    ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"],
                )
        finally:
            if source is not None:
                source.close()

    return run


def read_warc(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records that the rows of ``index`` name; filter it to read a selection.

    Returns ``id``, ``url``, ``record_type``, ``refers_to``, ``payload_bytes`` and
    ``payload_digest`` (of the full payload, for revisits too) and ``payload`` (responses,
    where asked for).  A response whose payload does not have its digest raises.  ``url``
    is as in the header: control characters and spaces by their code.

    The records' bytes, not the index rows, set the number of ranges.
    """
    folder = qualified(index.sparkSession, folder)
    tasks = 1 + (index.agg(F.sum("length")).first()[0] or 0) // READER_BYTES
    ordered = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(
        fetch(folder, payload),
        "id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary",
    )
