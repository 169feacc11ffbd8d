"""Whole lines of a byte range of a text file: plain, bgzip or gzip.

A plain file can be cut anywhere and a bgzip file at the borders of its blocks, so
one large file is read by many tasks; an ordinary gzip file is one task.  A range
has the lines behind its first line break up to the first line break at or behind
its end, so every line belongs to exactly one range.  A task has one or more ranges:
as many as Spark itself would let it read of the files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import InputPartition

READ_BYTES, BLOCK_BYTES = 2 << 20, 1 << 16
#: Bytes that are read first where only the rest of a line is wanted.
REST_BYTES = 1 << 12
_MAGIC = b"\x1f\x8b\x08\x04"


@dataclass
class Range(InputPartition):
    """Bytes ``lo`` to ``hi`` of a file, the ``no``-th range of it; ``first`` is the first file of its folder."""

    file: str
    no: int
    lo: int
    hi: int
    size: int
    first: str


@dataclass
class Task(InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: list[Range]


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files that Spark itself would read, in order; lists folders, reads nothing."""
    return sorted(spark.read.text(path).inputFiles())


def split_bytes(spark: SparkSession) -> int:
    """Bytes that one task reads by the session's setting."""
    said = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(said[-1:], 0)
    return int(said[:-1] if unit else said) << unit


def task_options(spark: SparkSession) -> dict[str, int]:
    """Most bytes of a task by the session's setting, and how many tasks run at a time."""
    return {"task": split_bytes(spark), "slots": spark.sparkContext.defaultParallelism}


def tasks(ranges: list[Range], options) -> list[Task]:
    """Neighbouring ranges to tasks, so that short ranges are not a task each."""
    total = sum(r.hi - r.lo for r in ranges)
    most = min(int(options["task"]), -(-total // max(1, int(options["slots"]))))
    out: list[Task] = []
    held = most
    for r in ranges:
        if held + r.hi - r.lo > most:
            out.append(Task([]))
            held = 0
        out[-1].ranges.append(r)
        held += r.hi - r.lo
    return out


def opened(uri: str):
    """The file for random access, and its size."""
    from urllib.parse import unquote

    from pyarrow import fs

    # names come as URIs, in which the local file system's are escaped
    if uri.startswith("file:"):
        store, path = fs.LocalFileSystem(), unquote(uri.removeprefix("file://").removeprefix("file:"))
    else:
        store, path = fs.FileSystem.from_uri(uri)
    file = store.open_input_file(path)
    return file, file.size()


def cut(files: list[str], most: int) -> list[Range]:
    """Ranges of at most ``most`` bytes."""
    firsts: dict[str, str] = {}
    out = []
    for f in files:
        file, size = opened(f)
        file.close()
        first = firsts.setdefault(f.rpartition("/")[0], f)
        out += [Range(f, no, lo, min(size, lo + most), size, first) for no, lo in enumerate(range(0, size, most))]
    return out


def _block(head: bytes) -> int:
    """Length of the bgzip block that begins with these bytes; 0 if none does."""
    if len(head) < 18 or not head.startswith(_MAGIC):
        return 0
    extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]]
    while len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == b"BC" and n == 2 and len(extra) >= 6:
            return struct.unpack("<H", extra[4:6])[0] + 1
        extra = extra[4 + n :]
    return 0


def _first_block(file, size: int, at: int) -> int:
    """Where the first block at or behind ``at`` begins: one that another block, or the end, follows."""
    if at == 0:
        return 0
    held = file.read_at(min(2 * BLOCK_BYTES + 64, size - at), at)
    k = held.find(_MAGIC)
    while k >= 0:
        n = _block(held[k : k + 512])
        if n and (at + k + n == size or _block(file.read_at(min(512, size - at - k - n), at + k + n))):
            return at + k
        k = held.find(_MAGIC, k + 1)
    return size


def _blocks(file, size: int, at: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, its data) of every block from one on."""
    held, base = b"", at
    while at < size:
        if at - base + BLOCK_BYTES + 64 > len(held):
            held, base = file.read_at(min(READ_BYTES, size - at), at), at
        n = _block(held[at - base : at - base + 512])
        if not n:
            raise ValueError(f"no bgzip block at {at}")
        yield at, zlib.decompress(held[at - base : at - base + n], 31)
        at += n


def _gzip(file) -> Iterator[bytes]:
    """Data of a gzip file of one or more members."""
    file.seek(0)
    at = zlib.decompressobj(31)
    while data := file.read(READ_BYTES):
        while data:
            yield at.decompress(data)
            data = at.unused_data
            if data:
                at = zlib.decompressobj(31)


def lines(part: Range) -> Iterator[bytes]:
    """The range's lines in pieces of whole lines."""
    file, size = opened(part.file)
    with file:
        head = file.read_at(min(512, size), 0)
        if head.startswith(b"\x1f\x8b") and not _block(head):
            yield from _whole_lines(_gzip(file), iter(()), True) if part.lo == 0 else ()
        elif head.startswith(b"\x1f\x8b"):
            last: list[bytes] = []

            def own(blocks):
                for at, data in blocks:
                    if at >= part.hi:
                        last.append(data)
                        return
                    yield data

            blocks = _blocks(file, size, _first_block(file, size, part.lo))
            beyond = (d for rest in (last, (data for _, data in blocks)) for d in rest)
            yield from _whole_lines(own(blocks), beyond, part.lo == 0)
        else:
            read = lambda lo, hi: (file.read_at(min(READ_BYTES, hi - at), at) for at in range(lo, hi, READ_BYTES))
            yield from _whole_lines(read(part.lo, part.hi), _rest(file, part.hi, size), part.lo == 0)


def _rest(file, at: int, size: int) -> Iterator[bytes]:
    """Data from ``at`` on in growing pieces: a line mostly ends soon."""
    n = REST_BYTES
    while at < size:
        yield file.read_at(min(n, size - at), at)
        at, n = at + n, min(2 * n, READ_BYTES)


def _whole_lines(own: Iterator[bytes], beyond: Iterator[bytes], first: bool) -> Iterator[bytes]:
    begun, left = first, []
    for data in own:
        if not begun:
            k = data.find(b"\n")
            if k < 0:
                continue
            data, begun = data[k + 1 :], True
        k = data.rfind(b"\n") + 1
        if k:
            left.append(data[:k])
            yield b"".join(left)
            left = []
        if k < len(data):
            left.append(data[k:])
    if not begun:
        return
    for data in beyond:
        k = data.find(b"\n") + 1
        left.append(data[:k] if k else data)
        if k:
            break
    if any(left):
        yield b"".join(left)
