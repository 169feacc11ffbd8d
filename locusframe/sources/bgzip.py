"""Text written as bgzip blocks in the order of the rows.

Each task writes its part beside the others under a temporary name; only the parts
of tasks that ended well are moved to their place, once all have.  The parts, joined
in the order of their names, are one bgzip file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes of text in a block; the format allows 65536 bytes with its header.
TEXT_BYTES = 65280
#: The empty block that ends a file, as the format gives it.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(text: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    head = struct.pack("<4sIBBHBBHH", b"\x1f\x8b\x08\x04", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


@dataclass
class Part(WriterCommitMessage):
    no: int
    name: str
    rows: int


class BgzipSource(DataSource):
    """Options: ``path`` (a new folder)."""

    @classmethod
    def name(cls) -> str:
        return "locusframe_bgzip"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool):
        return BgzipWriter(self.options["path"])


class BgzipWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _store(self):
        from pyarrow import fs

        if self.path.startswith("/"):
            return fs.LocalFileSystem(), self.path
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, rows, left = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, b""
        store, root = self._store()
        store.create_dir(f"{root}/_temporary", recursive=True)
        with store.open_output_stream(f"{root}/_temporary/{name}", compression=None) as out:
            for batch in iterator:
                rows += batch.num_rows
                left += b"".join(x.encode() + b"\n" for x in batch.column(0).to_pylist() if x is not None)
                whole = len(left) - len(left) % TEXT_BYTES
                for lo in range(0, whole, TEXT_BYTES):
                    out.write(block(left[lo : lo + TEXT_BYTES]))
                left = left[whole:]
            out.write((block(left) if left else b"") + END)
        return Part(task.partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = self._store()
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{root}/_temporary/{m.name}", f"{root}/part-{m.no:05d}.gz")
        self._clear(store, root)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        store.create_dir(f"{root}/_temporary", recursive=True)
        assert store.get_file_info(root).type == fs.FileType.Directory
        store.delete_dir(f"{root}/_temporary")


def write_bgzip(lines: DataFrame, path: str) -> None:
    """Write the rows of a ``value`` column, in their order, to parts in a new folder."""
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(BgzipSource)
    lines.select("value").write.format("locusframe_bgzip").option("path", path).mode("append").save()
