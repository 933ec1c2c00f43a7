"""Zip containers in any storage that Spark reads.

The driver seeks in a container through the Hadoop file system and reads its directory and small members. A large member is inflated by a task, as a stream:
of the container it holds the compressed bytes, of the member one piece. Pieces of whole lines, in UTF-8, are written to the
shared folder, from where many tasks read them.
"""

from __future__ import annotations

import codecs
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import cut

#: Bytes of text in a piece.
PIECE = 1 << 20

_PIECES = pa.schema({"file": pa.string(), "block": pa.int64(), "raw": pa.binary()})


class StoredFile(io.RawIOBase):
    """A file in Hadoop's file systems, as Python reads files."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.size, self.at, self._stream = fs.getFileStatus(p).getLen(), 0, fs.open(p)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.size - self.at))
        if n:
            self._stream.seek(self.at)
            buffer[:n] = self._stream.readNBytes(n)
            self.at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


class StoredSink(io.RawIOBase):
    """A new file in Hadoop's file systems, as Python writes files."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def opened(spark: SparkSession, path: str) -> zipfile.ZipFile | None:
    """The container, for its directory and small members; None if it is no zip file."""
    file = io.BufferedReader(StoredFile(spark, path), 1 << 16)
    return zipfile.ZipFile(file) if zipfile.is_zipfile(file) else None


def whole_lines(stream, encoding: str, size: int) -> Iterator[bytes]:
    """UTF-8 in pieces of whole lines of at least ``size`` bytes, without the last line's end."""
    decode, held = codecs.getincrementaldecoder(encoding)("replace"), b""
    while True:
        block = stream.read(size)
        held += decode.decode(block, not block).encode()
        cut_at = held.rfind(b"\n")
        if block and (len(held) < size or cut_at < 0):
            continue
        if not block:
            if held:
                yield held.removesuffix(b"\n")
            return
        yield held[:cut_at]
        held = held[cut_at + 1 :]


def member_lines(spark: SparkSession, path: str, member: str, encoding: str = "utf-8", size: int = PIECE) -> DataFrame:
    """(file, block, raw): a member's lines, in pieces numbered from 0."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as zf, zf.open(member) as stream:
                    for k, piece in enumerate(whole_lines(stream, encoding, size)):
                        yield pa.RecordBatch.from_arrays([pa.array([member]), pa.array([k]), pa.array([piece], pa.binary())], schema=_PIECES)

    stored = spark.read.format("binaryFile").load(path).select("content")
    return cut(stored.mapInArrow(run, "file string, block long, raw binary").where(F.col("raw").isNotNull()))
