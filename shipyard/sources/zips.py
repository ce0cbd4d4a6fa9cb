"""Zip packages as tables of entries, read by ranges of entries.

``binaryFile`` holds a file in one row, which ends at 2 GB and puts a package into one task. Here
only the names of the files come from it. ``zip_index`` reads the directory at the end of each zip and
gives a row per entry with its place in the file; ``zip_contents`` deals the wanted entries out by
range, so a large package is read by many tasks, each of which seeks to its entries and reads
those bytes alone. Tasks reach the files through Arrow's file systems (local or mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content bytes of an output batch (one larger entry is alone in its batch).
BATCH_BYTES = 8 << 20
#: Compressed bytes that are read at a time.
READ_BYTES = 1 << 20

INDEX_SCHEMA = ("path string, entry_pos long, entry_name string, header_at long, packed long, size long, method int, "
                "crc long, _error string")


def open_file(path: str):
    """A seekable file of any file system that Arrow knows."""
    from pyarrow import fs

    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


class _Seekable:
    """A file as the zip module wants it: a seek before the start is an OSError."""

    def __init__(self, f) -> None:
        self.f = f
        self.read, self.tell, self.seekable, self.close = f.read, f.tell, f.seekable, f.close

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.f.seek(offset, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


def _read_directories(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zipfile

    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                with open_file(path) as f, zipfile.ZipFile(_Seekable(f)) as z:
                    infos = z.infolist()
                rows = [(path, k, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC,
                         "encrypted entry" if i.flag_bits & 1 else None)
                        for k, i in enumerate(infos) if not i.is_dir()]
            except (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, ValueError, OSError, NotImplementedError) as e:
                rows = [(path, None, None, None, None, None, None, None, f"unreadable package: {type(e).__name__}")]
            for low in range(0, len(rows), 10_000):
                yield out(rows[low:low + 10_000])


def zip_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry (folders left out) of each zip file at ``path``; an unreadable file is one row with ``_error``."""
    files = spark.read.format("binaryFile").load(path).select("path")  # content is not read
    return files.mapInArrow(_read_directories, INDEX_SCHEMA)


def entry_bytes(f, header_at: int, packed: int, size: int, method: int, crc: int) -> bytes:
    """The content of an entry whose local header stands at ``header_at``; ValueError if it is not what the directory says."""
    f.seek(header_at)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no entry header")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(header_at + 30 + name + extra)
    if method not in (0, 8):
        raise ValueError(f"compression method {method}")
    unpack = zlib.decompressobj(-15) if method == 8 else None
    parts, left = [], packed
    while left:
        raw = f.read(min(left, READ_BYTES))
        if not raw:
            raise ValueError("entry breaks off")
        left -= len(raw)
        parts.append(unpack.decompress(raw) if unpack else raw)
    if unpack:
        parts.append(unpack.flush())
    content = b"".join(parts)
    if len(content) != size or zlib.crc32(content) != crc:
        raise ValueError("entry does not match its checksum")
    return content


def zip_contents(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds ``content`` (binary) to the rows of an index, or says in ``_error`` why it cannot be read.

    Rows are dealt out by ranges of (path, entry), read in the order of the file.
    """
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartitionByRange(n, "path", "entry_pos").sortWithinPartitions("path", "header_at")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        try:
            for batch in batches:
                errors = batch.column("_error").to_pylist()
                found: list[bytes | None] = []
                low, held = 0, 0

                def out(high: int) -> pa.RecordBatch:
                    part = batch.slice(low, high - low)
                    columns = [pa.array(errors[low:high], pa.string()) if n == "_error" else part.column(n) for n in part.schema.names]
                    return pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], [*part.schema.names, "content"])

                fields = [batch.column(c).to_pylist() for c in ("path", "header_at", "packed", "size", "method", "crc")]
                for k, (path, *place) in enumerate(zip(*fields)):
                    content = None
                    if errors[k] is None:
                        try:
                            if path != opened:
                                if f is not None:
                                    f.close()
                                f, opened = open_file(path), path
                            content = entry_bytes(f, *place)
                        except (ValueError, OSError, zlib.error) as e:
                            errors[k] = f"unreadable entry: {e}"
                    found.append(content)
                    held += len(content or b"")
                    if held >= BATCH_BYTES:
                        yield out(k + 1)
                        low, held, found = k + 1, 0, []
                if low < batch.num_rows:
                    yield out(batch.num_rows)
        finally:
            if f is not None:
                f.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields) + ", content binary"
    return dealt.mapInArrow(read, schema)


def text_contents(index: DataFrame, encoding: str, partitions: int | None = None) -> DataFrame:
    """``zip_contents`` with content as text."""
    return zip_contents(index, partitions).withColumn("content", F.decode("content", encoding))
