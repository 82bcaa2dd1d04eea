"""The binary container of archives: streams of parts in one file, listed at its end.

A file is parts, one after another (a number of the length-byte form, then the data), the
footer, and the footer's size in eight bytes, lowest first. The footer tells how many
streams there are and for each its name (ended by a zero byte), number of parts, raw
size, and each part's offset and size. The metadata of a part is not in its size; a part
without data has none.

A file's footer is read by one task; its parts become rows that are read wherever they
are dealt, each by its own offset. Files are opened by their address in any file system
that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import read_number, write_number
from .files import opened

PARTS = "path string, stream_id long, stream string, raw_size long, part_id long, offset long, size long"


def footer(path: str) -> list[tuple[int, str, int, int, int, int]]:
    """stream_id, stream, raw_size, part_id, offset and size of every part. A stream
    without parts has one row, whose part_id is -1.
    """
    with opened(path) as file:
        end = file.size()
        if end < 8:
            raise ValueError(f"{path} is no archive: it has {end} bytes")
        file.seek(end - 8)
        size = int.from_bytes(file.read(8), "little")
        if size > end - 8:
            raise ValueError(f"{path} is no archive: its footer would be longer than the file")
        file.seek(end - 8 - size)
        data = file.read(size)
    out = []
    streams, at = read_number(data)
    for stream_id in range(streams):
        stop = data.index(0, at)
        name = data[at:stop].decode("latin-1")
        count, at = read_number(data, stop + 1)
        raw, at = read_number(data, at)
        if not count:
            out.append((stream_id, name, raw, -1, 0, 0))
        for part in range(count):
            offset, at = read_number(data, at)
            length, at = read_number(data, at)
            out.append((stream_id, name, raw, part, offset, length))
    return out


def parts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, stream_id, stream, raw_size, part_id, offset and size of the parts of
    archives; no data is read.
    """
    paths = [paths] if isinstance(paths, str) else paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [(path, *r) for r in footer(path)]
                for i in range(0, len(rows), 65_536):
                    columns = list(zip(*rows[i : i + 65_536], strict=True))
                    types = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "stream_id", "stream", "raw_size", "part_id", "offset", "size"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInArrow(run, PARTS)


def read(wanted: DataFrame) -> DataFrame:
    """Rows of parts() with metadata and data. Filter by stream or part before: only
    what is asked for is read, in the order of the offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, file = None, None
            metadata, data = [], []
            for path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size")), strict=True):
                if not size:
                    metadata.append(0)
                    data.append(b"")
                    continue
                if path != held:
                    held, file = path, opened(path)
                file.seek(offset)
                head = file.read(1)
                number, _ = read_number(head + file.read(head[0]))
                metadata.append(number)
                data.append(file.read(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(metadata, pa.int64()), pa.array(data, pa.binary())], names=[*batch.schema.names, "metadata", "data"])

    rows = wanted.filter("part_id >= 0").select("path", "stream_id", "stream", "raw_size", "part_id", "offset", "size")
    return rows.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, PARTS + ", metadata long, data binary")


def write(rows: DataFrame, path: str) -> None:
    """One archive of rows (stream, part_id, metadata, data), by the order of the streams'
    names and their parts, whatever the order of the rows. One file has one writer: the
    driver appends range after range and holds no more than one of them.
    """
    from pyarrow import fs

    streams: dict[str, list[tuple[int, int]]] = {}
    raw: dict[str, int] = {}
    at = 0
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(inner) as out:
        for r in rows.select("stream", "part_id", "metadata", "data").orderBy("stream", "part_id").toLocalIterator():
            data = bytes(r["data"])
            head = write_number(r["metadata"])
            out.write(head + data)
            streams.setdefault(r["stream"], []).append((at, len(data)))
            raw[r["stream"]] = raw.get(r["stream"], 0) + (r["metadata"] or len(data))
            at += len(head) + len(data)
        end = write_number(len(streams))
        for name, own in streams.items():
            end += name.encode("latin-1") + b"\0" + write_number(len(own)) + write_number(raw[name]) + b"".join(write_number(x) for pair in own for x in pair)
        out.write(end + len(end).to_bytes(8, "little"))


def statistics(listed: DataFrame) -> DataFrame:
    """stream, parts, raw and packed bytes of every stream, from the footers alone."""
    return listed.groupBy("path", "stream").agg(F.max("raw_size").alias("raw"), F.sum("size").alias("packed"), F.count_if(F.col("part_id") >= 0).alias("parts"))
