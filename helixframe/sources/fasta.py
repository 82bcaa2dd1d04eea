"""FASTA text, plain or gzip, as DataFrames and back; index files; sample order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import clean, contig_of, file_sample, sample_of
from ..operators.ranking import with_previous
from .files import Blocks, gzi, opened

LINE = 80


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, header and raw (the body's lines, joined) of every record of one or many
    files; ``.gz`` files are read by their codec. Records without an id or a body are
    skipped. One row is one record, split where a line begins with '>'.
    """
    text = spark.read.text(paths, lineSep="\n>").select(F.input_file_name().alias("file"), "value")
    body = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.regexp_extract(body, r"^([^\r\n]*)", 1))
    raw = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"[\r\n]", "")
    return text.select("file", header.alias("header"), raw.alias("raw")).filter("header != '' AND raw != ''")


def contigs(spark: SparkSession, paths: str | list[str], by_file: bool = False) -> DataFrame:
    """sample, contig and seq. The sample is told by the header or, with ``by_file`` and
    a header without one, by the file's name.
    """
    name = F.element_at(F.split("file", "/"), -1)
    sample = sample_of(F.col("header"))
    if by_file:
        sample = F.when(sample == "unknown", file_sample(name)).otherwise(sample)
    return records(spark, paths).select(sample.alias("sample"), contig_of(F.col("header")).alias("contig"), clean(F.col("raw")).alias("seq"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """name, length, offset, line_bases and line_width of an index file."""
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases long, line_width long")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """name, start, end and seq of ranges (name, start, end; from 0, end exclusive) of an
    indexed file: ``path``.fai tells where a record's lines are and, for a file of gzip
    blocks, ``path``.gzi where its blocks are. Only the lines of a range are read, range
    after range in the order of the file. Ranges are cut at the record's end and hold the
    letters as they stand; those of records that are not there give no row.
    """
    rows = fai(spark, f"{path}.fai").join(wanted.select("name", "start", "end"), "name")
    blocks = gzi(f"{path}.gzi") if path.endswith(".gz") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as file:
            packed = Blocks(file, blocks) if blocks else None
            for batch in batches:
                out = []
                for length, offset, bases, width, start, end in zip(*(batch.column(c).to_pylist() for c in ("length", "offset", "line_bases", "line_width", "start", "end")), strict=True):
                    a, b = max(0, start), min(end, length)
                    if a >= b:
                        out.append("")
                        continue
                    place = lambda i: offset + i // bases * width + i % bases  # noqa: B023, E731
                    first, size = place(a), place(b - 1) + 1 - place(a)
                    if packed is None:
                        file.seek(first)
                    data = file.read(size) if packed is None else packed.read(first, size)
                    out.append(data.translate(None, b"\r\n").decode("latin-1"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "start", "end")), pa.array(out, pa.string())], names=["name", "start", "end", "seq"])

    near = rows.repartitionByRange("offset", "start").sortWithinPartitions("offset", "start")
    return near.mapInArrow(run, "name string, start long, end long, seq string")


def sample_blocks(rows: DataFrame, order: Column, sample: str = "sample") -> DataFrame:
    """sample, first (its least place), blocks (runs of neighbouring rows) and contiguous.

    The change of sample is told by comparison with the row before, by ranges of places
    (which tell all rows apart); rows hold only the sample's name and place.
    """
    seen = rows.select(F.col(sample).alias("sample"), order.alias("at"))
    marked = with_previous(seen, ["at"], "sample", "before").withColumn("new", (~F.col("before").eqNullSafe(F.col("sample"))).cast("long"))
    return marked.groupBy("sample").agg(F.min("at").alias("first"), F.sum("new").alias("blocks")).withColumn("contiguous", F.col("blocks") == 1)


def require_contiguous(rows: DataFrame, order: Column) -> DataFrame:
    """``rows``, or an error if a sample's rows are apart."""
    apart = sample_blocks(rows, order).filter("NOT contiguous").agg(F.count("*").alias("n"))
    checked = apart.select(F.when(F.col("n") > 0, F.raise_error(F.lit("samples are not contiguous"))).otherwise(F.lit(1)).alias("ok"))
    return rows.join(F.broadcast(checked), F.col("ok") == 1).drop("ok")


def wrapped(seq: Column, width: int = LINE) -> Column:
    """A sequence's lines."""
    return F.regexp_extract_all(seq, F.lit(f"(.{{1,{width}}})"), F.lit(1))


def fasta_text(df: DataFrame, header: Column, seq: Column) -> DataFrame:
    """value: one record's text in a row, header line and wrapped lines."""
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), F.array_join(wrapped(seq), "\n")).alias("value"))


def write_fasta(df: DataFrame, path: str, header: str = "contig", compression: str | None = None) -> None:
    """One or more text files of the records of contig rows."""
    fasta_text(df, F.col(header), F.col("seq")).write.text(path, compression=compression)


def split_by_sample(df: DataFrame, path: str) -> None:
    """A folder for each sample, named by it with '/' and '#' as '_'."""
    safe = F.regexp_replace("sample", "[/#]", "_")
    text = F.concat(F.lit(">"), "sample", F.lit("#"), F.col("contig").cast("string"), F.lit("\n"), F.array_join(wrapped(F.col("seq")), "\n"))
    df.select(safe.alias("name"), text.alias("value")).write.partitionBy("name").text(path)
