"""Archives in the binary container as DataFrames, and back.

Streams: params (k, least match, pack size and, in newer ones, segment size, each four
bytes, lowest first); collection-samples (names); collection-contigs and
collection-details (a part for each batch of samples); and for each group its reference
and the packs of its differences, named by the group's number in base 64. Parts whose
metadata is not 0 are compressed, and those of groups end with a marker of how.

Names and places come from small streams, a batch at a time. Sequences are read by the
parts that the wanted segments need, dealt over tasks, and decoded group by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.bases import reverse_complement, stream_name
from ..operators import grouping
from ..plans import collection
from ..plans.tables import stored
from . import container

#: Segment size of archives that do not tell theirs.
SEGMENT_SIZE = 60_000
#: A byte that stands for a whole part of a name that is as in the name before.
SAME = 129
PLACES = "batch long, sample_at long, contig_at long, contig string, part long, group_id long, in_group_id long, raw_length long, is_rev_comp boolean"


def plain(data: bytes, metadata: int) -> bytes:
    """A metadata stream's part."""
    return codec.decompress(data) if metadata else data


def unmarked(data: bytes, metadata: int) -> bytes:
    """A group's part as codes or difference texts."""
    return codec.decompress_marked(data[:-1], data[-1]).tobytes() if metadata else data


def items(pack: bytes) -> list[bytes]:
    """A pack's items; the last may have no end."""
    out = pack.split(collection.END)
    return out if out[-1] else out[:-1]


def read_params(data: bytes) -> dict[str, int]:
    if len(data) < 12:
        raise ValueError(f"the parameters have {len(data)} bytes, not 12 or more")
    numbers = [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data) // 4 * 4, 4)]
    return {"k": numbers[0], "min_match_len": numbers[1], "pack_cardinality": numbers[2], "segment_size": numbers[3] if len(numbers) > 3 else SEGMENT_SIZE}


def read_names(data: bytes) -> list[str]:
    """Texts ended by a zero byte, after their number."""
    n, at = codec.read_prefixed(data)
    return [x.decode() for x in data[at:].split(b"\0")[:n]]


def name_after(coded: bytes, before: list[bytes]) -> list[bytes]:
    """The parts of a name told by those of the one before: bytes from 128 on repeat so
    many (256 less the byte) of its letters. Another number of parts: the name itself.
    """
    parts = coded.split(b" ")
    if len(parts) != len(before):
        return parts
    out = []
    for part, old in zip(parts, before, strict=True):
        if part == bytes([SAME]):
            out.append(old)
            continue
        own = bytearray()
        for c in part:
            own += bytes([c]) if c < 128 else old[len(own) : len(own) + 256 - c]
        out.append(bytes(own))
    return out


def read_contigs(data: bytes) -> list[list[str]]:
    """The names of a batch's contigs, by sample."""
    samples, at = codec.read_prefixed(data)
    out = []
    for _ in range(samples):
        count, at = codec.read_prefixed(data, at)
        before: list[bytes] = []
        names = []
        for _ in range(count):
            end = data.index(0, at)
            before = name_after(data[at:end], before)
            names.append(b" ".join(before).decode("utf-8", "replace"))
            at = end + 1
        out.append(names)
    return out


def read_details(data: bytes, usual: int) -> list[list[list[tuple[int, int, int, bool]]]]:
    """(group, id, length, turned) of a batch's segments, by sample and contig. Lengths
    are told against the ``usual`` one, ids against the largest of their group so far.
    """
    sizes, at = [], 0
    for _ in range(5):
        raw, at = codec.read_prefixed(data, at)
        packed, at = codec.read_prefixed(data, at)
        sizes.append((raw, packed))
    streams = []
    for _, packed in sizes:
        streams.append(codec.decompress(data[at : at + packed]))
        at += packed
    places = [0] * 5

    def take(i: int) -> int:
        value, places[i] = codec.read_prefixed(streams[i], places[i])
        return value

    counts = [[take(0) for _ in range(take(0))] for _ in range(take(0))]
    last: dict[int, int] = {}
    out = []
    for contigs in counts:
        out.append([])
        for n in contigs:
            own = []
            for _ in range(n):
                group = take(1)
                member = codec.read_id(take(2), last.get(group, -1))
                if member > max(0, last.get(group, -1)):
                    last[group] = member
                own.append((group, member, codec.read_against(take(3), usual), take(4) != 0))
            out[-1].append(own)
    return out


class Archive:
    """What is in one archive."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.parts = stored(container.parts(spark, path), "archive-parts")
        row = container.read(self.parts.filter("stream = 'params'")).first()
        if row is None:
            raise ValueError(f"{path} has no parameters")
        self.params = read_params(bytes(row["data"]))

    def samples(self) -> DataFrame:
        """at (from 0) and sample, in the archive's order."""
        row = container.read(self.parts.filter("stream = 'collection-samples'")).first()
        names = read_names(plain(bytes(row["data"]), row["metadata"]))
        return self.spark.createDataFrame(list(enumerate(names)), "at long, sample string")

    def segments(self) -> DataFrame:
        """sample, contig, part, group_id, in_group_id, raw_length and is_rev_comp."""
        usual = self.params["segment_size"] + self.params["k"]
        streams = container.read(self.parts.filter("stream IN ('collection-contigs', 'collection-details')")).select("part_id", "stream", F.struct("metadata", "data").alias("x"))
        both = streams.groupBy("part_id").pivot("stream", ["collection-contigs", "collection-details"]).agg(F.first("x"))
        both = both.select("part_id", F.col("collection-contigs.metadata").alias("metadata"), F.col("collection-contigs.data").alias("names"), F.col("collection-details.data").alias("details"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, metadata, names, details in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    contigs, places = read_contigs(plain(names, metadata)), read_details(details, usual)
                    rows = [(number, s, c, contigs[s][c], p, *x) for s, some in enumerate(places) for c, own in enumerate(some) for p, x in enumerate(own)]
                    # A sample without segments still counts for those after it.
                    rows.append((number, len(contigs), -1, None, None, None, None, None, None))
                    types = [*[pa.int64()] * 3, pa.string(), *[pa.int64()] * 4, pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["batch", "sample_at", "contig_at", "contig", "part", "group_id", "in_group_id", "raw_length", "is_rev_comp"])

        told = stored(both.mapInArrow(run, PLACES), "archive-places")
        sizes, before = {r["batch"]: r["sample_at"] for r in told.filter("contig_at < 0").collect()}, {}
        for number in sorted(sizes):
            before[number] = sum(n for other, n in sizes.items() if other < number)
        first = self.spark.createDataFrame(sorted(before.items()), "batch long, first long")
        placed = told.filter("contig_at >= 0").join(F.broadcast(first), "batch").withColumn("at", F.col("first") + F.col("sample_at"))
        return placed.join(self.samples(), "at").select("sample", "contig", "part", "group_id", "in_group_id", "raw_length", "is_rev_comp")

    def sequences(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` rows of segments() with seq as the contig has it."""
        ids = stored(wanted.select("group_id", "in_group_id").distinct(), "archive-wanted")
        group = F.col("group_id")
        ref = ids.filter(group >= grouping.FIRST_GROUP).select("group_id").distinct().select("group_id", *[stream_name(group, "ref", v).alias(f"v{v}") for v in (3000, 2000)])
        packs = ids.filter((group < grouping.FIRST_GROUP) | (F.col("in_group_id") > 0)).select("group_id", F.floor((F.col("in_group_id") - (group >= grouping.FIRST_GROUP).cast("int")) / self.params["pack_cardinality"]).alias("part_id")).distinct()
        packs = packs.select("group_id", "part_id", *[stream_name(group, "delta", v).alias(f"v{v}") for v in (3000, 2000)])
        refs = self._data(ref.withColumn("part_id", F.lit(0).cast("long")))
        deltas = self._data(packs)
        size = self.params["pack_cardinality"]

        def unpack_refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for metadata, data in zip(batch.column("metadata").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    codes = np.frombuffer(unmarked(data, metadata), np.uint8)
                    whole = metadata or len(codes)
                    if len(codes) * 4 >= whole > len(codes) * 4 - 8 and whole != len(codes):  # two bits a base
                        codes = codec.unpack_two_bits(codes.tobytes(), whole)
                    out.append(codec.to_letters(codes))
                yield pa.RecordBatch.from_arrays([batch.column("group_id"), pa.array(out, pa.string())], names=["group_id", "seq"])

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, pack, metadata, data in zip(*(batch.column(c).to_pylist() for c in ("group_id", "part_id", "metadata", "data")), strict=True):
                    some, coded = items(unmarked(data, metadata)), group >= grouping.FIRST_GROUP
                    if not coded:
                        some = [codec.to_letters(np.frombuffer(x, np.uint8)).encode() for x in some]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([group] * n, pa.int64()), pa.array(range(pack * size + coded, pack * size + coded + n), pa.int64()), pa.array([pack] * n, pa.int64()), pa.array(some, pa.binary())], names=["group_id", "in_group_id", "pack_id", "payload"])

        letters = stored(refs.mapInArrow(unpack_refs, "group_id long, seq string"), "archive-refs")
        coded = deltas.mapInArrow(unpack, "group_id long, in_group_id long, pack_id long, payload binary").join(ids, ["group_id", "in_group_id"], "left_semi")
        text = collection.decode_deltas(coded, letters, self.params["min_match_len"]).unionByName(letters.select("group_id", F.lit(0).cast("long").alias("in_group_id"), "seq"))
        seq = F.when(F.col("is_rev_comp"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
        return wanted.join(text, ["group_id", "in_group_id"]).withColumn("seq", seq)

    def _data(self, wanted: DataFrame) -> DataFrame:
        """group_id, part_id, metadata and data of parts, by the names of either version."""
        named = wanted.select("group_id", "part_id", F.explode(F.array("v3000", "v2000")).alias("stream"))
        found = self.parts.join(named, ["stream", "part_id"])
        return container.read(found.select(*self.parts.columns)).join(named, ["stream", "part_id"]).select("group_id", "part_id", "metadata", "data")

    def contigs(self) -> DataFrame:
        """sample, contig and seq of all contigs: what collection.create() takes."""
        own = F.when(F.col("part") == 0, F.col("seq")).otherwise(F.substr("seq", F.lit(self.params["k"] + 1)))
        rows = self.sequences(self.segments()).withColumn("own", own).groupBy("sample", "contig").agg(F.array_sort(F.collect_list(F.struct("part", "own"))).alias("s"))
        return rows.select("sample", "contig", F.array_join(F.transform("s", lambda x: x["own"]), "").alias("seq"))


def export(c: collection.Collection, path: str) -> None:
    """Writes a collection as an archive, samples and contigs by name. A batch of samples is
    one part of the metadata, made by one task.
    """
    spark, params = c.spark, c.table("params").first()
    number = codec.write_prefixed
    names = [r["sample"] for r in c.samples().collect()]
    small = [("params", 0, 0, b"".join(int(params[x]).to_bytes(4, "little") for x in ("k", "min_match_len", "pack_cardinality", "segment_size")))]
    listed = number(len(names)) + b"".join(x.encode() + b"\0" for x in names)
    small.append(("collection-samples", 0, len(listed), codec.compress(listed, 19)))
    usual = params["segment_size"] + params["k"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in zip(batch.column("batch").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                contigs: dict[str, dict[str, list[dict]]] = {}
                for r in rows:
                    contigs.setdefault(r["sample"], {}).setdefault(r["name"], []).append(r)
                listed = number(len(contigs)) + b"".join(number(len(own)) + b"".join(x.encode() + b"\0" for x in own) for own in contigs.values())
                streams = [number(len(contigs)) + b"".join(number(len(own)) + b"".join(number(len(x)) for x in own.values()) for own in contigs.values()), b"", b"", b"", b""]
                last: dict[int, int] = {}
                for r in (r for own in contigs.values() for x in own.values() for r in x):
                    group, member = r["group_id"], r["in_group_id"]
                    values = (group, codec.code_id(member, last.get(group, -1)), codec.against(r["raw_length"], usual), int(r["is_rev_comp"]))
                    if member > max(0, last.get(group, -1)):
                        last[group] = member
                    for i, v in enumerate(values):
                        streams[i + 1] += number(v)
                packed = [codec.compress(x, 19) for x in streams]
                details = b"".join(number(len(x)) + number(len(y)) for x, y in zip(streams, packed, strict=True)) + b"".join(packed)
                out = [("collection-contigs", key, len(listed), codec.compress(listed, 19)), ("collection-details", key, 0, details)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["stream", "part_id", "metadata", "data"])

    kind = "stream string, part_id long, metadata long, data binary"
    segments = c.table("segments").withColumn("name", F.col("contig").cast("string"))
    batches = segments.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("sample", "name", "part", "group_id", "in_group_id", "raw_length", "is_rev_comp"))).alias("rows")).mapInArrow(told, kind)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, data = [], []
            for group, size, raw in zip(*(batch.column(x).to_pylist() for x in ("group_id", "raw_size", "data")), strict=True):
                pack = codec.decompress(raw) if size else raw
                if group < grouping.FIRST_GROUP:  # letters become codes
                    pack = codec.packed([x if x == collection.HOLE else codec.to_codes(x.decode()).tobytes() for x in items(pack)])
                small_ = codec.compress(pack) + b"\0"
                sizes.append(len(pack) if len(small_) < len(pack) else 0)
                data.append(min(pack, small_, key=len))
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("pack_id"), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["stream", "part_id", "metadata", "data"])

    group = F.col("group_id")
    refs = c.table("refs").select(stream_name(group, "ref").alias("stream"), F.lit(0).cast("long").alias("part_id"), F.col("raw_size").alias("metadata"), F.concat("data", F.when(F.col("marker") == 1, F.lit(b"\1")).otherwise(F.lit(b"\0"))).alias("data"))
    packs = c.table("packs").withColumn("stream", stream_name(group, "delta")).select("stream", "pack_id", "group_id", "raw_size", "data").mapInArrow(marked, kind)
    whole = spark.createDataFrame([(s, i, m, bytearray(d)) for s, i, m, d in small], kind).unionByName(batches).unionByName(refs).unionByName(packs)
    container.write(whole, path)
