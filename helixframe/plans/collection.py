"""A collection of sequences as Parquet tables, and the queries over it.

create() splits contigs into segments, groups them and writes samples, contigs, segments,
groups, refs, packs, splitters and params. Members of a group are told by differences
from its reference, coded in Arrow batches after one shuffle by group and pack; fifty
make a pack. Every read is a plan over the tables: lengths and lists never touch
sequences, a sample's rows are found by the folder of its batch, and a range reads the
packs of the segments that overlap it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.bases import reverse_complement
from ..operators import grouping, segments
from ..operators.ranking import numbered
from .tables import stored

TABLES = ("samples", "contigs", "segments", "groups", "refs", "packs", "splitters", "params")
BATCH = 50


def layout(contigs: DataFrame, splitters: DataFrame, k: int, cut: DataFrame | None = None) -> DataFrame:
    """Segments with group_id, in_group_id, is_rev_comp and seq as its group keeps it;
    ``cut`` are the segments, where there are any yet.
    """
    keyed = stored(grouping.with_keys(segments.segment(contigs, splitters, k) if cut is None else cut), "keyed")
    placed = segments.with_sequence(grouping.assign_groups(keyed, grouping.group_table(keyed)), contigs)
    return grouping.in_group_ids(placed.withColumn("seq", grouping.oriented(F.col("seq"))))


def encode_deltas(deltas: DataFrame, refs: DataFrame, min_match: int) -> DataFrame:
    """deltas with payload (bytes) for seq: a difference text, or the letters themselves
    in groups without a reference. Members and reference meet by group and pack, so a
    group of any size is spread over tasks; a reference is sent once to each of its packs,
    before the members, and not with every one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, differ = None, None
        for batch in batches:
            out, kept = [], []
            for i, (g, member, seq) in enumerate(zip(batch.column("group_id").to_pylist(), batch.column("in_group_id").to_pylist(), batch.column("seq"), strict=True)):
                if member < 0:
                    group, differ = g, codec.Differ(codec.to_codes(seq.as_py()), min_match)
                    continue
                kept.append(i)
                out.append(differ.encode(codec.to_codes(seq.as_py())) if g == group else seq.as_py().encode())
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("group_id", "in_group_id", "pack_id")), pa.array(out, pa.binary())], names=["group_id", "in_group_id", "pack_id", "payload"])

    own = deltas.select("group_id", "in_group_id", "pack_id", "seq")
    return after_reference(own, refs).mapInArrow(run, "group_id long, in_group_id long, pack_id long, payload binary")


def after_reference(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` (group_id, in_group_id, pack_id and more) dealt by group and pack, in
    order, after a row with the member -1 that holds the reference in the last column.
    """
    packs = rows.select("group_id", "pack_id").distinct()
    first = packs.join(refs.select("group_id", "seq"), "group_id").withColumn("in_group_id", F.lit(-1).cast("long"))
    both = rows.unionByName(first, allowMissingColumns=True)
    return both.repartition("group_id", "pack_id").sortWithinPartitions("group_id", "pack_id", "in_group_id")


#: Ends an item in a pack; what is at place 0 of the first pack of a group without reference.
END, HOLE = b"\xff", b"\x7f"


def with_packs(coded: DataFrame) -> DataFrame:
    """group_id, pack_id, first_id, items, raw_size and data: the payloads of a pack, one
    after the other, compressed where that helps (raw_size is 0 where it does not). The ids
    of a pack's items follow each other, so its first tells them all.
    """
    lists = coded.groupBy("group_id", "pack_id").agg(F.array_sort(F.collect_list(F.struct("in_group_id", "payload"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, items, sizes, data = [], [], [], []
            for group, some in zip(batch.column("group_id").to_pylist(), batch.column("s").to_pylist(), strict=True):
                begin = some[0]["in_group_id"]
                hole = [HOLE] if group < grouping.FIRST_GROUP and begin == 1 else []
                raw = codec.packed(hole + [x["payload"] for x in some])
                small = codec.compress(raw)
                first.append(begin)
                items.append(len(some))
                sizes.append(len(raw) if len(small) < len(raw) else 0)
                data.append(min(raw, small, key=len))
            yield pa.RecordBatch.from_arrays([batch.column("group_id"), batch.column("pack_id"), *(pa.array(x, pa.int64()) for x in (first, items, sizes)), pa.array(data, pa.binary())], names=["group_id", "pack_id", "first_id", "items", "raw_size", "data"])

    return lists.mapInArrow(run, "group_id long, pack_id long, first_id long, items long, raw_size long, data binary")


def from_packs(packs: DataFrame) -> DataFrame:
    """group_id, in_group_id, pack_id and payload of every item of packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, pack, first, n, size, data in zip(*(batch.column(c).to_pylist() for c in ("group_id", "pack_id", "first_id", "items", "raw_size", "data")), strict=True):
                some = (codec.decompress(data) if size else data).split(END)[:-1][-n:]
                yield pa.RecordBatch.from_arrays([pa.array([group] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([pack] * n, pa.int64()), pa.array(some, pa.binary())], names=["group_id", "in_group_id", "pack_id", "payload"])

    return packs.select("group_id", "pack_id", "first_id", "items", "raw_size", "data").mapInArrow(run, "group_id long, in_group_id long, pack_id long, payload binary")


def decode_deltas(deltas: DataFrame, refs: DataFrame, min_match: int) -> DataFrame:
    """group_id, in_group_id and seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, differ = None, None
        for batch in batches:
            kept, out = [], []
            for i, (g, member, seq, payload) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group_id", "in_group_id", "seq", "payload")), strict=True)):
                if member < 0:
                    group, differ = g, codec.Differ(codec.to_codes(seq), min_match)
                    continue
                kept.append(i)
                out.append(codec.to_letters(differ.decode(payload)) if g == group else payload.decode())
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("group_id").take(at), batch.column("in_group_id").take(at), pa.array(out, pa.string())], names=["group_id", "in_group_id", "seq"])

    own = deltas.select("group_id", "in_group_id", "pack_id", "payload")
    return after_reference(own, refs).select("group_id", "in_group_id", "seq", "payload").mapInArrow(run, "group_id long, in_group_id long, seq string")


def encode_refs(refs: DataFrame) -> DataFrame:
    """group_id, raw_size, marker and data: references as packed tuples, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [codec.compress_reference(codec.to_codes(x.as_py())) for x in batch.column("seq")]
            sizes = [len(x.as_py()) for x in batch.column("seq")]
            yield pa.RecordBatch.from_arrays([batch.column("group_id"), pa.array(sizes, pa.int64()), pa.array([m for _, m in coded], pa.int32()), pa.array([d for d, _ in coded], pa.binary())], names=["group_id", "raw_size", "marker", "data"])

    return refs.select("group_id", "seq").mapInArrow(run, "group_id long, raw_size long, marker int, data binary")


def decode_refs(refs: DataFrame) -> DataFrame:
    """group_id and seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [codec.to_letters(codec.decompress_marked(d, m)) for d, m in zip(batch.column("data").to_pylist(), batch.column("marker").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("group_id"), pa.array(seqs, pa.string())], names=["group_id", "seq"])

    return refs.select("group_id", "marker", "data").mapInArrow(run, "group_id long, seq string")


def encode_ids(rows: DataFrame) -> DataFrame:
    """``rows`` (batch, sample, contig_name, part, group_id, in_group_id) with code for
    in_group_id: told by the largest id before it in its batch and group.
    """
    return _ids(rows, "in_group_id", "code", codec.code_id, lambda value, code: value)


def decode_ids(rows: DataFrame) -> DataFrame:
    """The inverse of encode_ids(): code becomes in_group_id."""
    return _ids(rows, "code", "in_group_id", codec.read_id, lambda value, code: code)


def _ids(rows: DataFrame, old: str, new: str, told: Callable[[int, int], int], id_of: Callable[[int, int], int]) -> DataFrame:
    """One pass over the rows of each batch and group in their order, which carries the
    largest id alone.
    """
    kept = [c for c in rows.columns if c != old]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, -1
        for batch in batches:
            out = []
            for number, group, value in zip(*(batch.column(c).to_pylist() for c in ("batch", "group_id", old)), strict=True):
                if here != (number, group):
                    here, last = (number, group), -1
                out.append(told(value, last))
                own = id_of(value, out[-1])
                last = own if own > max(0, last) else last
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.int64())], names=[*kept, new])

    return rows.repartition("batch", "group_id").sortWithinPartitions("batch", "group_id", *grouping.ORDER).mapInArrow(run, f"{schema}, {new} long")


def create(contigs: DataFrame, path: str, k: int = 31, segment_size: int = 60_000, min_match: int = 20, adaptive: bool = False, mode: str = "errorifexists") -> Collection:
    """Writes a collection of (sample, contig, seq) rows; splitters come from the first
    sample (and, with ``adaptive``, from the long contigs without any).
    """
    spark = contigs.sparkSession
    if adaptive:
        split = segments.adaptive_splitters(contigs, k, segment_size)
    else:
        split = segments.determine_splitters(segments.first_sample(contigs), k, segment_size)["splitters"]
    split = stored(split, "splitters")
    return store(contigs, stored(layout(contigs, split, k), "members"), split, path, k, segment_size, min_match, mode)


def store(contigs: DataFrame, members: DataFrame, splitters: DataFrame, path: str, k: int, segment_size: int, min_match: int, mode: str = "errorifexists") -> Collection:
    """Writes the tables of a collection. Samples go by batches of fifty, by name, and
    contigs and segments are folders by batch, so that a sample's rows are found without
    reading the others'. Packs are ordered by group, so that streams lie in their order.
    """
    spark = contigs.sparkSession
    refs = stored(grouping.references(members), "refs")
    samples = stored(numbered(contigs.select("sample").distinct(), ["sample"]).select("sample", F.floor((F.col("n") - 1) / BATCH).alias("batch")), "samples")
    lengths = contigs.select("sample", "contig", F.length("seq").cast("long").alias("length")).join(samples, "sample")
    placed = members.select("sample", "contig", "part", "start", "raw_length", "group_id", "in_group_id", "is_rev_comp").join(samples, "sample")
    in_order = lambda df, *by: df.repartitionByRange("batch", *by).sortWithinPartitions("batch", *by)
    tables = {
        "samples": samples.orderBy("sample"),
        "contigs": in_order(lengths, "sample", "contig"),
        "segments": in_order(placed, "sample", "contig", "part"),
        "groups": members.filter(F.col("group_id") >= grouping.FIRST_GROUP).select("group_id", "key_front", "key_back").distinct(),
        "refs": encode_refs(refs.repartitionByRange("group_id")),
        "packs": stored(with_packs(encode_deltas(grouping.deltas(members), refs, min_match)), "packs").repartitionByRange("group_id", "pack_id").sortWithinPartitions("group_id", "pack_id"),
        "splitters": splitters,
        "params": spark.range(1).coalesce(1).select(*(F.lit(v).cast(t).alias(c) for c, v, t in (("k", k, "int"), ("min_match_len", min_match, "int"), ("pack_cardinality", grouping.PACK, "int"), ("segment_size", segment_size, "long")))),
    }
    for name, df in tables.items():
        out = df.write.mode(mode).option("compression", "zstd")
        (out.partitionBy("batch") if name in ("contigs", "segments") else out).parquet(f"{path}/{name}")
    return Collection(spark, path)


class Collection:
    """The queries over what create() wrote."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        row = self.table("params").first()
        self.k, self.min_match = row["k"], row["min_match_len"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def samples(self, prefix: str = "") -> DataFrame:
        return self.table("samples").filter(F.col("sample").startswith(prefix)).orderBy("sample")

    def _known(self, df: DataFrame, what: str) -> DataFrame:
        """``df``, or an error where it is empty."""
        if df.isEmpty():
            raise KeyError(f"no such {what}")
        return df

    def batch(self, sample: str) -> int:
        """The folder of a sample's rows."""
        return self._known(self.table("samples").filter(F.col("sample") == sample), f"sample: {sample}").first()["batch"]

    def contigs(self, sample: str) -> DataFrame:
        return self.table("contigs").filter((F.col("batch") == self.batch(sample)) & (F.col("sample") == sample)).select("contig", "length")

    def segments(self, sample: str | None = None, contig=None, group: int | None = None) -> DataFrame:
        out = self.table("segments")
        if sample is not None:
            out = out.filter((F.col("batch") == self.batch(sample)) & (F.col("sample") == sample))
        for name, value in (("contig", contig), ("group_id", group)):
            out = out if value is None else out.filter(F.col(name) == value)
        return out.drop("batch")

    def length(self, sample: str, contig) -> int:
        row = self._known(self.segments(sample, contig), f"contig: {sample} {contig}")
        own = F.when(F.col("part") == 0, F.col("raw_length")).otherwise(F.greatest(F.col("raw_length") - self.k, F.lit(0)))
        return row.agg(F.sum(own)).first()[0]

    def sequences(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` segments with seq as the contig has it. Groups that none needs are
        not read into the decoder; members of raw groups and references are not coded.
        """
        ids = stored(wanted.select("group_id", "in_group_id").distinct(), "wanted")
        refs = decode_refs(self.table("refs").join(ids.select("group_id").distinct(), "group_id", "left_semi"))
        refs = stored(refs, "wanted-refs")
        packs = ids.filter((F.col("group_id") < grouping.FIRST_GROUP) | (F.col("in_group_id") > 0)).select("group_id", grouping.pack_of(F.col("group_id"), F.col("in_group_id")).alias("pack_id")).distinct()
        coded = from_packs(self.table("packs").join(packs, ["group_id", "pack_id"], "left_semi")).join(ids, ["group_id", "in_group_id"], "left_semi")
        text = decode_deltas(coded, refs, self.min_match).unionByName(refs.select("group_id", F.lit(0).cast("long").alias("in_group_id"), "seq"))
        seq = F.when(F.col("is_rev_comp"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
        return wanted.join(text, ["group_id", "in_group_id"]).withColumn("seq", seq)

    def rebuilt(self, wanted: DataFrame) -> DataFrame:
        """sample, contig and seq of whole contigs from their segments."""
        own = F.when(F.col("part") == 0, F.col("seq")).otherwise(F.substr("seq", F.lit(self.k + 1)))
        rows = self.sequences(wanted).withColumn("own", own).groupBy("sample", "contig").agg(F.array_sort(F.collect_list(F.struct("part", "own"))).alias("s"))
        return rows.select("sample", "contig", F.array_join(F.transform("s", lambda x: x["own"]), "").alias("seq"))

    def contig(self, sample: str, contig) -> str:
        return self._known(self.rebuilt(self.segments(sample, contig)), f"contig: {sample} {contig}").first()["seq"]

    def sample(self, *samples: str) -> DataFrame:
        """All contigs of the samples."""
        return self.rebuilt(self.table("segments").filter(F.col("sample").isin(*samples)))

    def by_prefix(self, prefix: str) -> DataFrame:
        return self.rebuilt(self.table("segments").filter(F.col("sample").startswith(prefix)))

    def range(self, sample: str, contig, start: int, end: int) -> str:
        """Bases [start, end) of a contig, cut at its end; only the segments that overlap
        are fetched.
        """
        all_ = self._known(self.segments(sample, contig), f"contig: {sample} {contig}")
        near = segments.positions(all_, self.k).filter((F.col("seg_end") > start) & (F.col("seg_start") < end))
        if start >= end or near.isEmpty():
            return ""
        begin = near.agg(F.min("seg_start")).first()[0]
        own = F.when(F.col("part") == 0, F.col("seq")).otherwise(F.substr("seq", F.lit(self.k + 1)))
        parts = self.sequences(near).withColumn("own", own).agg(F.array_sort(F.collect_list(F.struct("part", "own"))).alias("s"))
        text = parts.select(F.array_join(F.transform("s", lambda x: x["own"]), "").alias("seq")).first()["seq"]
        return text[max(0, start) - begin : end - begin]

    def reference(self, group: int) -> str:
        return self._known(decode_refs(self.table("refs").filter(F.col("group_id") == group)), f"group: {group}").first()["seq"]

    def part(self, group: int, pack: int) -> bytes:
        """The items of one pack as they are stored, with an end after each."""
        row = self._known(self.table("packs").filter((F.col("group_id") == group) & (F.col("pack_id") == pack)), f"pack: {group} {pack}").first()
        return codec.decompress(bytes(row["data"])) if row["raw_size"] else bytes(row["data"])

    def group_statistics(self) -> DataFrame:
        """group_id, total, references and others of each group."""
        ref = (F.col("group_id") >= grouping.FIRST_GROUP) & (F.col("in_group_id") == 0)
        return self.table("segments").groupBy("group_id").agg(F.count("*").alias("total"), F.count_if(ref).alias("references"), F.count_if(~ref).alias("others")).orderBy("group_id")

    def ranges(self, wanted: DataFrame) -> DataFrame:
        """sample, contig, start_at, end_at and seq of ranges, all at once: cut at the
        contig's end, none where start_at is not below end_at. Only the
        packs of segments that overlap a range are read.
        """
        own = segments.positions(self.table("segments").drop("batch").join(wanted.select("sample", "contig").distinct(), ["sample", "contig"], "left_semi"), self.k)
        near = own.join(wanted, ["sample", "contig"]).filter((F.col("seg_end") > F.col("start_at")) & (F.col("seg_start") < F.col("end_at")) & (F.col("start_at") < F.col("end_at")))
        piece = F.when(F.col("part") == 0, F.col("seq")).otherwise(F.substr("seq", F.lit(self.k + 1)))
        rows = self.sequences(near).withColumn("own", piece).groupBy("sample", "contig", "start_at", "end_at").agg(F.min("seg_start").alias("begin"), F.array_sort(F.collect_list(F.struct("part", "own"))).alias("s"))
        text = F.array_join(F.transform("s", lambda x: x["own"]), "")
        first = F.greatest(F.col("start_at"), F.lit(0))
        return rows.select("sample", "contig", "start_at", "end_at", F.substr(text, (first - F.col("begin") + 1).cast("int"), (F.col("end_at") - first).cast("int")).alias("seq"))

    def storage_statistics(self) -> DataFrame:
        """stream (ref or delta), raw, packed and parts: bases of the references and of
        what is told by differences, what they take, and in how many parts.
        """
        refs = self.table("refs").agg(F.lit("ref").alias("stream"), F.sum("raw_size").alias("raw"), F.sum(F.length("data")).cast("long").alias("packed"), F.count("*").alias("parts"))
        held = self.table("segments").filter((F.col("group_id") < grouping.FIRST_GROUP) | (F.col("in_group_id") > 0))
        raw = held.groupBy("group_id", "in_group_id").agg(F.first("raw_length").alias("n")).agg(F.sum("n").alias("raw"))
        packs = self.table("packs").agg(F.sum(F.length("data")).cast("long").alias("packed"), F.count("*").alias("parts"))
        return refs.unionByName(raw.join(F.broadcast(packs)).select(F.lit("delta").alias("stream"), "raw", "packed", "parts"))
