"""Ingest of FASTA files as a stream: each micro-batch is segmented, grouped against what
earlier batches registered, coded against their references, and written as a folder of
its own in every table of the collection.

Tables: samples, contigs, segments, groups (the registry: new keys of a batch), ids (what
has an id in a group), refs and packs by batch; splitters and params once, from the first
sample of the first batch. A batch reads only folders of smaller numbers and replaces its
own, so one that is run again after a failure gives the same rows. A sample belongs to one
batch; one that comes again in a later batch is refused, as its segments would have to be
told from those that are stored. finalize() joins the packs that batches left half full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bases import clean, contig_of, sample_of
from ..operators import grouping, segments
from ..plans import collection
from ..plans.tables import exists, stored


def contig_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """sample, contig and seq of the records of files as they arrive; the number of
    files in a batch bounds what is in flight.
    """
    text = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(path)
    body = F.regexp_replace("value", r"^\s*>", "")
    header = F.trim(F.regexp_extract(body, r"^([^\r\n]*)", 1))
    raw = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"[\r\n]", "")
    rows = text.select(header.alias("header"), clean(raw).alias("seq")).filter("header != '' AND seq != ''")
    return rows.select(sample_of(F.col("header")).alias("sample"), contig_of(F.col("header")).alias("contig"), "seq")


def earlier(spark: SparkSession, path: str, name: str, number: int) -> DataFrame | None:
    """What batches of smaller numbers wrote of a table; none if there is nothing."""
    if not exists(spark, f"{path}/{name}"):
        return None
    return spark.read.parquet(f"{path}/{name}").filter(F.col("batch") < number)


def registry(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """group_id, key_front and key_back that batches before ``number`` registered."""
    old = earlier(spark, path, "groups", number)
    return None if old is None else registry_update(old.select("key_front", "key_back", "group_id"))


def add_batch(contigs: DataFrame, path: str, number: int, k: int = 31, segment_size: int = 60_000, min_match: int = 20) -> None:
    """Adds the contigs of a batch to the collection at ``path``."""
    spark = contigs.sparkSession
    contigs = stored(contigs.select("sample", "contig", "seq"), "batch")
    if contigs.isEmpty():
        return
    old = earlier(spark, path, "samples", number)
    if old is not None:
        refuse_known(contigs, old)
    if old is None or old.isEmpty():
        split = segments.determine_splitters(segments.first_sample(contigs), k, segment_size)["splitters"]
        split.write.mode("overwrite").parquet(f"{path}/splitters")
        params = spark.createDataFrame([(k, min_match, grouping.PACK, segment_size)], "k int, min_match_len int, pack_cardinality int, segment_size long")
        params.write.mode("overwrite").parquet(f"{path}/params")
    split = spark.read.parquet(f"{path}/splitters")
    keyed = stored(grouping.with_keys(segments.segment(contigs, split, k)), "keyed")
    groups = registry(spark, path, number)
    fresh = keyed if groups is None else grouping.not_registered(keyed, groups)
    top = None if groups is None else groups.agg(F.max("group_id")).first()[0]
    new = stored(grouping.group_table(fresh, grouping.FIRST_GROUP if top is None else top + 1), "groups")
    every = new if groups is None else new.unionByName(groups)
    placed_before = earlier(spark, path, "segments", number)
    before = 0 if placed_before is None else placed_before.filter(F.col("group_id") < grouping.FIRST_GROUP).count()
    placed = segments.with_sequence(grouping.assign_groups(keyed, every, before), contigs)
    placed = placed.withColumn("seq", grouping.oriented(F.col("seq")))
    known = earlier(spark, path, "ids", number)
    members = stored(grouping.in_group_ids(placed, None if known is None else known.drop("batch")), "members")
    own_refs = stored(grouping.references(members).join(new, "group_id", "left_semi"), "refs")
    refs = own_refs
    old_refs = earlier(spark, path, "refs", number)
    if old_refs is not None:
        refs = refs.unionByName(collection.decode_refs(old_refs.join(members.select("group_id").distinct(), "group_id", "left_semi")))
    ids = members.filter(F.col("group_id") >= grouping.FIRST_GROUP).select("group_id", "digest", "in_group_id").distinct()
    deltas = grouping.deltas(members)
    if known is not None:
        ids = ids.join(known, ["group_id", "digest"], "left_anti")
        # Sequences that a group held before are in a pack already.
        deltas = deltas.join(known.select("group_id", "in_group_id").distinct(), ["group_id", "in_group_id"], "left_anti")
    tables = {
        "contigs": contigs.select("sample", "contig", F.length("seq").cast("long").alias("length")),
        "segments": members.select("sample", "contig", "part", "start", "raw_length", "group_id", "in_group_id", "is_rev_comp"),
        "groups": new,
        "ids": ids,
        "refs": collection.encode_refs(own_refs),
        "packs": collection.with_packs(collection.encode_deltas(deltas, refs, min_match)),
        # Last: a batch whose samples are listed is whole.
        "samples": contigs.select("sample").distinct(),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/batch={number}")


def refuse_known(batch: DataFrame, old: DataFrame) -> None:
    """An error if a sample of the batch is in ``old``."""
    again = batch.select("sample").distinct().join(old.select("sample").distinct(), "sample").limit(1).collect()
    if again:
        raise ValueError(f"the sample {again[0]['sample']} came in an earlier batch")


def _started(stream: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None) -> StreamingQuery:
    def both(batch: DataFrame, number: int) -> None:
        add(batch, number)
        if on_batch:
            on_batch(batch, number)

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_collection(stream: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, **parameters: int) -> StreamingQuery:
    """Starts a query that adds each batch of contigs to the collection at ``path``;
    ``parameters``: k, segment_size and min_match of add_batch().
    """
    return _started(stream, lambda batch, number: add_batch(batch, path, number, **parameters), checkpoint, on_batch)


def ingest(stream: DataFrame, table: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts a query that appends each batch as it is to the Parquet folder ``table`` under
    its batch number, without a collection, and refuses samples of earlier batches.
    """

    def add(batch: DataFrame, number: int) -> None:
        if exists(batch.sparkSession, table):
            refuse_known(batch, batch.sparkSession.read.parquet(table).filter(F.col("batch") < number))
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return _started(stream, add, checkpoint, on_batch)


def finalize(spark: SparkSession, path: str) -> collection.Collection:
    """Joins what several batches wrote of a pack into one part, and opens the collection.
    The new packs are written whole beside the old ones, which then go.
    """
    packs = spark.read.parquet(f"{path}/packs")
    last = packs.agg(F.max("batch")).first()[0]
    whole = collection.with_packs(collection.from_packs(packs)).withColumn("batch", F.lit(last))
    whole.write.mode("overwrite").partitionBy("batch").option("compression", "zstd").parquet(f"{path}/packs.new")
    at, fresh = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in ("packs", "packs.new"))
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(at, True)
    system.rename(fresh, at)
    return collection.Collection(spark, path)


def registry_update(*batches: DataFrame) -> DataFrame:
    """key_front, key_back and group_id of all; the lower number wins."""
    rows = batches[0]
    for more in batches[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("key_front", "key_back").agg(F.min("group_id").alias("group_id"))
