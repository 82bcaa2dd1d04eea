"""Choices among groups by the cost of coding a segment against their references: the
group of a segment that has one k-mer only, and the place where a segment is parted
between two groups. References and segments meet by group, so that a reference is indexed
once for all segments that are measured against it; costs come from Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.bases import reverse_complement
from .grouping import terminators

PLACE = ["sample", "contig", "part"]


def _measured(rows: DataFrame, refs: DataFrame, min_match: int, measure: Callable, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """``rows`` (with group_id and seq) without seq and with column ``name``: what
    ``measure`` (of the reference's Differ and the segment's codes) gives.
    """
    kept = [c for c in rows.columns if c != "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, differ = None, None
        for batch in batches:
            out = []
            for group, ref, seq in zip(batch.column("group_id").to_pylist(), batch.column("ref"), batch.column("seq"), strict=True):
                if group != last:
                    last, differ = group, codec.Differ(codec.to_codes(ref.as_py()), min_match)
                out.append(measure(differ, codec.to_codes(seq.as_py())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, arrow)], names=[*kept, name])

    both = rows.join(refs.select("group_id", F.col("seq").alias("ref")), "group_id")
    # Dealt by group and segment: a group of many segments is no single task.
    both = both.repartition("group_id", *PLACE).sortWithinPartitions("group_id").select(*kept, "seq", "ref")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return both.mapInArrow(run, f"{schema}, {name} {kind}")


def one_sided_groups(segments: DataFrame, groups: DataFrame, refs: DataFrame, min_match: int) -> DataFrame:
    """sample, contig, part, key_front, key_back, is_rev_comp, group_id and estimate of
    every segment with one k-mer: of the groups whose key holds it, that with the least
    estimated cost (ties: the smaller key, then forward), if the cost is the segment's
    length less 16, or its length if that is below 16, or less; else the key is the k-mer
    alone, by its direction, and group_id is null. ``segments`` hold their letters.
    """
    only_front = F.col("front").isNotNull()
    one = segments.filter(F.col("front").isNull() != F.col("back").isNull())
    # A segment with the k-mer at its end is looked at from there.
    one = one.select(*PLACE, F.coalesce("front", "back").alias("kmer"), F.when(only_front, F.col("front_is_dir")).otherwise(~F.col("back_is_dir")).alias("direct"), only_front.alias("only_front"), F.length("seq").cast("long").alias("length"), F.when(only_front, F.col("seq")).otherwise(reverse_complement(F.col("seq"))).alias("seq"))
    full = groups.filter("key_front IS NOT NULL AND key_back IS NOT NULL").select("group_id", F.col("key_front").alias("f"), F.col("key_back").alias("b"))
    ends = full.select("group_id", "f", "b", F.col("f").alias("kmer"), F.lit(False).alias("turned")).unionByName(full.filter("f != b").select("group_id", "f", "b", F.col("b").alias("kmer"), F.lit(True).alias("turned")))
    near = one.join(ends, "kmer").withColumn("seq", F.when(F.col("turned"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    told = _measured(near.select(*PLACE, "group_id", "f", "b", "turned", "length", "seq"), refs, min_match, lambda differ, seq: differ.estimate(seq), "estimate", "bigint", pa.int64())
    bound = F.when(F.col("length") < 16, F.col("length")).otherwise(F.col("length") - 16)
    best = told.filter(F.col("estimate") <= bound).groupBy(*PLACE).agg(F.min(F.struct("estimate", "f", "b", "turned", "group_id")).alias("x"))
    out = one.drop("seq", "length").join(best, PLACE, "left")
    found, direct = F.col("x").isNotNull(), F.col("direct")
    turned = F.when(found, F.col("x.turned")).otherwise(~direct)
    return out.select(
        *PLACE,
        F.when(found, F.col("x.f")).when(direct, F.col("kmer")).alias("key_front"),
        F.when(found, F.col("x.b")).when(~direct, F.col("kmer")).alias("key_back"),
        F.when(F.col("only_front"), turned).otherwise(~turned).alias("is_rev_comp"),
        F.col("x.group_id").alias("group_id"),
        F.col("x.estimate").alias("estimate"),
    )


def middles(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Segments with two different k-mers, and middle (the least k-mer that makes a key
    with both), left_group and right_group, the groups of these keys; others are left out.
    """
    t = terminators(groups)
    two = segments.filter("front IS NOT NULL AND back IS NOT NULL AND front != back")
    pairs = two.select("front", "back").distinct()
    a = t.select(F.col("kmer").alias("front"), F.col("other").alias("middle"))
    b = t.select(F.col("kmer").alias("back"), F.col("other").alias("middle"))
    found = pairs.join(a, "front").join(b, ["back", "middle"]).groupBy("front", "back").agg(F.min("middle").alias("middle"))
    keys = groups.filter("key_front IS NOT NULL AND key_back IS NOT NULL")
    for side, end in (("left_group", "front"), ("right_group", "back")):
        own = keys.select(F.col("group_id").alias(side), F.col("key_front").alias("_lo"), F.col("key_back").alias("_hi"))
        found = found.withColumns({"_lo": F.least(end, "middle"), "_hi": F.greatest(end, "middle")}).join(own, ["_lo", "_hi"]).drop("_lo", "_hi")
    return two.join(found, ["front", "back"])


def best_splits(segments: DataFrame, groups: DataFrame, refs: DataFrame, k: int, min_match: int) -> DataFrame:
    """sample, contig, part, middle, left_group, right_group, decision and place: whether
    a segment is coded best by the group left of its middle k-mer, by the right one, or
    parted at ``place``; "none" where it is shorter than two pieces.
    """
    rows = middles(segments, groups).select(*PLACE, "front", "back", "middle", "left_group", "right_group", "seq")
    sides = []
    for side, turned, at_start in (("left", F.col("front") >= F.col("middle"), True), ("right", F.col("middle") >= F.col("back"), False)):
        seq = F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
        own = rows.select(*PLACE, F.col(f"{side}_group").alias("group_id"), turned.alias("turned"), seq.alias("seq"))
        costs = None
        for way in (False, True):  # turned segments are charged at the other end of a token
            some = _measured(own.filter(F.col("turned") == way), refs, min_match, lambda differ, codes, at=at_start != way: differ.costs(codes, at).tolist(), f"{side}_costs", "array<int>", pa.list_(pa.int32()))
            costs = some if costs is None else costs.unionByName(some)
        sides.append(costs.select(*PLACE, F.when(F.col("turned"), F.reverse(f"{side}_costs")).otherwise(F.col(f"{side}_costs")).alias(f"{side}_costs")))
    both = rows.drop("seq", "front", "back").join(sides[0], PLACE).join(sides[1], PLACE)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.drop("left_costs", "right_costs").schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [codec.best_split(a.values.to_numpy(), b.values.to_numpy(), k) for a, b in zip(batch.column("left_costs"), batch.column("right_costs"), strict=True)]
            kept = [c for c in batch.schema.names if not c.endswith("_costs")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.int64())], names=[*kept, "decision", "place"])

    return both.mapInArrow(decide, f"{schema}, decision string, place bigint")
