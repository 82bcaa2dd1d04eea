"""Comparison of two collections: boundaries, grouping, references, orientation, packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import FIRST_GROUP, PACK

KEY = ["sample", "contig", "part"]


def _two(a: DataFrame, b: DataFrame, on: list[str], values: list[str], how: str) -> DataFrame:
    left = a.select(*on, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("in_a"))
    right = b.select(*on, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("in_b"))
    return left.join(right, on, how)


def compare_boundaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every segment place of either with status same, differs, only_a or only_b."""
    both = _two(a, b, KEY, ["raw_length"], "full_outer")
    status = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(F.col("raw_length_a") == F.col("raw_length_b"), "same").otherwise("differs")
    return both.select(*KEY, F.col("raw_length_a").cast("long").alias("length_a"), F.col("raw_length_b").cast("long").alias("length_b"), status.alias("status"))


def membership(members: DataFrame) -> DataFrame:
    """group_id, size and members: a digest of which places are in each group, whatever
    its number. Places are hashed and summed, so no group is gathered into a row.
    """
    place = F.concat_ws("|", *KEY)
    h = lambda s: F.xxhash64(F.lit(s), place).cast("decimal(38,0)")
    return members.groupBy("group_id").agg(F.count("*").alias("size"), F.concat_ws(":", F.sum(h(0)).cast("string"), F.sum(h(1)).cast("string")).alias("members"))


def compare_grouping(a: DataFrame, b: DataFrame) -> DataFrame:
    """size, in_a and in_b: how many groups of each have a given membership, by size."""
    counts = lambda d, n: membership(d).groupBy("size", "members").agg(F.count("*").alias(n))
    both = counts(a, "na").join(counts(b, "nb"), ["size", "members"], "full_outer")
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return both.groupBy("size").agg(F.sum(F.least(na, nb)).alias("same"), F.sum(na - F.least(na, nb)).alias("only_a"), F.sum(nb - F.least(na, nb)).alias("only_b"))


def compare_references(a: DataFrame, b: DataFrame) -> DataFrame:
    """For groups of equal membership, the places of both references and whether equal."""

    def refs(d: DataFrame, s: str) -> DataFrame:
        place = F.concat_ws("|", *KEY)
        ref = d.filter((F.col("group_id") >= FIRST_GROUP) & (F.col("in_group_id") == 0)).groupBy("group_id").agg(F.min(place).alias(f"ref_{s}"))
        return membership(d).join(ref, "group_id").select("members", f"ref_{s}", F.col("group_id").alias(f"group_{s}"))

    both = refs(a, "a").join(refs(b, "b"), "members")
    return both.select("group_a", "group_b", "ref_a", "ref_b", (F.col("ref_a") == F.col("ref_b")).alias("same"))


def compare_orientations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places in both whose orientation differs."""
    both = _two(a, b, KEY, ["is_rev_comp"], "inner")
    return both.filter(F.col("is_rev_comp_a") != F.col("is_rev_comp_b")).select(*KEY, "is_rev_comp_a", "is_rev_comp_b")


def pack_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.ceil(F.countDistinct("in_group_id") / PACK).cast("long").alias("packs"))


def compare_packs(a: DataFrame, b: DataFrame) -> DataFrame:
    """group_id, packs_a and packs_b of the groups of either."""
    both = _two(pack_counts(a), pack_counts(b), ["group_id"], ["packs"], "full_outer")
    return both.select("group_id", F.coalesce("packs_a", F.lit(0)).cast("long").alias("packs_a"), F.coalesce("packs_b", F.lit(0)).cast("long").alias("packs_b"))


def compare_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Parts (stream, part_id, data) of either by a short digest of their content."""
    digest = F.substring(F.sha2("data", 256), 1, 16)
    both = _two(a.withColumn("digest", digest), b.withColumn("digest", digest), ["stream", "part_id"], ["digest"], "full_outer")
    status = F.when(F.col("digest_a").isNull(), "only_b").when(F.col("digest_b").isNull(), "only_a").when(F.col("digest_a") == F.col("digest_b"), "same").otherwise("differs")
    return both.select("stream", "part_id", "digest_a", "digest_b", status.alias("status"))
