"""SimHash near-duplicates, linked by searches in BK-trees.

Fingerprints: a text's A-Z are lower-cased, its words are runs of other characters
than ASCII white space, and each 4-word shingle (repeats included; the whole
sequence if it is shorter) is hashed by XXH64 with seed 42. A bit is set if it is in
more than half of the hashes; a text without words has fingerprint zero.

Links: two fingerprints link at ``radius`` or fewer differing bits. Of ``blocks``
blocks of bits at most ``radius`` can differ, so linked fingerprints agree in some
choice of ``blocks - radius`` whole blocks; each such choice and its value names a
shard. In a shard a BK-tree hangs every fingerprint below its parent under their
distance, and a search follows only the edges within ``radius`` of its own distance.
A shard of more than ``shard_rows`` is dealt into parts: each part's tree meets the
queries of every part in a task of its own, so that no task holds a hot shard.
Each task returns a spanning forest of the links that it found, never all pairs.
Equal fingerprints are one node from the start.

Defined results: null text counts as empty; documents with fingerprint zero are
linked like others; repeated rows and ids give one row each; documents with a null
id are fingerprinted and linked, and do not name a component unless all its ids are
null; an empty table gives no rows. Only ``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_FOLD, dropped, spread_join, stored, table
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Fingerprints in a part of a shard, as a mean.
SHARD_ROWS = 1024


def fingerprint(text: str | None, words: int = SHINGLE) -> bytes:
    """The eight bytes of a text's fingerprint, highest bits first."""
    from xxhash import xxh64_digest

    found = (text or "").encode().translate(ASCII_FOLD).split()
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if len(found) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK].tolist(), (ends[i : i + CHUNK] - 1).tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(starts)).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column(2)]
        signed = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed)], names=["_hf_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_hf_id, text_hash and fp (the fingerprint as a signed long) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("_hf_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_hf_text"))
    return rows.mapInArrow(_fingerprints, "_hf_id long, text_hash long, fp long")


class BKTrees:
    """The BK-trees of many groups, built and searched level by level."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray, members: np.ndarray) -> None:
        """``members``: places of the fingerprints that are nodes, by group and order."""
        self.prints = prints
        first = np.ones(len(members), bool)
        first[1:] = groups[members[1:]] != groups[members[:-1]]
        self.root = np.full(int(groups.max(initial=-1)) + 1, -1, np.int64)
        self.root[groups[members[first]]] = members[first]
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left = members[~first]
        at = self.root[groups[left]]
        while len(left):
            edge = at * 65 + np.bitwise_count(prints[left] ^ prints[at])
            key, new, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            children.append(left[new])  # the first in order becomes the child
            at = left[new][back]
            below = np.ones(len(left), bool)
            below[new] = False
            left, at = left[below], at[below]
        keys, children = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[order], children[order]

    def search(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) within ``radius``."""
        at = self.root[groups[queries]]
        queries, at = queries[at >= 0], at[at >= 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(queries):
            far = np.bitwise_count(self.prints[queries] ^ self.prints[at]).astype(np.int64)
            near = far <= radius
            found.append((queries[near], at[near]))
            lo = np.searchsorted(self.keys, at * 65 + np.maximum(far - radius, 0), "left")
            hi = np.searchsorted(self.keys, at * 65 + np.minimum(far + radius, 64), "right")
            n = hi - lo
            queries = np.repeat(queries, n)
            at = self.children[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(queries))]
        return np.concatenate([x[0] for x in found] or [queries]), np.concatenate([x[1] for x in found] or [queries])


def forest(prints: np.ndarray, groups: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each group: between all its rows if a is b,
    else between those of part a (the tree) and of part b (the queries).
    """
    trees = BKTrees(prints, groups, np.flatnonzero(owner == a))
    queries = np.flatnonzero(owner == b)
    root = np.arange(len(prints))
    for i in range(0, len(queries), 1024):
        q, t = trees.search(queries[i : i + 1024], groups, radius)
        while True:
            x, y = root[q], root[t]
            open_ = x != y
            if not open_.any():
                break
            q, t, x, y = q[open_], t[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    hung = np.flatnonzero(root != np.arange(len(prints)))
    return hung, root[hung]


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """For each choice of ``blocks - radius`` blocks its number and the bits in it."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    choices = [sum(c) for c in combinations(masks, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in choices]
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])


def link_forest(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a and b: links between distinct fingerprints (column fp) that connect all that
    are within ``radius``, directly or by others.
    """
    if blocks is None:  # finer shards for more fingerprints; none loses a link
        n = prints.count()
        blocks = radius + (1 if n < 1 << 22 else 2 if n < 1 << 30 else 3)
    keyed = prints.select("fp", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("k")).select("fp", "k.choice", "k.bits")
    hot = keyed.groupBy("choice", "bits").count().filter(F.col("count") > shard_rows).select("choice", "bits", F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    dealt = keyed.join(hot, ["choice", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, "own").alias("a"), F.greatest(j, "own").alias("b"))))
    tasks = dealt.select("fp", "choice", "bits", "own", each.alias("t")).select("fp", "choice", "bits", "own", "t.a", "t.b")
    key = ["choice", "bits", "a", "b"]
    # Spreads the shards over more tasks than one for each kind of choice would.
    tasks = tasks.repartition(*key).sortWithinPartitions(*key, "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def run(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, 1:5] != rows[:-1, 1:5]).any(axis=1)
            x, y = forest(rows[:, 0].view(np.uint64), np.cumsum(new) - 1, rows[:, 5], rows[:, 3], rows[:, 4], radius)
            return pa.RecordBatch.from_arrays([pa.array(rows[x, 0]), pa.array(rows[y, 0])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "choice", "bits", "a", "b", "own")], axis=1))
            if sum(map(len, kept)) >= 32_768:
                rows = np.concatenate(kept)
                last = (rows[:, 1:5] == rows[-1, 1:5]).all(axis=1)
                cut = len(rows) - int(last[::-1].argmin()) if not last.all() else 0
                if cut:
                    yield run(np.ascontiguousarray(rows[:cut]))
                kept = [rows[cut:]]
        if kept:
            yield run(np.ascontiguousarray(np.concatenate(kept)))

    return tasks.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each document: ``id_col``, fingerprint (16 hex digits), component_id
    (the least id that is reachable over links), root (the component's fingerprint
    node) and text_hash (XXH64 of the whole text).
    """
    by_doc = stored(fingerprints(docs, id_col, text_col), "simhash-docs")
    prints = stored(by_doc.groupBy("fp").agg(F.min("_hf_id").alias("least"), F.count("*").alias("copies")), "simhash-prints")
    linked = stored(components(link_forest(prints, radius, blocks, shard_rows), "a", "b"), "simhash-components")
    named = linked.join(prints, linked["node"] == prints["fp"]).groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    roots = spread_join(linked, named, ["root"], "nodes", linked.count()).select(F.col("node").alias("fp"), "root", "component_id")
    every = prints.join(roots, "fp", "left").select("fp", "copies", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    every = stored(every, "simhash-roots")
    for df in (linked, prints):
        dropped(docs.sparkSession, df)
    out = spread_join(by_doc, every, ["fp"], "copies", every.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    return out.select(F.col("_hf_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs``, all columns, with one document of each component: that of the least
    id (null last), then text hash; of rows with the same id and text, one.
    """
    found = stored(near_duplicates(docs, id_col, text_col, radius, blocks, shard_rows).withColumnRenamed(id_col, "_hf_id"), "simhash-found")
    row = F.struct(F.col("_hf_id").isNull(), "_hf_id", "text_hash")
    winners = found.groupBy("root").agg(F.min(row).alias("winner"), F.count("*").alias("size"))
    losers = spread_join(found, winners, ["root"], "size", found.count()).filter(row != F.col("winner")).select("_hf_id", "text_hash").distinct()
    same = docs[id_col].cast("long").eqNullSafe(losers["_hf_id"]) & (F.xxhash64(docs[text_col]) == losers["text_hash"])
    kept = docs.join(losers, same, "left_anti")
    if found.groupBy("_hf_id", "text_hash").count().filter("count > 1").isEmpty():
        return kept
    # Whole rows in one column: no name of a caller's column can clash.
    one = kept.select(F.struct("*").alias("_hf_row"), F.col(id_col).alias("_hf_id"), F.xxhash64(text_col).alias("_hf_hash")).dropDuplicates(["_hf_id", "_hf_hash"])
    return one.select("_hf_row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("root", "text_hash")
