"""k-mers of contigs, and the sets that splitters are chosen from.

A contig table has sample, contig and seq (letters; others than A, C, G and T break
k-mers). k-mers are told in Arrow batches: two-bit codes of all windows come from those
of half as many letters by shifts of whole arrays, so a window costs log k steps and no
string; contigs are worked on by blocks of BLOCK letters (many short ones, or a part of
a long one) and never cross a shuffle. Sets of k-mers of up to EXACT_K bases are told
exactly by a bit for each, so that what depends on one contig and such a set needs no
join and no shuffle either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from ..functions import codec
from ..functions.bases import check_k
from .bloom import Bloom, Exact

CONTIG = ["sample", "contig"]
#: Letters of a contig that are worked on at a time, and rows of a batch that goes out.
BLOCK = 1 << 20
#: The longest k-mers whose sets are told by a bit for each (16 MB unpacked).
EXACT_K = 12


def windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, k-mer and reverse complement of every window of ``k`` codes below 4."""
    n = len(codes) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    places = np.flatnonzero(bad[k:] == bad[:-k])
    kind = np.int32 if k <= 15 else np.int64
    one = (codes & 3).astype(kind)
    # Windows of ``size`` letters at every place, forward and turned; first of none.
    size, fwd, rev = 0, np.zeros(len(codes) + 1, kind), np.zeros(len(codes) + 1, kind)
    for bit in bin(k)[2:]:
        if size:  # twice as long: two neighbours
            m = len(codes) - 2 * size + 1
            fwd, rev = fwd[:m] << 2 * size | fwd[size : size + m], rev[size : size + m] << 2 * size | rev[:m]
            size *= 2
        if bit == "1":  # a letter more
            m = len(codes) - size
            fwd, rev = fwd[:m] << 2 | one[size : size + m], (3 - one[size : size + m]) << 2 * size | rev[:m]
            size += 1
    return places, fwd[places], rev[places]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with BLOCK letters at most, or of one row that is longer."""
    row = 0
    while row + 1 < len(offsets):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        yield row, end
        row = end


def windows_in(offsets: np.ndarray, data: np.ndarray, row: int, end: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, place (from 1), k-mer and reverse complement of the windows of a range of
    rows (blocks()), in order; those of a long row come in parts.
    """
    low, high = int(offsets[row]), int(offsets[end])
    if end == row + 1:
        for at in range(low, high - k + 1, BLOCK):
            places, fwd, rev = windows(codec.codes_of(data[at : min(high, at + BLOCK + k - 1)]), k)
            yield np.full(len(places), row), places + (at - low + 1), fwd, rev
        return
    places, fwd, rev = windows(codec.codes_of(data[low:high]), k)
    own = np.repeat(np.arange(row, end), np.diff(offsets[row : end + 1]))[places]
    inside = places + k <= offsets[own + 1] - low
    places, own = places[inside], own[inside]
    yield own, places - (offsets[own] - low) + 1, fwd[inside], rev[inside]


def scanned(seqs: pa.Array, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """windows_in() of all rows of a column of letters."""
    offsets, data = codec.bytes_of(seqs)
    for row, end in blocks(offsets):
        yield from windows_in(offsets, data, row, end, k)


def distinct_kmers(seqs: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row that has any and its distinct canonical k-mers, in order; a long row's are
    put together part by part.
    """
    offsets, data = codec.bytes_of(seqs)
    for row, end in blocks(offsets):
        if end == row + 1:
            held = np.zeros(0, np.int64)
            for _, _, fwd, rev in windows_in(offsets, data, row, end, k):
                held = np.union1d(held, np.minimum(fwd, rev))
            if len(held):
                yield row, held
            continue
        for rows, _, fwd, rev in windows_in(offsets, data, row, end, k):
            kmer = np.minimum(fwd, rev)
            starts = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(rows)]
            for i, j in zip(starts, starts[1:], strict=False):
                if j > i:
                    yield int(rows[i]), np.unique(kmer[i:j])


def own_singles(seqs: pa.Array, k: int, known: Exact | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, place and canonical k-mer of the windows whose k-mer occurs once in its row
    and is not ``known``, for k up to EXACT_K. Long rows are looked at twice, with a
    count for each k-mer that there could be.
    """
    offsets, data = codec.bytes_of(seqs)

    def fresh(row: int, end: int) -> Iterator[tuple[np.ndarray, ...]]:
        for rows, pos, fwd, rev in windows_in(offsets, data, row, end, k):
            kmer = np.minimum(fwd, rev).astype(np.int64)
            some = slice(None) if known is None else ~known.check(kmer)
            yield rows[some], pos[some], kmer[some]

    for row, end in blocks(offsets):
        if end == row + 1 and offsets[end] - offsets[row] > BLOCK:
            times = np.zeros(4**k, np.uint8)
            for _, _, kmer in fresh(row, end):
                value, n = np.unique(kmer, return_counts=True)
                times[value] = np.minimum(times[value] + np.minimum(n, 2), 2)
            for rows, pos, kmer in fresh(row, end):
                one = times[kmer] == 1
                yield rows[one], pos[one], kmer[one]
            continue
        for rows, pos, kmer in fresh(row, end):
            key = (rows - row) << 2 * k | kmer
            order = np.argsort(key)
            changes = np.concatenate([[True], np.diff(key[order]) != 0, [True]]) if len(key) else np.zeros(1, bool)
            one = np.sort(order[changes[:-1] & changes[1:]])
            yield rows[one], pos[one], kmer[one]


def enumerate_kmers(contigs: DataFrame, k: int, fraction: float | None = None, salt: int = 0, near: Broadcast | None = None, palindromes: bool = True) -> DataFrame:
    """sample, contig, pos (from 1), kmer (canonical) and is_dir of every window of
    ``k`` bases; a single pass without a shuffle. With ``fraction`` only k-mers that
    are in the hash sample of that share (the same ones in every contig), with ``near``
    only those that a Bloom filter lets pass, without ``palindromes`` none that equals
    its reverse complement.
    """
    check_k(k)
    rows = contigs.filter(F.length("seq") >= k).select(*CONTIG, "seq")
    schema = StructType(rows.schema.fields[:2]).add("pos", LongType()).add("kmer", LongType()).add("is_dir", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple] = []

            def out() -> pa.RecordBatch:
                row, pos, kmer, direct = (np.concatenate(x) for x in zip(*kept, strict=True))
                kept.clear()
                names = pa.array(row)
                return pa.RecordBatch.from_arrays([batch.column(0).take(names), batch.column(1).take(names), pa.array(pos), pa.array(kmer), pa.array(direct)], names=schema.names)

            for row, pos, fwd, rev in scanned(batch.column(2), k):
                kmer, direct = np.minimum(fwd, rev).astype(np.int64), fwd <= rev
                some = np.ones(len(kmer), bool) if palindromes else fwd != rev
                if fraction is not None:
                    some &= codec.kept_by_hash_columns(kmer, fraction, salt)
                if near is not None:
                    some &= near.value.check(kmer)
                if not some.all():
                    row, pos, kmer, direct = row[some], pos[some], kmer[some], direct[some]
                kept.append((row, pos, kmer, direct))
                if sum(len(x[0]) for x in kept) >= BLOCK:
                    yield out()
            if kept:
                yield out()

    return rows.mapInArrow(run, schema)


def told(spark, values: DataFrame, k: int) -> Broadcast:
    """The set of ``values`` (kmer), exact (k up to EXACT_K), for all tasks."""
    return spark.sparkContext.broadcast(Exact.of_kmers(values, k))


def contig_counts(contigs: DataFrame, k: int) -> DataFrame:
    """counts() of all k-mers of contigs. Short ones are counted where they are made, so
    that a task tells each of them once."""
    if k > EXACT_K:
        return counts(enumerate_kmers(contigs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**k, np.int64)
        for batch in batches:
            for _, _, fwd, rev in scanned(batch.column(0), k):
                kmer = np.minimum(fwd, rev)
                if len(kmer) * 8 < 4**k:
                    value, n = np.unique(kmer, return_counts=True)
                    total[value] += n
                else:
                    total += np.bincount(kmer, minlength=4**k)
        value = np.flatnonzero(total)
        for at in range(0, len(value), BLOCK):
            some = value[at : at + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["kmer", "n"])

    parts = contigs.filter(F.length("seq") >= k).select("seq").mapInArrow(run, "kmer long, n long")
    return parts.groupBy("kmer").agg(F.sum("n").alias("n"))


def sampled(kmer: Column, fraction: float, salt: int = 0) -> Column:
    """Is a k-mer in the hash sample of about ``fraction`` of all?"""

    def run(x):
        import pandas as pd

        return pd.Series(codec.kept_by_hash_columns(x.to_numpy(np.int64), fraction, salt))

    return F.pandas_udf(run, "boolean")(kmer)


def counts(kmers: DataFrame) -> DataFrame:
    """kmer and n; combined before the shuffle."""
    return kmers.groupBy("kmer").agg(F.count("*").alias("n"))


def singletons(kmers: DataFrame) -> DataFrame:
    return counts(kmers).filter("n = 1").select("kmer")


def duplicates(kmers: DataFrame) -> DataFrame:
    return counts(kmers).filter("n > 1").select("kmer")


def contig_singletons(kmers: DataFrame) -> DataFrame:
    """k-mers that occur once in their contig."""
    return kmers.groupBy(*CONTIG, "kmer").agg(F.count("*").alias("n")).filter("n = 1").select(*CONTIG, "kmer")


def novel(kmers: DataFrame, known: DataFrame) -> DataFrame:
    """Singletons of each contig that ``known`` (kmer) does not hold at all."""
    return contig_singletons(kmers).join(known.select("kmer").distinct(), "kmer", "left_anti")


def members(kmers: DataFrame, splitters: DataFrame) -> DataFrame:
    """The occurrences of splitters. Spark broadcasts the set if it is small, as it
    measures, and else joins by a shuffle with its own filter.
    """
    return kmers.join(splitters.select("kmer").distinct(), "kmer", "left_semi")


def occurrences(contigs: DataFrame, k: int, splitters: DataFrame) -> DataFrame:
    """enumerate_kmers(), of the k-mers in ``splitters`` only: an exact set of short ones
    or else a Bloom filter lets the others go where they are made, and for the latter a
    join settles the rest.
    """
    if k <= EXACT_K:
        return enumerate_kmers(contigs, k, near=told(contigs.sparkSession, splitters, k))
    held = contigs.sparkSession.sparkContext.broadcast(Bloom.of_column(splitters, "kmer"))
    return members(enumerate_kmers(contigs, k, near=held), splitters)


def hard_contigs(contigs: DataFrame, k: int, splitters: DataFrame) -> DataFrame:
    """Contigs without any splitter."""
    return contigs.select(*CONTIG).join(occurrences(contigs, k, splitters).select(*CONTIG).distinct(), CONTIG, "left_anti")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference: each row of ``right`` cancels one of ``left``."""
    return left.exceptAll(right)
