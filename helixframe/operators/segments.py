"""Splitter selection and the segmentation of contigs.

Both choose, from the sorted places in a contig, the next one at a least distance from
the last choice. With k-mers of up to kmers.EXACT_K bases this is done where the contig
is, block by block: nothing is moved. For longer ones places are dealt by contig and
sorted, and one pass over the Arrow batches of a partition carries the last choice alone:
a contig of any length takes no more memory than a batch, and its sequence is not moved.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions import codec
from ..plans.tables import stored
from .kmers import CONTIG, EXACT_K, contig_counts, enumerate_kmers, members, novel, occurrences, own_singles, scanned, told
from .ranking import numbered


def spaced(places: Column, gap: Column) -> Column:
    """Of a sorted array of structs with pos, those at ``gap`` or more from the last
    chosen, beginning with the first: the rule, for places that are in one row anyway.
    """
    start = F.struct(F.lit(None).cast("long").alias("last"), F.slice(places, 1, 0).alias("taken"))
    fold = F.aggregate(places, start, lambda acc, x: F.when(acc["last"].isNull() | (x["pos"] - acc["last"] >= gap), F.struct(x["pos"].alias("last"), F.array_append(acc["taken"], x).alias("taken"))).otherwise(acc))
    return fold["taken"]


class Spaced:
    """Of places in order, by row, those at ``gap`` or more from the last chosen of their
    row; goes on from block to block.
    """

    def __init__(self, gap: int) -> None:
        self.gap, self.row, self.last = gap, None, 0

    def take(self, rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which of the places are chosen."""
        if self.gap <= 1 or not len(rows):
            return np.arange(len(rows))
        out, places = [], pos.tolist()
        starts = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(places)]
        for i, end in zip(starts, starts[1:], strict=False):
            if rows[i] != self.row:
                self.row = rows[i]
            else:
                i = bisect_left(places, self.last + self.gap, i, end)
            while i < end:
                out.append(i)
                self.last = places[i]
                i = bisect_left(places, self.last + self.gap, i + 1, end)
        return np.array(out, np.int64)


def _chosen_here(contigs: DataFrame, k: int, segment_size: int, candidates: Callable, to_break: bool = True) -> DataFrame:
    """choose_splitters() where the contigs are: ``candidates`` gives row, place and k-mer
    of a column of letters, in order. ``to_break``: the last one follows the last other
    letter.
    """
    rows = contigs.filter(F.length("seq") >= k).select(*CONTIG, "seq")
    schema = StructType(rows.schema.fields[:2]).add("pos", LongType()).add("kmer", LongType())
    gap = max(segment_size, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaced, taken = Spaced(gap), []
            last, end, end_kmer = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, pos, kmer in candidates(batch.column(2)):
                end[row], end_kmer[row] = pos, kmer
                some = spaced.take(row, pos)
                last[row[some]] = pos[some]
                taken.append((row[some], pos[some], kmer[some]))
            more = np.flatnonzero((end > 0) & (end - last >= k))
            if to_break and len(more):
                offsets, data = codec.bytes_of(batch.column(2))
                brk = [np.flatnonzero(codec.codes_of(data[offsets[r] : offsets[r + 1]]) > 3) for r in more]
                more = more[np.array([not len(b) or end[r] > b[-1] + 1 for r, b in zip(more, brk, strict=True)], bool)]
            taken.append((more, end[more], end_kmer[more]))
            row, pos, kmer = (np.concatenate(x).astype(np.int64) for x in zip(*taken, strict=True))
            names = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(names), batch.column(1).take(names), pa.array(pos), pa.array(kmer)], names=schema.names)

    return rows.mapInArrow(run, schema)


def splitters_among(contigs: DataFrame, wanted: DataFrame, k: int, segment_size: int, to_break: bool = True) -> DataFrame:
    """choose_splitters() among the occurrences of the k-mers of ``wanted`` (kmer)."""
    if k > EXACT_K:
        return choose_splitters(members(enumerate_kmers(contigs, k), wanted), k, segment_size, breaks(contigs) if to_break else None)
    held = told(contigs.sparkSession, wanted, k)

    def candidates(seqs: pa.Array) -> Iterator[tuple]:
        for row, pos, fwd, rev in scanned(seqs, k):
            kmer = np.minimum(fwd, rev)
            some = held.value.check(kmer)
            yield row[some], pos[some], kmer[some]

    return _chosen_here(contigs, k, segment_size, candidates, to_break)


def _by_contig(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CONTIG).sortWithinPartitions(*CONTIG, F.asc_nulls_first("pos"))


def _ends(batch: pa.RecordBatch, last: tuple | None) -> tuple[list[int], tuple | None]:
    """Where a contig begins in a batch (0 too if it is another than the ``last``), and the last."""
    names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    return [i for i, x in enumerate(names) if x != (names[i - 1] if i else last)], names[-1]


def choose_splitters(candidates: DataFrame, k: int, segment_size: int, last_break: DataFrame | None = None) -> DataFrame:
    """sample, contig, pos and kmer of the splitters among candidate occurrences: every
    one at ``segment_size`` (and k) or more from the last, and the rightmost whose
    window follows the last other letter (``last_break``: sample, contig, brk) and does
    not meet the last chosen.
    """
    gap = max(segment_size, k)
    rows = candidates.select(*CONTIG, "pos", "kmer")
    schema = rows.schema
    rows = rows.withColumn("brk", F.lit(None).cast("long"))
    if last_break is not None:  # a row without a place, before those of its contig
        rows = rows.unionByName(last_break.select(*CONTIG, F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("kmer"), F.col("brk").cast("long").alias("brk")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, taken, end, low = None, None, None, 0  # of the contig at hand: last choice, last candidate, break

        def tail() -> pa.RecordBatch | None:
            if end is None or taken is None or end[1] - taken < k or end[1] <= low:
                return None
            return pa.RecordBatch.from_arrays([end[0].column(i) for i in range(4)], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts, latest = _ends(batch, name)
            pos, breaks = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            chosen: list[int] = []
            ended: list[pa.RecordBatch] = []
            fresh = set(starts)
            for i, p in enumerate(pos):
                if i in fresh:
                    if (last := tail()) is not None:
                        ended.append(last)
                    taken, end, low = None, None, 0
                if p is None:
                    low = breaks[i] or 0
                    continue
                if taken is None or p - taken >= gap:
                    taken = p
                    chosen.append(i)
                end = (batch.slice(i, 1), p) if i + 1 == len(pos) or i + 1 in fresh else end
            name = latest
            yield from ended
            if chosen:
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(chosen)) for i in range(4)], names=schema.names)
        if (last := tail()) is not None:
            yield last

    return _by_contig(rows).mapInArrow(run, schema)


def fallback_rows(contigs: DataFrame, chosen: DataFrame, k: int, segment_size: int, fraction: float, salt: int = 0) -> DataFrame:
    """sample, contig, prev_splitter, splitter, pos, kmer and is_dir of the k-mers in the
    hash sample, with the splitter that ends their stretch of the contig and the one
    before it (null for the first). ``chosen`` are the contigs' splitters (sample, contig,
    pos, kmer). Windows that meet the splitter before, and palindromes, do not count;
    after a last splitter that was chosen for the contig's end, what follows it does.
    """
    own = chosen.groupBy(*CONTIG).agg(F.array_sort(F.collect_list(F.struct("pos", "kmer"))).alias("own"))
    # A contig without a splitter has no stretch.
    rows = contigs.filter(F.length("seq") >= k).select(*CONTIG, "seq").join(own, CONTIG).select(*CONTIG, "own", "seq")
    schema = StructType(rows.schema.fields[:2])
    for name in ("prev_splitter", "splitter", "pos", "kmer"):
        schema = schema.add(name, "long")
    schema = schema.add("is_dir", "boolean")
    gap = max(segment_size, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            held = lists.values
            own_pos, own_kmer = (held.field(x).to_numpy(zero_copy_only=False) for x in (0, 1))
            # Splitters of all rows in one order; a row's places are told apart by its number.
            span = 1 << 40
            line = np.repeat(np.arange(batch.num_rows), np.diff(at)) * span + own_pos[at[0] : at[-1]]
            first, last = at[:-1] - at[0], at[1:] - at[0] - 1
            own_pos, own_kmer = own_pos[at[0] : at[-1]], own_kmer[at[0] : at[-1]]
            # After a last splitter that is nearer than the gap, the contig's end has a stretch.
            ended = (last > first) & (own_pos[last] - own_pos[np.maximum(last - 1, 0)] < gap)
            for row, pos, fwd, rev in scanned(batch.column(3), k):
                kmer = np.minimum(fwd, rev).astype(np.int64)
                some = (fwd != rev) & codec.kept_by_hash_columns(kmer, fraction, salt)
                row, pos, kmer, direct = row[some], pos[some], kmer[some], (fwd <= rev)[some]
                here = np.searchsorted(line, row * span + pos)  # of the same place, a k-mer comes before the splitter that it is
                inside = here <= last[row]
                here = np.where(inside, here, last[row])
                before = here > first[row]
                prev = np.where(before, here - 1, 0)
                told_here = np.where(inside, ~before | (pos >= own_pos[prev] + k), ended[row])
                names = pa.array(row[told_here])
                prev_kmer = pa.array(own_kmer[prev][told_here], mask=~before[told_here])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(names), batch.column(1).take(names), prev_kmer, *(pa.array(x[told_here]) for x in (own_kmer[here], pos, kmer, direct))], names=schema.names)

    return rows.mapInArrow(run, schema)


def breaks(contigs: DataFrame) -> DataFrame:
    """sample, contig and brk, the place (from 1) of the last letter that is no base."""
    return contigs.select(*CONTIG, F.length(F.rtrim("seq", F.lit("ACGT"))).alias("brk"))


def determine_splitters(contigs: DataFrame, k: int, segment_size: int) -> dict[str, DataFrame]:
    """splitters (kmer), singletons (kmer) and duplicates (kmer) of a set of contigs."""
    number = contig_counts(contigs, k)
    single, more = (number.filter(x).select("kmer") for x in ("n = 1", "n > 1"))
    return {"splitters": splitters_among(contigs, single, k, segment_size).select("kmer").distinct(), "singletons": single, "duplicates": more}


def first_sample(contigs: DataFrame) -> DataFrame:
    """The contigs of the least sample name."""
    return contigs.join(F.broadcast(contigs.agg(F.min("sample").alias("sample"))), "sample", "left_semi")


def new_splitters(contigs: DataFrame, kmers: DataFrame, known: DataFrame, k: int, segment_size: int) -> DataFrame:
    """Splitters for contigs from their own singletons that ``known`` does not hold;
    ``kmers`` are those of the contigs.
    """
    if k <= EXACT_K:
        held = told(contigs.sparkSession, known, k)
        return _chosen_here(contigs, k, segment_size, lambda seqs: own_singles(seqs, k, held.value))
    own = kmers.join(novel(kmers, known), [*CONTIG, "kmer"])
    return choose_splitters(own, k, segment_size, breaks(contigs))


def adaptive_splitters(contigs: DataFrame, k: int, segment_size: int) -> DataFrame:
    """kmer: the first sample's splitters and, contig after contig in the order of their
    names, the own ones of each long contig that holds none of the set as it is by then.

    What a contig would add does not depend on the others, so it is told for all that
    lack the first set at once. Which of them do add is then settled in rounds: a contig
    adds if no earlier undecided one would add a k-mer that it holds; it does not if an
    earlier one that adds has one. A round looks up each k-mer's least owner, never pairs
    of contigs; the first undecided contig is settled in every round.
    """
    first = first_sample(contigs)
    base = determine_splitters(first, k, segment_size)
    found = stored(base["splitters"], "splitters")
    rest = contigs.filter(F.length("seq") >= segment_size)
    without = stored(hard_rows(rest, k, found), "hard-contigs")
    hard = enumerate_kmers(without, k)
    known = base["singletons"].unionByName(base["duplicates"])
    own = new_splitters(without, hard, known, k, segment_size)
    order = stored(numbered(without.select(*CONTIG).distinct(), CONTIG, "at"), "hard-order")
    own = stored(own.join(order, CONTIG).select("at", "kmer").distinct(), "own-splitters")
    # Of a contig's k-mers only those count that some contig would add.
    held = stored(occurrences(without, k, own).select(*CONTIG, "kmer").distinct().join(order, CONTIG).select("at", "kmer").distinct(), "held")
    least = lambda some: some.groupBy("kmer").agg(F.min("at").alias("least"))
    later = lambda some, owners: some.join(least(owners), "kmer").filter("least < at").select("at").distinct()
    added = found
    while not own.isEmpty():
        adds = stored(own.join(later(held, own), "at", "left_anti"), "adds")
        added = added.unionByName(adds.select("kmer"))
        settled = stored(later(held, adds).unionByName(adds.select("at").distinct()).distinct(), "settled")
        own, held = (stored(x.join(settled, "at", "left_anti"), "undecided") for x in (own, held))
    return added.distinct()


def hard_rows(contigs: DataFrame, k: int, splitters: DataFrame) -> DataFrame:
    """The contigs (sample, contig, seq) that hold no splitter."""
    rows = contigs.select(*CONTIG, "seq")
    if k > EXACT_K:
        return rows.join(occurrences(contigs, k, splitters).select(*CONTIG).distinct(), CONTIG, "left_anti")
    held = told(contigs.sparkSession, splitters, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            free = np.ones(batch.num_rows, bool)
            for row, _, fwd, rev in scanned(batch.column(2), k):
                free[row[held.value.check(np.minimum(fwd, rev))]] = False
            yield batch.filter(pa.array(free))

    return rows.mapInArrow(run, rows.schema)


def segment(contigs: DataFrame, splitters: DataFrame, k: int, reset: bool = True, whole_tail: bool = True) -> DataFrame:
    """sample, contig, part (from 0), start (from 0), raw_length, front, back,
    front_is_dir and back_is_dir of the segments of all contigs with letters.

    Neighbours share the k bases of a splitter. ``reset``: after a split the k-mer
    starts anew, so splitters that overlap the last one do not split; without it every
    occurrence does. The tail is always emitted; ``whole_tail`` False drops tails of k
    bases, which add nothing.
    """
    short = lambda out: out if whole_tail else out.filter(~(F.col("front").isNotNull() & F.col("back").isNull() & (F.col("raw_length") <= k)))
    if k <= EXACT_K:
        return short(_segmented_here(contigs, splitters, k, k if reset else 1))
    hits = occurrences(contigs, k, splitters).withColumn("length", F.lit(None).cast("long"))
    own = contigs.filter(F.length("seq") > 0).select(*CONTIG, F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("kmer"), F.lit(None).cast("boolean").alias("is_dir"), F.length("seq").cast("long").alias("length"))
    schema = own.select(*CONTIG).schema
    for name in ("part", "start", "raw_length", "front", "back"):
        schema = schema.add(name, "long")
    schema = schema.add("front_is_dir", "boolean").add("back_is_dir", "boolean")
    gap = k if reset else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the contig at hand: its two names, its length, and part, place, k-mer and direction of the last cut.
        names, length, last = None, 0, (0, None, None, None)
        for batch in batches:
            rows: list[tuple] = []
            kept: list[pa.RecordBatch] = []  # one row of names for each run of rows
            runs: list[int] = []

            def emit(row: tuple) -> None:
                if not kept or kept[-1] is not names:
                    kept.append(names)
                    runs.append(0)
                runs[-1] += 1
                rows.append(row)

            def tail() -> None:
                part, pos, kmer, direct = last
                start = 0 if pos is None else pos - 1
                emit((part, start, length - start, kmer, None, direct, None))

            for i, (pos, kmer, direct, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pos", "kmer", "is_dir", "length")), strict=True)):
                if pos is None:
                    if names is not None:
                        tail()
                    names, length, last = batch.slice(i, 1).select([0, 1]), n, (0, None, None, None)
                elif last[1] is None or pos - last[1] >= gap:
                    start = 0 if last[1] is None else last[1] - 1
                    emit((last[0], start, pos - 1 + k - start, last[2], kmer, last[3], direct))
                    last = (last[0] + 1, pos, kmer, direct)
            if rows:
                yield _segments(rows, kept, runs, schema.names)
        if names is not None:
            rows, kept, runs = [], [], []
            part, pos, kmer, direct = last
            start = 0 if pos is None else pos - 1
            yield _segments([(part, start, length - start, kmer, None, direct, None)], [names], [1], schema.names)

    out = _by_contig(hits.select(*CONTIG, "pos", "kmer", "is_dir", "length").unionByName(own)).mapInArrow(run, schema)
    return short(out)


def _segmented_here(contigs: DataFrame, splitters: DataFrame, k: int, gap: int) -> DataFrame:
    """segment() where the contigs are."""
    held = told(contigs.sparkSession, splitters, k)
    rows = contigs.filter(F.length("seq") > 0).select(*CONTIG, F.length("seq").cast("long").alias("length"), "seq")
    schema = StructType(rows.schema.fields[:2])
    for name in ("part", "start", "raw_length", "front", "back"):
        schema = schema.add(name, "long")
    schema = schema.add("front_is_dir", "boolean").add("back_is_dir", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaced, cuts = Spaced(gap), [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)]
            for row, pos, fwd, rev in scanned(batch.column(3), k):
                kmer = np.minimum(fwd, rev)
                some = np.flatnonzero(held.value.check(kmer))
                some = some[spaced.take(row[some], pos[some])]
                cuts.append((row[some], pos[some], kmer[some].astype(np.int64), (fwd <= rev)[some]))
            row, pos, kmer, direct = (np.concatenate(x) for x in zip(*cuts, strict=True))
            n = np.bincount(row, minlength=batch.num_rows) + 1
            own = np.repeat(np.arange(batch.num_rows), n)
            part = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            head, tail = part == 0, part == n[own] - 1
            # The cut that ends a segment; the one before it begins it.
            at = np.arange(len(own)) - own
            pos, kmer, direct = (np.concatenate([x, x[:1] if len(x) else np.zeros(1, x.dtype)]) for x in (pos, kmer, direct))
            after, before = np.where(tail, 0, at), np.where(head, 0, at - 1)
            start = np.where(head, 0, pos[before] - 1)
            end = np.where(tail, batch.column(2).to_numpy(zero_copy_only=False)[own], pos[after] - 1 + k)
            names = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(names), batch.column(1).take(names), pa.array(part), pa.array(start), pa.array(end - start), pa.array(kmer[before], mask=head), pa.array(kmer[after], mask=tail), pa.array(direct[before], mask=head), pa.array(direct[after], mask=tail)],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def _segments(rows: list[tuple], kept: list[pa.RecordBatch], runs: list[int], names: list[str]) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.arange(len(kept)), runs))
    both = [pa.concat_arrays([x.column(c) for x in kept]).take(at) for c in (0, 1)]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2
    return pa.RecordBatch.from_arrays([*both, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)


def with_sequence(segments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Segments with their letters, as the contig has them. Segments cross to their
    contig as a list of places, and are cut out where it is: its letters move once.
    """
    lists = segments.groupBy(*CONTIG).agg(F.collect_list(F.struct(*[c for c in segments.columns if c not in CONTIG])).alias("_hf_segments"))
    seqs = contigs.select(*CONTIG, F.encode("seq", "US-ASCII").alias("_hf_seq"))
    piece = lambda s: F.decode(F.substr("_hf_seq", (s["start"] + 1).cast("int"), s["raw_length"].cast("int")), "US-ASCII")
    each = seqs.join(lists, CONTIG).select(*CONTIG, F.explode(F.transform("_hf_segments", lambda s: F.struct(s.alias("s"), piece(s).alias("seq")))).alias("_hf_x"))
    return each.select(*CONTIG, "_hf_x.s.*", "_hf_x.seq").select(*segments.columns, "seq")


def positions(segments: DataFrame, k: int) -> DataFrame:
    """Where each segment's own bases lie in its contig, from lengths alone: seg_start
    and seg_end (end exclusive); all but the first add what follows their first k bases.
    """
    own = F.when(F.col("part") == 0, F.col("raw_length")).otherwise(F.greatest(F.col("raw_length") - k, F.lit(0)))
    line = Window.partitionBy(*CONTIG).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("seg_end", F.sum(own).over(line)).withColumn("seg_start", F.col("seg_end") - own)
