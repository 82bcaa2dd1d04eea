"""Benchmark decontamination by spaced seeds.

A text's words are runs of letters and digits, lower-cased. A document holds a passage
of an item where, at some offset, ``window`` neighbouring words of both (all words of
the item if it is shorter, but LEAST_WORDS or more) differ in at most a fifth of the
places: copies survive replaced words. Items of fewer words ("yes") stand in most texts by
chance: they are found, exactly, where a whole line of the document is their words.

Seeds are masks over neighbouring places, of which some are ignored: whichever words of
a window are replaced, within that bound, some mask meets it with equal words at all
its other places (masks_for() builds the family and proves it for every choice). Each
item and each document hashes its words under every mask and place; equal hashes are
hits, and around each hit the words of the two are compared along its diagonal.

The hashes of the items are broadcast if they have at most ``broadcast_rows`` rows.
Beyond that documents emit their hashes (one row for each mask and place) and join them
with those of the items by a shuffle; a bitmap of FILTER_BITS, in which every hash of an
item has set a bit, is broadcast first, so that few others of the documents' are emitted;
the rows of a hash that many documents share are split by Spark, as both sides are plain
join inputs. Either way the hits are checked by the same function.

Defined results: null or empty texts and empty tables hold nothing; repeated rows of a
document give the same rows once; documents with a null id count as one of that id on
either path; repeated item ids are items of the same name; very
long documents are searched whole; of several overlaps of a document with an item the one
with the most equal words is given, of these the first. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WORD = re.compile(r"[^\W_]+")
#: Words of a window, words that the shortest item has, and the share that may differ.
WINDOW, LEAST_WORDS, SHARE = 13, 5, 0.2
#: Rows of the items' seed table that are broadcast (24 bytes each).
BROADCAST_ROWS = 2_000_000
#: Bits of the filter beyond that (16 MB); it holds whatever the items' number is.
FILTER_BITS = 1 << 27


@lru_cache
def masks_for(size: int, errors: int) -> tuple[tuple[int, ...], ...]:
    """Masks (the places that count, from 0) for windows of ``size`` words: for every
    choice of ``errors`` places some mask, somewhere in the window, avoids them all.
    Greedy: of all masks of one weight, take the one that, over its places in the
    window, avoids most choices that none avoids yet; the weight is the largest for
    which six masks or fewer do.
    """
    choices = np.array([sum(1 << p for p in c) for c in combinations(range(size), errors)], np.int64)
    for weight in range(max(1, size - errors), 0, -1):
        span = min(size, weight + 3)
        pool = [(0, *c) for c in combinations(range(1, span), weight - 1)]
        if comb(span - 1, weight - 1) == 0:
            continue
        open_, found = np.ones(len(choices), bool), []
        avoids = {}
        for m in pool:
            bits = sum(1 << p for p in m)
            avoids[m] = np.logical_or.reduce([(choices & (bits << s)) == 0 for s in range(size - m[-1])])
        while open_.any() and len(found) < 6:
            best = max(pool, key=lambda m: (int((avoids[m] & open_).sum()), -m[-1]))
            if not (avoids[best] & open_).any():
                break
            found.append(best)
            open_ &= ~avoids[best]
        if not open_.any():
            return tuple(found)
    return ((0,),)


def shape(n: int) -> tuple[int, int]:
    """Window and errors for an item of ``n`` words."""
    size = min(n, WINDOW)
    return size, int(size * SHARE + 1e-9)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Seeds:
    """The items' words as numbers, and their hashes by mask."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.items = [(k, w) for k, w in items if len(w) >= LEAST_WORDS]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for k, w in items:
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(tuple(w), []).append(k)
        self.number: dict[str, int] = {}
        for _, words in self.items:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.codes = [np.array([self.number[w] for w in words], np.int64) for _, words in self.items]
        by_mask: dict[tuple[int, ...], list[tuple[np.ndarray, int]]] = {}
        for i, codes in enumerate(self.codes):
            for mask in masks_for(*shape(len(codes))):
                by_mask.setdefault(mask, []).append((hashed(codes, mask), i))
        self.tables = []
        for mask, some in by_mask.items():
            keys = np.concatenate([h for h, _ in some])
            item = np.concatenate([np.full(len(h), i) for h, i in some])
            place = np.concatenate([np.arange(len(h)) for h, _ in some])  # every place of an item has numbers
            order = np.argsort(keys, kind="stable")
            bits = 1 << max(16, int(len(keys) * 16).bit_length())
            seen = np.zeros(bits, bool)
            seen[(keys.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)] = True
            self.tables.append((mask, keys[order], item[order], place[order], seen))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; others than the items' are 0."""
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, documents' places and items' places of equal hashes."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for mask, keys, item, place, seen in self.tables:
            near = whole(codes, mask)
            h = hashed(codes, mask, near)
            maybe = seen[(h.view(np.uint64) & np.uint64(len(seen) - 1)).astype(np.int64)]
            near, h = near[maybe], h[maybe]
            if not len(near):
                continue
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append((item[at], np.repeat(near, n), place[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def found(self, texts: list[str | None]) -> list[tuple[int, int, tuple[int, int, int]]]:
        """overlaps() of texts, and the lines that are a short item."""
        out = self.overlaps([words_of(t) for t in texts])
        if self.short:
            out += [(i, item, x) for i, t in enumerate(texts) for words, x in short_lines(t) for item in self.short.get(words, ())]
        return out

    def overlaps(self, texts: list[list[str]]) -> list[tuple[int, int, tuple[int, int, int]]]:
        """For texts as words: text, item and, on the diagonal with most equal words,
        first place, place after the last, and equal words of the windows that hold it.
        """
        parts = [self.numbers(w) for w in texts]
        starts = np.cumsum([0, *(len(x) + 1 for x in parts)])
        gap = np.zeros(1, np.int64)  # no mask reaches over it
        items, places, own = self.hits(np.concatenate([y for x in parts for y in (x, gap)] or [gap]))
        text = np.searchsorted(starts, places, "right") - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, shift in set(zip(text.tolist(), items.tolist(), (places - starts[text] - own).tolist(), strict=True)):
            codes, item = parts[t], self.codes[i]
            a, b = max(0, shift), min(len(codes), shift + len(item))
            size, errors = shape(len(item))
            if b - a < size:
                continue
            same = codes[a:b] == item[a - shift : b - shift]
            total = np.concatenate([[0], np.cumsum(same)])
            good = np.flatnonzero(total[size:] - total[:-size] >= size - errors)
            if len(good):
                found = (a + int(good[0]), a + int(good[-1]) + size, int(total[good[-1] + size] - total[good[0]]))
                best[t, i] = max(best.get((t, i), found), found, key=lambda x: (x[2], -x[0]))
        return [(t, self.items[i][0], x) for (t, i), x in best.items()]


def short_lines(text: str | None) -> Iterator[tuple[tuple[str, ...], tuple[int, int, int]]]:
    """The words of each line of fewer than LEAST_WORDS, with the place of the first, the
    place after the last, and their number.
    """
    at = 0
    for line in (text or "").lower().split("\n"):
        words = WORD.findall(line)
        if 0 < len(words) < LEAST_WORDS:
            yield tuple(words), (at, at + len(words), len(words))
        at += len(words)


def whole(codes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Places where all words under the mask have numbers."""
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64)
    known = codes != 0
    return np.flatnonzero(np.logical_and.reduce([known[p : p + n] for p in mask]))


def hashed(codes: np.ndarray, mask: tuple[int, ...], places: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the words under the mask at ``places``, or at all that are whole."""
    places = whole(codes, mask) if places is None else places
    h = np.zeros(len(places), np.uint64)
    for p in mask:
        h = (h ^ codes[places + p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


PAIRS = "_hf_id long, text_hash long, item_id long, first_word long, end_word long, same_words long"
PAIR_TYPES = pa.schema([("_hf_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("same_words", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, PAIR_TYPES.types, strict=True)], schema=PAIR_TYPES)


def _searched(seeds: Seeds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            keys = list(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True))
            yield _batch([(*keys[t], item, *x) for t, item, x in seeds.found([t.as_py() for t in part.column(1)])])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS, text_hash: bool = False) -> DataFrame:
    """One row for each document and item it holds: ``id_col``, item_id, first_word,
    end_word (the words of the document) and same_words. With ``text_hash`` one row for
    each text of an id instead, with its xxhash64.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    rows = docs.select(F.col(id_col).cast("long").alias("_hf_id"), F.col(text_col).alias("_hf_text"), F.xxhash64(text_col).alias("_hf_hash"))
    # At most six masks and a place for each word: counted before anything is gathered.
    size = known.agg(F.sum(F.size(F.split("text", r"\s+")) * 6)).first()[0] or 0
    if size <= broadcast_rows:
        seeds = Seeds([(r["item"], words_of(r["text"])) for r in known.distinct().collect()])
        held = spark.sparkContext.broadcast(seeds)
        pairs = rows.mapInArrow(lambda batches: _searched(held.value, batches), PAIRS)
    else:
        pairs = _joined(rows, known)
    key = ["_hf_id", "text_hash"] if text_hash else ["_hf_id"]
    best = pairs.groupBy(*key, "item_id").agg(F.max_by(F.struct("first_word", "end_word", "same_words"), F.struct("same_words", -F.col("first_word"))).alias("x"))
    return best.select(F.col("_hf_id").alias(id_col), *key[1:], "item_id", "x.*")


def _joined(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same by a shuffle: hashes of both sides are joined, then each pair of a
    document and an item that hit is compared by the words of both. A document's key is
    a hash of its id and text, so rows without an id are found as well.
    """
    rows = rows.filter("_hf_text IS NOT NULL").withColumn("_hf_key", F.xxhash64("_hf_id", "_hf_text"))
    shapes = [shape(n) for n in range(LEAST_WORDS, WINDOW + 1)]
    every = sorted({m for s in shapes for m in masks_for(*s)})

    def code(text: str) -> int:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(text.encode()) | 1

    def emitted(own: bool, bits: Broadcast | None = None):
        """Hashes of items (by their masks) or of documents (by every mask, those whose bit
        is set); the mask -1 stands for a whole line of few words.
        """

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = words_of(text.as_py())
                    codes = np.array([code(w) for w in words], np.uint64).view(np.int64)
                    masks = every if not own else masks_for(*shape(len(words))) if len(words) >= LEAST_WORDS else ()
                    lines = [tuple(words)] * (0 < len(words) < LEAST_WORDS) if own else [w for w, _ in short_lines(text.as_py())]
                    some = [(-1, np.array([code(" ".join(w)) for w in lines], np.uint64).view(np.int64)), *((every.index(m), hashed(codes, m)) for m in masks)]
                    for mask, h in some:
                        h = np.unique(h)
                        if bits is not None:
                            at = (h.view(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                            h = h[bits.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1]
                        if len(h):
                            yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array([mask] * len(h), pa.int32()), pa.array(h)], names=["key", "mask", "hash"])

        return emit

    kind = "key long, mask int, hash long"
    right = stored(known.mapInArrow(emitted(True), kind).withColumnRenamed("key", "item").distinct(), "item-seeds")
    at = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = right.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    held = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in words.toLocalIterator():
        held[r["word"]] = np.int64(r["bits"]).astype(np.uint64)
    bits = rows.sparkSession.sparkContext.broadcast(held)
    left = rows.select("_hf_key", "_hf_text").mapInArrow(emitted(False, bits), kind).withColumnRenamed("key", "_hf_key")
    hits = stored(left.join(right, ["mask", "hash"]).select("_hf_key", "item").distinct(), "seed-hits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, digest, item, a, b in zip(*(batch.column(c) for c in ("_hf_id", "_hf_hash", "item", "_hf_text", "item_text")), strict=True):
                out += [(key.as_py(), digest.as_py(), item.as_py(), *x) for _, _, x in Seeds([(item.as_py(), words_of(b.as_py()))]).found([a.as_py()])]
            yield _batch(out)

    both = hits.join(rows, "_hf_key").join(known.select("item", F.col("text").alias("item_text")), "item")
    return both.select("_hf_id", "_hf_hash", "item", "_hf_text", "item_text").mapInArrow(compare, PAIRS)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, first_word, end_word and same_words of every overlap."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
