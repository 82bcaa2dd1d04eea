"""A Bloom filter over longs, built by an aggregation and broadcast.

It lets most of what a set does not hold go where it is made, before the exact join. Its
size follows the number of values and is bounded: beyond MOST_BITS it fills up and lets
more pass, and what passes is joined as ever, so no result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import murmur64_columns

HASHES, LEAST_BITS, MOST_BITS, FULL = 3, 64, 1 << 28, 0.3


class Bloom:
    def __init__(self, bits: int = LEAST_BITS) -> None:
        self.words = np.zeros(max(LEAST_BITS, bits) // 64, np.uint64)

    @classmethod
    def for_values(cls, n: int) -> Bloom:
        """Of the size (a power of two) that ``n`` values fill to a share of FULL at most."""
        return cls(min(MOST_BITS, 1 << max(6, int(n * HASHES / FULL).bit_length())))

    def places(self, values: np.ndarray) -> np.ndarray:
        """The bits of each value, one row for each hash."""
        first = murmur64_columns(values.astype(np.int64).view(np.uint64))
        step = murmur64_columns(first ^ np.uint64(0x5555555555555555)) | np.uint64(1)
        mask = np.uint64(len(self.words) * 64 - 1)
        with np.errstate(over="ignore"):
            return np.stack([(first + np.uint64(i) * step) & mask for i in range(HASHES)])

    def insert(self, values: np.ndarray) -> None:
        at = self.places(values).reshape(-1)
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def check(self, values: np.ndarray) -> np.ndarray:
        """False for values that were not inserted, but for a few."""
        at = self.places(values)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)

    def fill(self) -> float:
        """The share of bits that are set."""
        return float(np.bitwise_count(self.words).sum()) / (64 * len(self.words))

    def is_full(self) -> bool:
        return self.fill() > FULL

    def resized(self, values: np.ndarray) -> Bloom:
        """A filter of the right size for ``values``, with all of them."""
        out = Bloom.for_values(len(values))
        out.insert(values)
        return out

    def clear(self) -> None:
        self.words[:] = 0

    @classmethod
    def of_column(cls, values: DataFrame, column: str) -> Bloom:
        """Of all values of a column of longs."""
        return cls.for_values(values.count())._told(values, column)

    def _told(self, values: DataFrame, column: str) -> Bloom:
        """With all values of a column: tasks tell the words that they set, which are put
        together by an aggregation; the driver gets each word of the filter once.
        """
        out, places = self, type(self)().places if isinstance(self, Exact) else self.places

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = places(batch.column(0).to_numpy(zero_copy_only=False)).reshape(-1)
                word, back = np.unique(at >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, back, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

        told = values.filter(F.col(column).isNotNull()).select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        out.words[told.column("word").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
        return out


class Exact(Bloom):
    """A set of k-mers of few bases, with a bit of its own for each that there could be:
    what it lets pass is in the set.
    """

    def __init__(self, k: int = 1) -> None:
        super().__init__(4**k)
        self._table: np.ndarray | None = None

    def places(self, values: np.ndarray) -> np.ndarray:
        return values.astype(np.uint64)[None, :]

    def check(self, values: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = np.unpackbits(self.words.view(np.uint8), bitorder="little").view(bool)
        return self._table[values]

    @classmethod
    def of_kmers(cls, values: DataFrame, k: int) -> Exact:
        """Of a column kmer."""
        return cls(k)._told(values, "kmer")
