"""Joins that hold up where a few keys have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that make a key hot, and the most keys that are broadcast as such.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def spread_join(rows: DataFrame, lookup: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``lookup``, which holds each key once and, in column
    ``size``, how many of ``rows`` have it. Keys of more than HOT_ROWS rows, and more than
    a HOT_KEYS-th of ``total`` (rows in all, so there are no more than HOT_KEYS of them), are
    broadcast and stay with their rows, wherever these are; the others meet by a shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = lookup.filter(F.col(size) > limit).drop(size)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(lookup.filter(F.col(size) <= limit).drop(size), on)
    return rest.unionByName(rows.join(F.broadcast(hot), on))
