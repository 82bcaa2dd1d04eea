"""Row numbers, row-to-row values and running values of a whole table, or of groups of any
size, without one task for all rows: rows are dealt by range, worked on in their range,
and only one row for each range (and, for groups, for each group in a range) is looked at
together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import stored
from .joins import spread_join


def dealt(df: DataFrame, order: list, partitions: int | None = None) -> DataFrame:
    """``df``, written by ranges of ``order``, with the number of the range."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return stored(df.repartitionByRange(n, *order).withColumn("_hf_range", F.spark_partition_id()), "numbered")


def numbered(df: DataFrame, order: list, name: str = "n", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, the rank of each row from 1 by ``order`` (which tells all
    rows apart). Rows are dealt by range and numbered in their range; only the sizes of
    the ranges (a row for each partition) are summed up in one place.
    """
    rows = dealt(df, order, partitions)
    own = rows.withColumn("_hf_own", F.row_number().over(Window.partitionBy("_hf_range").orderBy(*order)))
    sizes = rows.groupBy("_hf_range").agg(F.count("*").alias("n"))
    before = sizes.select("_hf_range", (F.sum("n").over(Window.orderBy("_hf_range")) - F.col("n")).alias("_hf_before"))
    return own.join(F.broadcast(before), "_hf_range").withColumn(name, F.col("_hf_before") + F.col("_hf_own")).drop("_hf_range", "_hf_own", "_hf_before")


def numbered_in(df: DataFrame, by: str, order: list, name: str = "n") -> DataFrame:
    """``df`` with ``name``, the rank of each row from 1 among those of its ``by``; a
    group of any size is spread over ranges.
    """
    rows = stored(numbered(df, [by, *order], "_hf_n"), "numbered")
    first = rows.groupBy(by).agg(F.min("_hf_n").alias("_hf_first"), F.count("*").alias("_hf_size"))
    return spread_join(rows, first, [by], "_hf_size", rows.count()).withColumn(name, F.col("_hf_n") - F.col("_hf_first") + 1).drop("_hf_n", "_hf_first")


def with_previous(df: DataFrame, order: list, column: str, name: str) -> DataFrame:
    """``df`` with ``name``, the value of ``column`` in the row before by ``order``."""
    rows = dealt(df, order)
    line = Window.partitionBy("_hf_range").orderBy(*order)
    own = rows.withColumn("_hf_lag", F.lag(F.struct(column)).over(line))
    ends = rows.groupBy("_hf_range").agg(F.max_by(F.struct(column), F.struct(*order)).alias("_hf_end"))
    before = ends.select("_hf_range", F.lag("_hf_end").over(Window.orderBy("_hf_range")).alias("_hf_before"))
    return own.join(F.broadcast(before), "_hf_range").withColumn(name, F.coalesce("_hf_lag", "_hf_before")[column]).drop("_hf_range", "_hf_lag", "_hf_before")


def with_running_max(df: DataFrame, by: str, order: list, column: str, name: str) -> DataFrame:
    """``df`` with ``name``, the largest ``column`` in the rows of the same ``by`` that
    come before by ``order``; null for the first of them.
    """
    rows = dealt(df, [by, *order])
    line = Window.partitionBy("_hf_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_hf_own", F.max(column).over(line))
    # Only groups that go on in another range have anything before it.
    tops = rows.groupBy("_hf_range", by).agg(F.max(column).alias("_hf_top"))
    before = tops.select("_hf_range", by, F.max("_hf_top").over(Window.partitionBy(by).orderBy("_hf_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_hf_before")).filter("_hf_before IS NOT NULL")
    return own.join(F.broadcast(before), ["_hf_range", by], "left").withColumn(name, F.greatest("_hf_own", "_hf_before")).drop("_hf_range", "_hf_own", "_hf_before")
