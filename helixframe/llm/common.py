"""Helpers that the corpus operators share.

Internal columns start with ``_hf_`` so that they never clash with the columns of
a caller's table; every operator states which input columns it reads and ignores
the others.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import spread_join as spread_join

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes of ASCII white space other than the space, and A-Z, as bytes.translate() takes them.
ASCII_FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; a path of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the
    session, or, where it is unset and all run in one process (tests), a temporary one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"{tempfile.gettempdir()}/helixframe-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends here,
    a lost executor costs no recomputation, and several readers share one run.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def least_hashed(df: DataFrame, order: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``: those of the least ``order`` (a 64-bit hash that tells
    rows apart). All but the least hashes go where they are, by a count of the rows, so
    that what is sorted in one place does not grow with the table.
    """
    share = (1.2 * rows + 1000) / max(1, df.count())
    if share < 1:
        df = df.filter(order <= F.lit(int(share * 2**64) - 2**63))
    return df.orderBy(order).limit(rows)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes what stored() wrote for ``df``, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        _remove(spark, file.rpartition("/")[0])


#: What stored() has written, in order.
_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at the end what stored() writes within; results must be written by then."""
    before = len(_written)
    yield
    for path in _written[before:]:
        _remove(spark, path)
    del _written[before:]
