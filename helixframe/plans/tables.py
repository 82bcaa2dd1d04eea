"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session or, where it is unset and all run in one
    process (tests), a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"{tempfile.gettempdir()}/helixframe-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back, which cuts the lineage and fixes its rows."""
    path = f"{shared_dir(df.sparkSession)}/helixframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Address, size and time of the files of a table: what tells whether it has changed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [folder] if system.getFileStatus(folder).isFile() else [x.getPath() for x in system.listStatus(folder)]
    return tuple(sorted((f.toString(), system.getFileStatus(f).getLen(), system.getFileStatus(f).getModificationTime()) for f in files))


_kept: dict[tuple, str] = {}


def kept(spark: SparkSession, name: str, source: str, make: Callable[[str], None]) -> str:
    """The path of what ``make`` has written of the table ``source``: made at the first
    use in an application, and anew if the files of the source have changed.
    """
    key = (spark.sparkContext.applicationId, name, source, state_of(spark, source))
    if key not in _kept or not exists(spark, _kept[key]):
        path = f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"
        make(path)
        _kept[key] = path
    return _kept[key]
