"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet to the shared folder and reads it as the next stage's docs. All
but the last stage return the columns of their docs. Nulls, repeated rows and empty
tables have the results that the operators' modules define. Stages reject rows by id
(null or not) and text, never all rows of an id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from helixframe.llm.common import dropped, scratch, shared_dir, table


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without those whose doc_id and hash of the text are in ``rows`` (doc_id,
    text_hash).
    """
    some = rows.select(F.col("doc_id").alias("_hf_id"), "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(some["_hf_id"]) & (F.xxhash64(docs["text"]) == some["text_hash"])
    return docs.join(some, same, "left_anti")


def _measured(docs: DataFrame) -> DataFrame:
    """With n_chars, where there is such a column, of the text as it is now."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), text_hash=True)
    return _without(docs, scored.filter("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; so do documents that were made of such."""
    return _measured(line_dedup.clean_documents(docs, line_dedup.repeats(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), text_hash=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left: doc_id, n_tokens and two digests."""
    import public_tokenizers

    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]
#: SQL expresses neither the first stage nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what the stage needs beside its result goes with it
            kept = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/helixframe/pipeline-{name}-{uuid.uuid4().hex}"
            kept.write.parquet(path)
        if before is not None:
            dropped(spark, before)
        docs = before = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
