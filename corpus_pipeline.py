"""A corpus pipeline of five operators: language ID, line dedup, near-dedup, benchmark decontamination, encoding to pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, langid, lines, pieces, simhash
from tidewatch.llm.common import forget, written
from tidewatch.llm.queries import PIECES


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that aren't held out; keeps documents in a learned language. Those without a letter, or in
    which no language has the least share of words, go."""
    return langid.accept(docs, langid.train(docs.where(~langid.held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of each source out of the texts; every document stays, ``n_chars`` follows. A text all of whose lines
    would go stays whole, so that of a large group of copies the next stage can keep one."""
    done = lines.drop_boilerplate(docs, "source", spare=True, counts=False)
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each linked group."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as piece ids; ``lossless``: they decode to the text."""
    done = pieces.encode_checked(docs.select("doc_id", "lang", "source", "text"), PIECES)
    return done.select("doc_id", "lang", "source", "n_pieces", "ids", "lossless")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminated),
    ("pieces", encoded),
]

#: Language ID and pieces are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
