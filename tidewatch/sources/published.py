"""Stored tables that are extended in place: write, audit, publish.

Only the partitions that incoming rows fall into are read, merged and written again. The merge goes to a staging folder; it is audited there
(no key twice, no value contradicted, no row lost); the touched partitions are copied to a backup folder; then they are replaced by one
dynamic partition overwrite. What fails before that leaves the stored table untouched; what fails in it is put back from the backup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .scratch import delete, fresh_place


class NotPublished(ValueError):
    """Incoming rows contradict stored ones, or the audit failed; the stored table is as it was."""


def store(rows: DataFrame, path: str, by: str) -> None:
    """A new stored table, partitioned by ``by`` and rebalanced by size; refused where there is something already."""
    rows.hint("rebalance", by).write.partitionBy(by).mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema.fields])


def merged(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Both by key: a stored blank takes the incoming value, a value that only one side has stays; ``conflict`` tells values that differ."""
    values = [c for c in stored.columns if c not in key]
    a = stored.select(*key, F.struct(*values).alias("a"))
    b = incoming.select(*key, F.struct(*values).alias("b"))
    differs: list[Column] = [F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(False)) for c in values]
    both = a.join(b, key, "full_outer")
    return both.select(*key, *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in values], reduce(Column.__or__, differs, F.lit(False)).alias("conflict"), F.col("a").isNotNull().alias("old"), F.col("b").isNotNull().alias("new"))


def extend(spark: SparkSession, path: str, incoming: DataFrame, key: list[str], by: str, schema) -> str:
    """Merges ``incoming`` (columns of ``schema``; ``by`` is one of ``key``) into the stored table. Returns the backup's folder, which holds the
    touched partitions as they were."""
    if by not in key:
        raise ValueError("the partition column is part of the key")
    names = [f.name for f in schema.fields]
    stored = read(spark, path, schema)
    incoming = incoming.select(*names)
    touched = incoming.select(by).distinct()
    there = stored.join(touched, by, "left_semi")
    staging, backup = fresh_place(spark, "staging"), fresh_place(spark, "backup")

    seen = Observation()
    checks = [F.count("*").alias("rows"), F.count_if("conflict").alias("conflicts"), F.count_if("old").alias("old"), F.count_if("new").alias("new")]
    result = merged(there, incoming, key).observe(seen, *checks)
    result.select(*names).write.partitionBy(by).parquet(staging)
    found = seen.get
    staged = read(spark, staging, schema)
    twice = not staged.groupBy(*key).count().where("count > 1").isEmpty()
    if found["conflicts"] or found["old"] != there.count() or found["new"] != incoming.count() or twice:
        delete(spark, staging)
        raise NotPublished(f"{found['conflicts']} rows are contradicted; {found['old']} stored and {found['new']} incoming rows were merged; keys occur twice: {twice}")

    there.write.partitionBy(by).parquet(backup)
    try:
        _replace(staged, path, by)
    except Exception:
        _replace(read(spark, backup, schema), path, by)
        raise
    delete(spark, staging)
    return backup


def _replace(rows: DataFrame, path: str, by: str) -> None:
    """The partitions that ``rows`` has take the place of those of the same value."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
