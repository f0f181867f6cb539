"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is heavy if it holds more than one in so many of all rows; so there are fewer heavy keys than this.
HEAVY = 4096


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """``rows`` joined with ``keyed``, which holds each key once and in ``n`` how many of the ``total`` rows have it. Heavy keys, fewer
    than ``HEAVY``, are broadcast, so that no task of the shuffled join gets more than a ``HEAVY``-th of the rows from one key.

    Both tables are read twice: give written ones."""
    heavy = F.broadcast(keyed.where(F.col(n) * HEAVY > total))
    light = keyed.where(F.col(n) * HEAVY <= total)
    rest = rows.join(heavy.select(*on), on, "left_anti").join(light, on)
    return rows.join(heavy, on).unionByName(rest)


def left_join_spread(rows: DataFrame, keyed: DataFrame, on: str) -> DataFrame:
    """``rows`` left-joined with ``keyed``, which holds each value of ``on`` once. Rows of a heavy key, whether it is in ``keyed`` or not, are
    dealt by their contents to as many shares as it holds ``HEAVY``-ths of all rows, and its row of ``keyed`` is copied to each."""
    total = rows.count()
    key, shares, share = (fresh(rows.join(keyed.limit(0), on, "left"), c) for c in ("key", "shares", "share"))
    counts = rows.groupBy(F.col(on).alias(key)).agg(F.count("*").alias(shares)).where(F.col(shares) * HEAVY > total)
    heavy = F.broadcast(counts.withColumn(shares, F.ceil(F.col(shares) * HEAVY / F.lit(max(total, 1))).cast("int")))
    n = F.coalesce(F.col(shares), F.lit(1))
    left = rows.join(heavy, F.col(on) == F.col(key), "left").withColumn(share, F.pmod(F.xxhash64(*rows.columns), n).cast("int")).drop(key, shares)
    right = keyed.join(heavy, F.col(on) == F.col(key), "left").withColumn(share, F.explode(F.sequence(F.lit(0), n - 1))).drop(key, shares)
    return left.join(right, [on, share], "left").drop(share)
