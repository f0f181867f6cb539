"""Sequence operators over keyed, ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_edges(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before; a key's first row never counts."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__before", F.lag(value).over(w)).where(F.col(value) != F.col("__before")).drop("__before")


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Maximal runs of one value: ``key``, ``value``, ``start``, ``stop`` (inclusive), ``width``."""
    w = Window.partitionBy(key).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    marked = df.withColumn("__run", change)
    marked = marked.withColumn("__run", F.sum("__run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        marked.groupBy(key, "__run", value)
        .agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("width"))
        .drop("__run")
    )


def moving_average(df: DataFrame, key: str, order: str, value: str, width: int = 50) -> DataFrame:
    """Means of the last ``width`` values, only where so many exist; keys with fewer give their raw values."""
    w = Window.partitionBy(key).orderBy(order)
    last = w.rowsBetween(-(width - 1), 0)
    counted = df.withColumn("__seen", F.row_number().over(w)).withColumn("average", F.avg(value).over(last))
    totals = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    joined = counted.join(totals, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    short = F.col("__n") < width
    return joined.where(short | (F.col("__seen") >= width)).withColumn("average", F.when(short, F.col(value)).otherwise(F.col("average"))).drop("__seen", "__n")


def since_last(key: str, order: str, event: Column) -> Column:
    """The order value of the last row at or before each where ``event`` holds (a backward as-of join)."""
    return F.last(F.when(event, F.col(order)), ignorenulls=True).over(Window.partitionBy(key).orderBy(order))


def rounds(df: DataFrame, order: str, total: str, size: int) -> DataFrame:
    """``round`` of ``size`` rows; the tail that fills no round is left out."""
    return df.withColumn("round", F.floor(F.col(order) / size)).where(F.col("round") < F.floor(F.col(total) / size))


def temporal_holdout(n: Column, fraction: float) -> Column:
    """How many of ``n`` samples, the last ones, are for validation; null where too few are left to train or to validate."""
    wanted = F.least(F.greatest(F.lit(2), F.bround(n * fraction).cast("long")), n - 1)
    return F.when((wanted >= 2) & (n - wanted >= 1), wanted)


def latest(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` latest rows of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def released(df: DataFrame, key: str, order: str, length: int, columns: list[str]) -> DataFrame:
    """Rows that leave a first-in-first-out buffer of ``length``: each position with the columns of the row that it pushes out."""
    w = Window.partitionBy(key).orderBy(order)
    out = df.withColumns({f"released_{c}": F.lag(c, length).over(w) for c in [order, *columns]})
    return out.where(F.col(f"released_{order}").isNotNull())


def halves(n: Column, order: Column) -> Column:
    """0 for the first floor(n / 2) rows, 1 for the rest."""
    return F.when(order < F.floor(n / 2), 0).otherwise(1)


def previous_difference(df: DataFrame, key: str, order: str, counters: list[str]) -> DataFrame:
    """Cumulative counters as differences to the row before."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({c: F.col(c) - F.lag(c, 1, 0).over(w) for c in counters})
