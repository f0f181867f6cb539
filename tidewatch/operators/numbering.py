"""Row numbers and neighbours in an order over any number of rows, without a task for a group.

Rows are range-partitioned and sorted once, written with their places, and only one row for each partition and group is looked at in a single
order: how many rows lie before, and which is the last. A group of any size lies over as many tasks as it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .skew import fresh


def _placed(rows: DataFrame, order: list[str], by: list[str]) -> tuple[DataFrame, str, str]:
    """The rows as a table in order, with ``place`` (rising) and ``part`` columns."""
    place, part = fresh(rows, "place"), fresh(rows, "part")
    ordered = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    table = written(ordered.withColumn(place, F.monotonically_increasing_id()), "ordered")
    return table.withColumn(part, F.shiftright(place, 33)), place, part


def _joined(table: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``heads`` to each row; null keys are equal."""
    named = heads.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return table.join(named, on).drop(*[f"__{k}" for k in keys])


def numbered(rows: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """``rows`` with their number from 1 in ``order`` (of all rows, or within each group of ``by``) as column ``name``."""
    by = by or []
    table, place, part = _placed(rows, order, by)
    heads = table.groupBy(*by, part).agg(F.min(place).alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(*by, part, (before - F.col("__first") + 1).alias("__shift"))
    return _joined(table, heads, [*by, part]).select(*rows.columns, (F.col(place) + F.col("__shift")).alias(name))


def with_previous(rows: DataFrame, order: list[str], values: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``rows`` with what the row before has (in its group): ``values`` maps columns to the names of what they were; null at a group's first row."""
    by = by or []
    table, place, part = _placed(rows, order, by)
    within = Window.partitionBy(*by, part).orderBy(place)
    last = F.max_by(F.struct(*values), place).alias("__own")
    heads = table.groupBy(*by, part).agg(last)
    heads = heads.select(*by, part, F.lag("__own").over(Window.partitionBy(*by).orderBy(part)).alias("__last"))
    inner = table.withColumn("__inner", F.lag(F.struct(*values)).over(within))
    both = _joined(inner, heads, [*by, part]).withColumn("__was", F.coalesce("__inner", "__last"))
    return both.select(*rows.columns, *[F.col(f"__was.{old}").alias(new) for old, new in values.items()])
