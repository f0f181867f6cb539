"""Mergeable statistics and weighted aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_statistics(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """``n``, ``mean``, ``variance`` (sample); mean and variance are 0 below two values."""
    found = df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    few = F.col("n") < 2
    return found.withColumns({"mean": F.when(few, 0.0).otherwise(F.col("mean")), "variance": F.when(few, 0.0).otherwise(F.col("variance"))})


def sufficient(df: DataFrame, key: list[str], value: Column, least: int = 5) -> DataFrame:
    """``n``, ``total``, ``squares``; zeros where a group has fewer than ``least`` values."""
    found = df.groupBy(*key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"))
    enough = F.col("n") >= least
    return found.withColumns({"total": F.when(enough, F.col("total")).otherwise(0.0), "squares": F.when(enough, F.col("squares")).otherwise(0.0), "n": F.when(enough, F.col("n")).otherwise(0)})


def weighted_vectors(df: DataFrame, key: list[str], vector: str, weight: str) -> DataFrame:
    """Weighted mean vectors: ``key``, ``at`` (place), ``value``. Rows without weight are skipped; a group whose weights are all 0 keeps the
    vector of its first owner (column ``owner``)."""
    long = df.select(*key, "owner", weight, F.posexplode(vector).alias("at", "v"))
    summed = long.groupBy(*key, "at").agg(
        F.sum(F.when(F.col(weight) > 0, F.col("v").cast("double") * F.col(weight))).alias("s"),
        F.sum(F.when(F.col(weight) > 0, F.col(weight))).alias("w"),
        F.min_by(F.col("v").cast("double"), "owner").alias("first"),
    )
    return summed.select(*key, "at", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.col("first")).alias("value"))


def merge_statistics(df: DataFrame, key: list[str]) -> DataFrame:
    """Merged ``n``, ``mean``; the sum of squared deviations starts anew at 0."""
    return df.groupBy(*key).agg(F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.lit(0.0).alias("m2"))


def complementarity(df: DataFrame, key: list[str]) -> DataFrame:
    """From 2x2 correctness tables (``c_only``, ``t_only``, ``both``, ``n``): disagreement, oracle gain, rate of both right; zeros if empty."""
    ratio = lambda x: F.when(F.sum("n") > 0, F.sum(x) / F.sum("n")).otherwise(0.0)
    return df.groupBy(*key).agg(
        F.count("*").alias("pairs"),
        ratio(F.col("c_only") + F.col("t_only")).alias("disagreement"),
        ratio(F.least("c_only", "t_only")).alias("oracle_gain"),
        ratio(F.col("both")).alias("both_correct"),
    )


def spread(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Population mean and deviation of columns; the deviation of one value is 0."""
    aggregates = [F.count("*").alias("n")]
    for c in columns:
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{c}_std")]
    return df.groupBy(*key).agg(*aggregates)


def two_level(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Totals of the inner groups, rolled up over the outer ones: total, mean, min and coefficient of variation (population)."""
    totals = df.groupBy(*outer, *inner).agg(F.sum(value).alias("x"))
    mean = F.avg("x")
    return totals.groupBy(*outer).agg(
        F.sum("x").alias("total"), mean.alias("mean"), F.min("x").alias("least"), F.when(mean != 0, F.stddev_pop("x") / mean).otherwise(0.0).alias("cv")
    )


def largest_statistic(df: DataFrame, key: list[str], n: str, order: str, columns: list[str]) -> DataFrame:
    """Of each key the row with the largest ``n``, the first by ``order`` on ties."""
    rank = F.struct((-F.col(n)).alias("a"), F.col(order).alias("b"))
    return df.groupBy(*key).agg(F.min_by(F.struct(n, *columns), rank).alias("s")).select(*key, "s.*")


def dot(a: str, b: str) -> Column:
    """Inner product of two numeric arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def conflicts(vectors: DataFrame, key: list[str], owner: str, vector: str) -> DataFrame:
    """Over unordered pairs of non-zero vectors of a group: pairs, cosine sum, and number and sum of negative cosines."""
    ready = vectors.withColumn("__norm", norm(vector)).where("__norm > 0")
    a = ready.select(*key, F.col(owner).alias("i"), F.col(vector).alias("u"), F.col("__norm").alias("nu"))
    b = ready.select(*key, F.col(owner).alias("j"), F.col(vector).alias("v"), F.col("__norm").alias("nv"))
    cosine = a.join(b, key).where("i < j").withColumn("cosine", dot("u", "v") / (F.col("nu") * F.col("nv")))
    negative = F.col("cosine") < 0
    return cosine.groupBy(*key).agg(
        F.count("*").alias("pairs"), F.sum("cosine").alias("cosine_sum"), F.sum(negative.cast("long")).alias("conflicts"), F.sum(F.when(negative, F.col("cosine")).otherwise(0.0)).alias("negative_sum")
    )
