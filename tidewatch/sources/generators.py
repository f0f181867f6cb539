"""Synthetic labelled samples by concept, as column expressions over ids.

Draws are functions of (id, salt), so a sample is the same however rows are partitioned, and any engine can recompute it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_M = 2147483647

# Parameters of the published benchmark concepts.
THRESHOLDS = (9.0, 8.0, 7.0, 9.5)
LABEL_NOISE = 0.1
CIRCLES = ((0.2, 0.5, 0.15), (0.6, 0.5, 0.25))
CONCEPTS = {"blobs": 4, "sea4": 4, "sea2": 2, "circle2": 2, "sine2": 2, "mnist2": 2, "mnist4": 4}


def uniform(i: Column, salt: int) -> Column:
    """In [0, 1), by two rounds of a multiplicative generator with a quadratic step between."""
    a = (i % _M * 48271 + (salt * 7919 + 12345)) % _M
    b = (a * a % _M + a * 69621 + salt) % _M
    return b / float(_M)


def uniform_sql(i: str, salt: int) -> str:
    a = f"(({i}) % {_M} * 48271 + {salt * 7919 + 12345}) % {_M}"
    return f"((({a}) * ({a}) % {_M} + ({a}) * 69621 + {salt}) % {_M}) / {float(_M)}"


def normal(i: Column, salt: int) -> Column:
    """Standard normal, by the Box-Muller transform."""
    return F.sqrt(-2 * F.ln(1 - uniform(i, salt))) * F.cos(2 * math.pi * uniform(i, salt + 1))


def _pick(concept: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), concept.cast("int") + 1)


def blobs(i: Column, concept: Column) -> tuple[list[Column], Column]:
    """Two Gaussian blobs, swapped between concepts 0 and 2; two rings, swapped between 1 and 3."""
    y = F.when(uniform(i, 1) < 0.5, 0.0).otherwise(1.0)
    side = F.when((y == 0) == (concept == 0), -2.0).otherwise(2.0)
    inner = (y == 0) == (concept == 1)
    r = F.when(inner, 1.5 + 0.4 * normal(i, 2)).otherwise(4.5 + 0.5 * normal(i, 2))
    theta = 2 * math.pi * uniform(i, 4)
    even = concept % 2 == 0
    return [F.when(even, side + 0.6 * normal(i, 5)).otherwise(r * F.cos(theta)), F.when(even, side + 0.6 * normal(i, 7)).otherwise(r * F.sin(theta))], y


def threshold(i: Column, concept: Column) -> tuple[list[Column], Column]:
    """Three features in [0, 10); true where the first two add up to the concept's threshold at most, a tenth of labels flipped."""
    x = [10 * uniform(i, k) for k in (1, 2, 3)]
    y = F.when(x[0] + x[1] <= _pick(concept, THRESHOLDS), 1.0).otherwise(0.0)
    return x, F.when(uniform(i, 4) < LABEL_NOISE, 1 - y).otherwise(y)


def circle(i: Column, concept: Column) -> tuple[list[Column], Column]:
    """Two features in [0, 1); true outside the concept's circle."""
    x = [uniform(i, k) for k in (1, 2)]
    cx, cy, r = (_pick(concept, [c[k] for c in CIRCLES]) for k in range(3))
    return x, F.when((x[0] - cx) * (x[0] - cx) + (x[1] - cy) * (x[1] - cy) - r * r > 0, 1.0).otherwise(0.0)


def sine(i: Column, concept: Column) -> tuple[list[Column], Column]:
    """Two features in [0, 1); true below the sine curve, the other way round in concept 1."""
    x = [uniform(i, k) for k in (1, 2)]
    below = F.when(x[1] <= F.sin(x[0]), 1.0).otherwise(0.0)
    return x, F.when(concept == 0, below).otherwise(1 - below)


GENERATORS: dict[str, Callable] = {"blobs": blobs, "sea4": threshold, "sea2": threshold, "circle2": circle, "sine2": sine}


def samples(rows: DataFrame, dataset: str, index: str = "id", concept: str = "concept") -> DataFrame:
    """``rows`` with ``x`` (array) and ``y`` by the rows' concepts."""
    if dataset not in GENERATORS:
        raise ValueError(f"unknown dataset {dataset!r}")
    x, y = GENERATORS[dataset](F.col(index), F.col(concept))
    return rows.withColumns({"x": F.array(*x), "y": y})


def generate(spark: SparkSession, dataset: str, concept: int, n: int) -> DataFrame:
    """``n`` samples of one concept."""
    if not 0 <= concept < CONCEPTS[dataset]:
        raise ValueError(f"{dataset} has no concept {concept}")
    return samples(spark.range(n).withColumn("concept", F.lit(concept)), dataset)


def swap_labels(label: Column, concept: Column) -> Column:
    """Concept k > 0 swaps labels 2k - 1 and 2k."""
    low = 2 * concept - 1
    return F.when((concept > 0) & (label == low), low + 1).when((concept > 0) & (label == low + 1), low).otherwise(label)


def bootstrap(rows: DataFrame, n: int, index: str, salt: int = 1) -> DataFrame:
    """``n`` draws with replacement from ``rows``, numbered 0.. by ``index``: exactly ``n``, by a join on drawn numbers."""
    total = rows.count()
    drawn = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(F.col("id"), salt) * total).alias("__at"))
    return drawn.join(rows, F.col("__at") == F.col(index)).drop("__at")
