"""Concept schedules of clients: fixed patterns expanded to positions, and random changes with a stable period."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generators import uniform
from .streams import block_of

# Concepts of ten clients (columns) over ten time blocks (rows), for two and for four concepts.
PATTERNS = {
    2: (
        (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        (0, 1, 0, 0, 0, 0, 0, 0, 0, 0),
        (0, 1, 0, 0, 0, 0, 0, 1, 0, 0),
        (0, 1, 1, 1, 0, 1, 0, 1, 0, 0),
        (0, 1, 1, 1, 0, 1, 0, 1, 1, 0),
        (1, 0, 1, 1, 0, 1, 1, 0, 1, 0),
        (1, 0, 0, 1, 0, 0, 1, 0, 1, 0),
        (1, 0, 0, 0, 1, 0, 1, 0, 1, 1),
        (1, 0, 0, 0, 1, 0, 1, 0, 0, 1),
        (1, 0, 0, 0, 1, 0, 1, 0, 0, 1),
    ),
    4: (
        (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        (1, 1, 1, 0, 0, 0, 0, 0, 0, 0),
        (1, 1, 1, 2, 2, 2, 0, 0, 0, 0),
        (2, 2, 1, 2, 2, 2, 2, 1, 0, 0),
        (2, 2, 2, 1, 2, 2, 2, 1, 3, 0),
        (2, 3, 2, 1, 2, 3, 3, 1, 3, 0),
        (3, 3, 2, 1, 1, 3, 3, 2, 1, 0),
        (3, 0, 3, 3, 1, 3, 3, 2, 1, 3),
        (0, 0, 3, 3, 3, 1, 3, 2, 2, 3),
        (0, 0, 0, 3, 3, 1, 1, 3, 2, 2),
    ),
}


def fixed(spark: SparkSession, concepts: int, clients: int, n: int) -> DataFrame:
    """``client``, ``pos``, ``concept``: each block of the pattern over its share of ``n`` positions, the first blocks a position longer."""
    if concepts not in PATTERNS or not 1 <= clients <= 10 or n < 1:
        raise ValueError("fixed schedules have 2 or 4 concepts, 1 to 10 clients and at least one position")
    every = spark.range(clients * n).select((F.col("id") % clients).alias("client"), F.floor(F.col("id") / clients).alias("pos"), F.lit(n).alias("n"))
    return fixed_over(every, concepts)


def fixed_over(rows: DataFrame, concepts: int) -> DataFrame:
    """``client``, ``pos``, ``concept`` of given rows (``n``: the client's number of rows); clients beyond ten take the pattern's columns in turn."""
    pattern = F.array(*[F.array(*map(F.lit, row)) for row in PATTERNS[concepts]])
    row = F.get(pattern, block_of(F.col("pos"), F.col("n")).cast("int"))
    return rows.select("client", "pos", F.get(row, (F.col("client") % 10).cast("int")).cast("long").alias("concept"))


def random(spark: SparkSession, concepts: int, clients: int, n: int, stable: int, probability: float, salt: int = 1) -> DataFrame:
    """:func:`random_over` of ``clients`` with ``n`` positions each."""
    i = F.col("id")
    return random_over(spark.range(clients * n).select(F.floor(i / n).alias("client"), (i % n).alias("pos"), "id"), concepts, stable, probability, salt)


def random_over(rows: DataFrame, concepts: int, stable: int, probability: float, salt: int = 1) -> DataFrame:
    """``client``, ``pos``, ``concept`` of given rows, drawn by their ``id``: a change to one of the other concepts may come with ``probability`` at each position more than
    ``stable`` behind the last one. A client is walked in order, with one concept and one position as its state."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = {}
        for batch in batches:
            out = []
            for client, pos, chance, choice in batch[["client", "pos", "chance", "choice"]].itertuples(index=False, name=None):
                concept, last = now.get(client, (0, 0))
                if pos - last > stable and chance < probability:
                    concept, last = (concept + 1 + int(choice * (concepts - 1))) % concepts, pos
                now = {client: (concept, last)}
                out.append((client, pos, concept))
            yield pd.DataFrame(out, columns=["client", "pos", "concept"])

    drawn = rows.select("client", "pos", uniform(F.col("id"), salt).alias("chance"), uniform(F.col("id"), salt + 1).alias("choice"))
    return drawn.repartition("client").sortWithinPartitions("client", "pos").mapInPandas(walk, "client long, pos long, concept long")


def schedule(spark: SparkSession, kind: str, concepts: int, clients: int, n: int, stable: int = 300, probability: float = 0.0015) -> DataFrame:
    """By kind: ``fixed`` or ``random``."""
    if kind == "fixed":
        return fixed(spark, concepts, clients, n)
    if kind == "random":
        return random(spark, concepts, clients, n, stable, probability)
    raise ValueError(f"unknown schedule {kind!r}")
