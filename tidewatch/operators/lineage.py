"""What clustering rounds leave on record of models, and who stands for a model in the end, over any number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import forget, written


def observations(models: DataFrame, pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row for each model of each round: its ``nearest`` other and the ``distance`` (-1 and null where no pair of it was evaluated), its cluster's
    ``representative`` (the smallest model), ``size``, greatest ``widest`` distance of a pair inside (null without one), ``evaluated`` and ``possible``
    pairs inside, and whether it was ``absorbed``.

    ``models`` (``round``, ``model``), ``pairs`` (``round``, ``i``, ``j``, ``distance``, each pair once), ``clusters`` (``round``, ``model``, ``representative``).
    """
    both = pairs.select("round", F.col("i").alias("model"), F.col("j").alias("other"), "distance")
    both = both.unionByName(pairs.select("round", F.col("j").alias("model"), F.col("i").alias("other"), "distance"))
    near = both.groupBy("round", "model").agg(F.min(F.struct("distance", "other")).alias("near"))
    of = clusters.select("round", "model", "representative")
    sides = pairs.join(of.withColumnsRenamed({"model": "i", "representative": "a"}), ["round", "i"]).join(of.withColumnsRenamed({"model": "j", "representative": "b"}), ["round", "j"])
    inside = sides.where("a = b").groupBy("round", F.col("a").alias("representative")).agg(F.max("distance").alias("widest"), F.count("*").alias("evaluated"))
    sizes = of.groupBy("round", "representative").agg(F.count("*").alias("size"))
    told = of.join(sizes, ["round", "representative"]).join(inside, ["round", "representative"], "left")
    size = F.col("size")
    return models.select("round", "model").join(told, ["round", "model"]).join(near, ["round", "model"], "left").select(
        "round", "model", F.coalesce("near.other", F.lit(-1)).alias("nearest"), F.col("near.distance").alias("distance"), "representative", "size", "widest",
        F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.floor(size * (size - 1) / 2).alias("possible"), (F.col("model") != F.col("representative")).alias("absorbed"),
    )


def ancestry(absorbed: DataFrame) -> DataFrame:
    """Of each absorption (``round``, ``model``, ``representative``; a model once a round) the ``ancestor`` that stands for the model in the end, the
    ``last`` round in which one of its line was absorbed, and the ``steps`` there.

    A line goes on with the representative's first absorption in a later round. Lines are followed by pointer jumping: each written round of joins
    doubles how far every open line reaches, so rounds grow with the logarithm of the longest line.
    """
    next_ = absorbed.select(F.col("model").alias("representative"), F.col("round").alias("later"))
    heads = absorbed.join(next_, "representative").where("later > round").groupBy("round", "model").agg(F.min("later").alias("later"))
    lines = absorbed.join(heads, ["round", "model"], "left").select(
        "round", "model", F.col("representative").alias("ancestor"), F.col("round").alias("last"), "later", F.lit(1).cast("long").alias("steps")
    )
    lines, is_open = _written(lines)
    while is_open:
        # An open line's ancestor is absorbed in round ``later``: that absorption's own line follows.
        tail = lines.select(F.col("model").alias("ancestor"), F.col("round").alias("later"), F.col("ancestor").alias("end"), F.col("last").alias("end_last"), F.col("later").alias("end_later"), F.col("steps").alias("more"))
        longer = lines.where("later IS NOT NULL").join(tail, ["ancestor", "later"]).select(
            "round", "model", F.col("end").alias("ancestor"), F.col("end_last").alias("last"), F.col("end_later").alias("later"), (F.col("steps") + F.col("more")).alias("steps")
        )
        before = lines
        lines, is_open = _written(before.where("later IS NULL").unionByName(longer))
        forget(before)
    return lines.drop("later")


def _written(lines: DataFrame) -> tuple[DataFrame, int]:
    """The lines as a table, and how many are open."""
    seen = Observation()
    table = written(lines.observe(seen, F.count("later").alias("open")), "lineage")
    return table, seen.get["open"]
