"""What follows an alarm: episodes, resolution by stored models, validation of new ones, batch detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def episodes(alarms: DataFrame, length: int, key: str = "client", order: str = "pos", operate: str | None = None) -> DataFrame:
    """``episode`` of each alarm (the first alarm outside the one before opens it, for ``length`` positions) and whether an operation is still
    ``allowed`` in it. An operation is done at an allowed alarm where column ``operate`` holds (everywhere if None)."""

    def start():
        state = {"id": -1, "start": None, "done": False}

        def step(pos, acts=True):
            if state["start"] is None or pos >= state["start"] + length:
                state.update(id=state["id"] + 1, start=pos, done=False)
            allowed = not state["done"]
            state["done"] = state["done"] or (allowed and bool(acts))
            return int(pos), state["id"], allowed

        return step

    return fold(alarms, [key], [order], start, [order] + ([operate] if operate else []), f"{order} long, episode long, allowed boolean")


def resolve(fits: DataFrame, scope: list[str], limit: float) -> DataFrame:
    """Decision of each alarm from candidates (``model``, ``loss``, ``history``, ``current``): the fitting model (loss - history <= ``limit``,
    history not 0) of the least loss, first by id, is maintained if current, else reused; without one a model is created."""
    fitting = (F.col("history") != 0) & (F.col("loss") - F.col("history") <= limit)
    best = F.min(F.when(fitting, F.struct("loss", "model", "current"))).alias("b")
    return fits.groupBy(*scope).agg(best).select(
        *scope, F.when(F.col("b").isNull(), "create").when(F.col("b.current"), "maintain").otherwise("reuse").alias("action"), F.col("b.model").alias("model")
    )


def forward_reference(candidates: DataFrame, scope: list[str], limit: float, preferred: str = "preferred") -> DataFrame:
    """The reference to beat: of those whose mean passes its history by at most ``limit``, the preferred one if it is there, else the least mean."""
    fit = F.col("mean") - F.col("history") <= limit
    return candidates.groupBy(*scope).agg(
        F.coalesce(F.min(F.when(fit & F.col(preferred), F.col("model"))), F.min(F.when(fit, F.struct("mean", "model")))["model"]).alias("reference")
    )


def validation(losses: DataFrame, scope: list[str], order: str, gain: float = 1e-4, disjoint: bool = False) -> DataFrame:
    """Verdict on a candidate (columns ``candidate``, ``reference``: losses of the same samples): it must be better by more than ``gain`` on
    all samples and on the recent half (or, ``disjoint``, on either half). ``n``, margins and ``reason``."""
    n = Window.partitionBy(*scope)
    w = n.orderBy(order)
    placed = losses.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(n), "__gap": F.col("candidate") - F.col("reference")})
    recent = F.col("__i") >= F.floor(F.col("__n") / 2)
    sums = placed.groupBy(*scope).agg(
        F.count("*").alias("n"), F.avg("__gap").alias("full"), F.avg(F.when(~recent, F.col("__gap"))).alias("first"), F.avg(F.when(recent, F.col("__gap"))).alias("recent")
    )
    names = ("first", "recent", "first_interval", "second_interval", "first_and_second") if disjoint else ("full", "recent", "full_interval", "recent_interval", "full_and_recent")
    a, b = (~(F.col(x) < -gain) for x in names[:2])
    reason = F.when(F.col("n") < 2, "insufficient_data").when(a & b, names[4]).when(a, names[2]).when(b, names[3]).otherwise("accepted")
    return sums.withColumn("reason", reason)


def batch_shift(batches: DataFrame, key: str, order: str, best: str, gain: float) -> DataFrame:
    """Batches whose least mean loss is above the batch's before by more than ``gain``; never a key's first."""
    w = Window.partitionBy(key).orderBy(order)
    return batches.withColumn("before", F.lag(best).over(w)).withColumn("shift", F.coalesce(F.col(best) > F.col("before") + gain, F.lit(False)))


def forced(df: DataFrame, key: str, order: str, loss: str, width: int, limit: Column) -> DataFrame:
    """Rows at which the mean loss of the last ``width`` rows has reached ``limit``, whatever the detector says."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(width - 1), 0)
    counted = df.withColumns({"recent": F.avg(loss).over(w), "__n": F.count("*").over(w)})
    return counted.where((F.col("__n") == width) & (F.col("recent") >= limit)).drop("__n")


def estimated_start(pos: Column, buffered: int, span: Column) -> Column:
    """The estimated beginning of a change that a detector dates ``span`` rows back, within what is buffered."""
    return F.greatest(pos - F.least(F.lit(buffered), span), F.lit(-1)) + 1
