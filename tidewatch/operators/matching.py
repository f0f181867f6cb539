"""Matching of two ordered collections: tolerance joins, as-of joins, classifications, aligned windows."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def match_events(truth: DataFrame, events: DataFrame, tolerance: int, key: str = "client", order: str = "pos") -> DataFrame:
    """Greedy one-to-one matching: each true position, in order, takes the first unused event within ``[true, true + tolerance]``.

    One row for each truth and event, merged in order: ``kind`` (``truth``/``event``), ``pos`` and, on matched events, ``true_pos`` and
    ``delay``. An event goes to the earliest true position that still waits for one, so the state is the truths of one tolerance.
    """
    both = truth.select(key, order, F.lit(0).alias("__kind")).unionByName(events.select(key, order, F.lit(1).alias("__kind")))

    def start():
        waiting: deque[int] = deque()

        def step(pos, kind):
            pos = int(pos)
            if kind == 0:
                waiting.append(pos)
                return "truth", pos, None, None
            while waiting and waiting[0] + tolerance < pos:
                waiting.popleft()
            if waiting:
                true = waiting.popleft()
                return "event", pos, true, pos - true
            return "event", pos, None, None

        return step

    return fold(both, [key], [order, "__kind"], start, [order, "__kind"], f"kind string, {order} long, true_pos long, delay long")


def match_recorded(truth: DataFrame, events: DataFrame, tolerance: int, key: str = "client", order: str = "pos", recorded: str = "seq") -> DataFrame:
    """Greedy one-to-one matching where events were not recorded in the order of their positions: each true position, in order, takes the unused
    event within ``[true, true + tolerance]`` that was recorded first.

    One row for each truth and event: ``kind``, ``pos``, ``seq`` (of events) and, on matched events, ``true_pos`` and ``delay``. A truth is decided
    when the walk has passed its tolerance, when all events that it may take are known; so the state is the events of one tolerance.
    """
    marks = truth.select(key, (F.col(order) + tolerance).alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias(recorded))
    both = marks.unionByName(events.select(key, F.col(order).alias("__at"), F.lit(0).alias("__kind"), F.col(recorded).cast("long").alias(recorded)))
    schema = f"kind:string,{order}:bigint,{recorded}:bigint,true_pos:bigint,delay:bigint"

    def start():
        held: list[tuple[int, int]] = []  # (seq, pos) of unused events

        def step(at, kind=None, seq=None):
            if at is None:
                return ([("event", pos, s, None, None) for s, pos in held],) if held else None
            at, true = int(at), int(at) - tolerance
            rows = [("event", pos, s, None, None) for s, pos in held if pos < true]
            held[:] = [e for e in held if e[1] >= true]
            if kind == 0:
                held.append((int(seq), at))
            else:
                rows.append(("truth", true, None, None, None))
                if held:
                    taken = min(held)
                    held.remove(taken)
                    rows.append(("event", taken[1], taken[0], true, taken[1] - true))
            return (rows,) if rows else None

        return step

    found = fold(both, [key], ["__at", "__kind", recorded], start, ["__at", "__kind", recorded], f"rows array<struct<{schema}>>", flush=True)
    return found.selectExpr(key, "inline(rows)")


def detection_counts(matched: DataFrame, key: list[str]) -> DataFrame:
    """``tp``, ``fp``, ``fn``, ``total_true``, ``total_detect`` and their ratios (0 where undefined) and mean delay."""
    tp = F.sum(F.when(F.col("true_pos").isNotNull(), 1).otherwise(0))
    counts = matched.groupBy(*key).agg(
        tp.alias("tp"),
        F.sum(F.when(F.col("kind") == "truth", 1).otherwise(0)).alias("total_true"),
        F.sum(F.when(F.col("kind") == "event", 1).otherwise(0)).alias("total_detect"),
        F.coalesce(F.avg("delay"), F.lit(0.0)).alias("avg_delay"),
    )
    counts = counts.withColumns({"fp": F.col("total_detect") - F.col("tp"), "fn": F.col("total_true") - F.col("tp")})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.withColumns(
        {
            "recall": ratio(F.col("tp"), F.col("total_true")),
            "precision": ratio(F.col("tp"), F.col("total_detect")),
            "f1": ratio(2 * F.col("tp"), F.col("total_true") + F.col("total_detect")),
            "miss_rate": ratio(F.col("fn"), F.col("total_true")),
            "fdr": ratio(F.col("fp"), F.col("total_detect")),
        }
    )


def near(left: DataFrame, right: DataFrame, before: int, after: int, key: str = "client", order: str = "pos", how: str = "left") -> DataFrame:
    """``left`` with ``true_pos`` of all ``right`` rows from ``before`` below to ``after`` above the left position.

    A range join: positions fall into buckets as wide as the range, so that rows meet by equality with the two or three buckets in reach
    and keys with many rows spread over their buckets.
    """
    width = before + after + 1
    reach = right.select(key, F.col(order).alias("true_pos")).distinct()
    reach = reach.withColumn("__bucket", F.explode(F.sequence(F.floor((F.col("true_pos") - after) / width), F.floor((F.col("true_pos") + before) / width))))
    placed = left.withColumn("__bucket", F.floor(F.col(order) / width))
    inside = F.col(f"l.{order}").between(F.col("r.true_pos") - after, F.col("r.true_pos") + before)
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.__bucket") == F.col("r.__bucket")) & inside
    joined = placed.alias("l").join(reach.alias("r"), on, how)
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], "r.true_pos")


def classify_unmatched(unmatched: DataFrame, truth: DataFrame, tolerance: int, key: str = "client", order: str = "pos") -> DataFrame:
    """``class`` of each unmatched event by the first rule that holds for some true position t: ``duplicate`` in [t, t + tol], ``early`` in
    [t - tol, t), ``late`` in (t + tol, t + 2 tol], else ``isolated``."""
    met = near(unmatched, truth, before=2 * tolerance, after=tolerance, key=key, order=order)
    gap = F.col(order) - F.col("true_pos")
    rank = F.when(gap.between(0, tolerance), 1).when(gap < 0, 2).when(gap > tolerance, 3).otherwise(4)
    best = met.groupBy(key, order).agg(F.min(rank).alias("__rank"))
    names = F.array(*map(F.lit, ("duplicate", "early", "late", "isolated")))
    return best.select(key, order, F.element_at(names, F.col("__rank")).alias("class"))


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row at or before each row (right rows of one position: the greatest value)."""
    both = left.withColumns({"__side": F.lit(1), value: F.lit(None).cast(dict(right.dtypes)[value])}).unionByName(
        right.select(key, order, value, F.lit(0).alias("__side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(order, "__side", F.col(value).asc_nulls_first())
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__side = 1").drop("__side")


def aligned(events: DataFrame, samples: DataFrame, longest: int, key: str = "client", order: str = "pos") -> DataFrame:
    """Samples from 0 to ``longest`` behind each event of their key, with ``delta``; windows may overlap and end with the stream."""
    met = near(samples, events, before=longest, after=0, key=key, order=order, how="inner")
    return met.withColumn("delta", F.col(order) - F.col("true_pos"))


def recovery_curve(events: DataFrame, samples: DataFrame, longest: int, correct: str = "correct", key: str = "client", order: str = "pos") -> DataFrame:
    """Pooled accuracy by distance from the last change: ``delta``, ``correct``, ``n``, ``accuracy``."""
    pooled = aligned(events, samples, longest, key, order).groupBy("delta").agg(F.sum(correct).alias("correct"), F.count("*").alias("n"))
    return pooled.withColumn("accuracy", F.col("correct") / F.col("n"))


def stable_mask(order: Column, last_event: Column, window: int) -> Column:
    """Whether a row is not within ``window`` rows of the last event."""
    return F.coalesce(order >= last_event + window, F.lit(True))


def pair_sums(cells: DataFrame, left: str, right: str, sums: list[str]) -> DataFrame:
    """Directed cells folded to unordered pairs (``low``, ``high``), self pairs left out."""
    pairs = cells.where(F.col(left) != F.col(right)).withColumns({"low": F.least(left, right), "high": F.greatest(left, right)})
    return pairs.groupBy("low", "high").agg(*[F.sum(c).alias(c) for c in sums])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer merge: blanks are filled from the other side; ``conflict`` where both have different values."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    merged = a.join(b, on, "full_outer")
    clash = F.lit(False)
    for v in values:
        clash = clash | F.coalesce(F.col(f"a.{v}") != F.col(f"b.{v}"), F.lit(False))
    return merged.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in keys + values], clash.alias("conflict"))


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` by ``mapping`` (``old``, ``new``), kept where there is no entry."""
    joined = rows.join(mapping, rows[column] == mapping["old"], "left")
    return joined.withColumn(column, F.coalesce("new", column)).drop("old", "new")
