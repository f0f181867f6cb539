"""The canonical keyed stream: events dealt to clients, numbered in time order, with concepts, losses and a recovery curve.

Columns: ``client``, ``pos``, ``n`` (rows of the client), ``label``, ``frac`` in [0, 1], ``tid`` (time block), ``concept``, ``drift``,
``ld`` (last drift at or before the position), ``correct``, ``loss``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least number of clients, and the events that make another one: keys grow with the data.
CLIENTS = 10
EVENTS_A_CLIENT = 1000
BLOCKS = 10


def clients_of(events: DataFrame) -> int:
    """The number of clients that events are dealt to; counted from the files' metadata."""
    return max(CLIENTS, events.count() // EVENTS_A_CLIENT)


def block_of(pos: Column, n: Column, blocks: int = BLOCKS) -> Column:
    """The time block of a position where ``n`` rows are dealt to ``blocks`` blocks, the first ones a row longer."""
    q, r = F.floor(n / blocks), n % blocks
    return F.when(pos < r * (q + 1), F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("long")


def start_of(block: Column, n: Column, blocks: int = BLOCKS) -> Column:
    """The first position of a time block; ``n`` or more where the block is empty."""
    return (block * F.floor(n / blocks) + F.least(block, n % blocks)).cast("long")


def _change_of(block: Column, client: Column) -> Column:
    """The last block up to ``block`` at whose start the concept of :func:`stream` changes; below 1 if there is none. Division cuts towards zero, so
    the sum of block and client changes it at 2, 4, … and at -1, -3, …"""
    at = block + client
    below = F.least(at, F.lit(0))
    return F.when(at >= 2, at - at % 2).otherwise(below - F.pmod(below + 1, F.lit(2))) - client


def positions(events: DataFrame, clients: int | None = None) -> DataFrame:
    """``client``, ``pos``, ``n``, ``label``, ``frac``.

    A position is the number of the client's rows on the days before the row's, by a running sum over one row a client and day, and
    the row's number within its day: a client with a large part of all rows is dealt to as many tasks as it has days. Rows without a time come
    last, and events without a user are a client of their own, without a key, as in the SQL. Events of one time and id, whose order the SQL leaves open,
    go by label and value: the stream doesn't depend on how they are stored or dealt.
    """
    dealt = events.select(
        (F.col("user_id") % (clients or clients_of(events))).alias("client"), F.to_date("ts").alias("day"), "ts", "event_id", F.col("event_type").alias("label"), F.least(F.col("value") / 200, F.lit(1.0)).alias("frac")
    )
    whole = Window.partitionBy("client")
    past = whole.orderBy(F.asc_nulls_last("day")).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("client", "day").agg(F.count("*").alias("k"))
    days = counts.select(F.col("client").alias("__client"), F.col("day").alias("__day"), F.coalesce(F.sum("k").over(past), F.lit(0)).alias("before"), F.sum("k").over(whole).alias("n"))
    within = Window.partitionBy("client", "day").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"), "label", "frac")
    same = F.col("client").eqNullSafe(F.col("__client")) & F.col("day").eqNullSafe(F.col("__day"))
    numbered = dealt.withColumn("i", F.row_number().over(within)).join(days, same)
    return numbered.select("client", (F.col("before") + F.col("i") - 1).alias("pos"), "n", "label", "frac")


def stream(events: DataFrame, clients: int | None = None) -> DataFrame:
    """All columns of the canonical stream. Concepts follow from time blocks, so changes are found by arithmetic, not by windows."""
    s = positions(events, clients).withColumn("tid", block_of(F.col("pos"), F.col("n")))
    at = F.col("tid") + F.col("client")
    s = s.withColumn("concept", ((at - at % 2) / 2).cast("long") % 2)
    change = _change_of(F.col("tid"), F.col("client"))
    s = s.withColumn("ld", F.when(change >= 1, start_of(change, F.col("n"))))
    s = s.withColumn("drift", F.coalesce(F.col("pos") == F.col("ld"), F.lit(False)))
    since = F.coalesce(F.col("pos") - F.col("ld"), F.lit(999))
    ramp = F.least(F.lit(90), 20 + 3 * since) / 100  # whole hundredths, divided once: as doubles 0.2 + 0.03 * 3 would be above 0.29
    s = s.withColumn("correct", (F.col("frac") < ramp).cast("int"))
    s = s.withColumn("loss", F.when(F.col("concept") == 1, 0.6 + 0.3 * F.col("frac")).otherwise(0.2 * F.col("frac")))
    return s.select("client", "pos", "n", "label", "frac", "tid", "concept", "drift", "ld", "correct", "loss")


def changes(events: DataFrame, clients: int | None = None) -> DataFrame:
    """``client`` and ``pos`` of the stream's changes, from the clients' numbers of rows alone."""
    totals = events.groupBy((F.col("user_id") % (clients or clients_of(events))).alias("client")).agg(F.count("*").alias("n"))
    blocks = totals.select("client", "n", F.explode(F.array(*[F.lit(t).cast("long") for t in range(1, BLOCKS)])).alias("tid"))
    starts = blocks.where(_change_of(F.col("tid"), F.col("client")) == F.col("tid")).select("client", "n", start_of(F.col("tid"), F.col("n")).alias("pos"))
    return starts.where("pos < n").select("client", "pos")


def exact_mean(value: Column) -> Column:
    """The mean of an aggregate's values, at least 0, to six decimals, half up. Losses of the stream have six decimals at most, so whole numbers of
    millionths are summed and divided: the mean doesn't depend on the order of the rows, and a tie is a tie."""
    n = F.count(value)
    return _div(2 * F.sum(F.round(value * 1_000_000).cast("long")) + n, 2 * n) / 1_000_000


def rounded(value: Column) -> Column:
    """A double to six decimals as DuckDB rounds it, by its millionfold: of 369 / 5760 = 0.0640625 that lies below the tie, while Spark's ``round`` rounds the
    shortest decimal."""
    return F.round(value * 1_000_000) / 1_000_000


def _div(a: Column, b: Column) -> Column:
    """Division of whole numbers, at least 0."""
    return F.round((a - a % b) / b).cast("long")


def exact_mean_sql(value: str, over: str = "") -> str:
    """:func:`exact_mean` in DuckDB's SQL."""
    n = f"count({value}) {over}"
    return f"((2 * sum(CAST(round(({value}) * 1000000) AS BIGINT)) {over} + {n}) // (2 * {n})) / 1000000"


#: The same in DuckDB's SQL, as the head of a query.
STREAM_SQL = f"""
WITH RECURSIVE dealt AS (
  SELECT user_id % (SELECT greatest({CLIENTS}, count(*) // {EVENTS_A_CLIENT}) FROM events) AS client, ts, event_id, event_type AS label, least(value / 200, 1.0) AS frac FROM events),
numbered AS (
  SELECT client, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY client) AS n, label, frac FROM dealt),
blocked AS (
  SELECT *, CASE WHEN pos < (n % {BLOCKS}) * (n // {BLOCKS} + 1) THEN pos // (n // {BLOCKS} + 1)
    ELSE n % {BLOCKS} + (pos - (n % {BLOCKS}) * (n // {BLOCKS} + 1)) // greatest(n // {BLOCKS}, 1) END AS tid FROM numbered),
conceived AS (SELECT *, ((tid + client) // 2) % 2 AS concept FROM blocked),
drifted AS (
  SELECT *, coalesce(concept <> lag(concept) OVER (PARTITION BY client ORDER BY pos), false) AS drift FROM conceived),
aligned AS (
  SELECT *, last_value(CASE WHEN drift THEN pos END IGNORE NULLS) OVER (PARTITION BY client ORDER BY pos) AS ld FROM drifted),
stream AS MATERIALIZED (
  SELECT *, CAST(frac < least(0.9, 0.2 + 0.03 * coalesce(pos - ld, 999)) AS INT) AS correct,
    CASE WHEN concept = 1 THEN 0.6 + 0.3 * frac ELSE 0.2 * frac END AS loss FROM aligned)
"""
