"""Generators, schedules, sweep plans, metrics and learning as queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import learning, matching
from ..operators.windows import latest
from ..sources import generators as gen
from ..sources import schedules
from ..sources.streams import STREAM_SQL, stream
from ..sources.tables import table
from . import metrics, sweep
from .catalog import query

_U = gen.uniform_sql


def _ids(spark, sf, n):
    """Rows 0.. of the orders, as many as there are, with concepts in turn."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % n).alias("concept"))


def _rounded(df):
    """The format rounds half up, and keeps the sign of what it rounds to zero."""
    return df.select("id", "concept", F.array_join(F.transform("x", lambda v: F.format_string("%.4f", v)), ",").alias("x"), "y")


def _x(*parts: str) -> str:
    return " || ',' || ".join(f"printf('%.4f', round({p}, 4))" for p in parts)


@query("src_2_threshold_samples", f"""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS concept, 10 * {_U('o_orderkey', 1)} AS a, 10 * {_U('o_orderkey', 2)} AS b, 10 * {_U('o_orderkey', 3)} AS c, {_U('o_orderkey', 4)} AS f FROM orders),
l AS (SELECT *, CASE WHEN a + b <= [9.0, 8.0, 7.0, 9.5][concept + 1] THEN 1.0 ELSE 0.0 END AS y FROM r) SELECT id, concept, {_x('a', 'b', 'c')} AS x, CAST(CASE WHEN f < 0.1 THEN 1 - y ELSE y END AS DOUBLE) AS y FROM l""")
def src_2(spark, sf):
    return _rounded(gen.samples(_ids(spark, sf, 4), "sea4"))


@query("src_3_circle_samples", f"""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 2 AS concept, {_U('o_orderkey', 1)} AS a, {_U('o_orderkey', 2)} AS b FROM orders)
SELECT id, concept, {_x('a', 'b')} AS x, CAST(CASE WHEN (a - [0.2, 0.6][concept + 1]) ** 2 + (b - 0.5) ** 2 - [0.15, 0.25][concept + 1] ** 2 > 0 THEN 1 ELSE 0 END AS DOUBLE) AS y FROM r""")
def src_3(spark, sf):
    return _rounded(gen.samples(_ids(spark, sf, 2), "circle2"))


@query("src_4_sine_samples", f"""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 2 AS concept, {_U('o_orderkey', 1)} AS a, {_U('o_orderkey', 2)} AS b FROM orders)
SELECT id, concept, {_x('a', 'b')} AS x, CAST(CASE WHEN (b <= sin(a)) = (concept = 0) THEN 1 ELSE 0 END AS DOUBLE) AS y FROM r""")
def src_4(spark, sf):
    return _rounded(gen.samples(_ids(spark, sf, 2), "sine2"))


def _normal_sql(i: str, salt: int) -> str:
    return f"(sqrt(-2 * ln(1 - {_U(i, salt)})) * cos({2 * math.pi!r} * ({_U(i, salt + 1)})))"


@query("src_1_blob_samples", f"""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS concept, CASE WHEN {_U('o_orderkey', 1)} < 0.5 THEN 0.0 ELSE 1.0 END AS y, {_normal_sql('o_orderkey', 2)} AS n, {2 * math.pi!r} * ({_U('o_orderkey', 4)}) AS theta,
  {_normal_sql('o_orderkey', 5)} AS u, {_normal_sql('o_orderkey', 7)} AS v FROM orders),
q AS (SELECT *, CASE WHEN (y = 0) = (concept = 0) THEN -2.0 ELSE 2.0 END AS side, CASE WHEN (y = 0) = (concept = 1) THEN 1.5 + 0.4 * n ELSE 4.5 + 0.5 * n END AS r FROM r),
p AS (SELECT *, CASE WHEN concept % 2 = 0 THEN side + 0.6 * u ELSE r * cos(theta) END AS a, CASE WHEN concept % 2 = 0 THEN side + 0.6 * v ELSE r * sin(theta) END AS b FROM q)
SELECT id, concept, {_x('a', 'b')} AS x, CAST(y AS DOUBLE) AS y FROM p""")
def src_1(spark, sf):
    return _rounded(gen.samples(_ids(spark, sf, 4), "blobs"))


@query("src_7_label_swap", "SELECT l_orderkey AS id, l_linenumber AS line, c AS concept, CASE WHEN c > 0 AND l_partkey % 10 = 2 * c - 1 THEN 2 * c WHEN c > 0 AND l_partkey % 10 = 2 * c THEN 2 * c - 1 ELSE l_partkey % 10 END AS label FROM (SELECT *, l_suppkey % 4 AS c FROM lineitem)")
def src_7(spark, sf):
    c = F.col("l_suppkey") % 4
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), c.alias("concept"), gen.swap_labels(F.col("l_partkey") % 10, c).alias("label"))


@query("src_8_bootstrap", f"""WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_suppkey FROM supplier), d AS (SELECT d AS draw, CAST(floor({_U('d', 1)} * (SELECT count(*) FROM supplier)) AS BIGINT) AS at_ FROM unnest(range(0, 5000)) AS t(d))
SELECT draw, s_suppkey AS id FROM d JOIN s ON i = at_""")
def src_8(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").alias("i"))  # keys are dense, from 0
    return gen.bootstrap(s, 5000, "i").select("draw", F.col("s_suppkey").alias("id"))


def _pattern_sql(concepts: int) -> str:
    rows = ", ".join(str(list(r)) for r in schedules.PATTERNS[concepts])
    return STREAM_SQL + f"SELECT client, pos, CAST([{rows}][CAST(tid AS INT) + 1][CAST(client % 10 AS INT) + 1] AS BIGINT) AS concept FROM stream"


@query("src_12_fixed_schedule_two", _pattern_sql(2))
def src_12(spark, sf):
    """The pattern over the positions of the stream's clients."""
    return schedules.fixed_over(stream(table(spark, sf, "events")), 2)


@query("src_12_fixed_schedule_four", _pattern_sql(4))
def src_12b(spark, sf):
    return schedules.fixed_over(stream(table(spark, sf, "events")), 4)


@query("src_11_random_schedule", STREAM_SQL + f""", drawn AS MATERIALIZED (SELECT client, pos, {_U('client * 1000003 + pos', 1)} AS chance, {_U('client * 1000003 + pos', 2)} AS choice FROM stream),
walk AS (SELECT client, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS concept, CAST(0 AS BIGINT) AS last FROM drawn WHERE pos = 0
UNION ALL SELECT client, pos, CASE WHEN moves THEN (concept + 1 + CAST(floor(choice * 3) AS BIGINT)) % 4 ELSE concept END, CASE WHEN moves THEN pos ELSE last END
FROM (SELECT d.client, d.pos, w.concept, w.last, choice, d.pos - w.last > 100 AND chance < 0.02 AS moves FROM walk w JOIN drawn d ON d.client = w.client AND d.pos = w.pos + 1))
SELECT client, pos, concept FROM walk WHERE pos >= 0""")
def src_11(spark, sf):
    """Random changes over the positions of the stream's clients."""
    rows = stream(table(spark, sf, "events")).where("client IS NOT NULL").select("client", "pos", (F.col("client") * 1000003 + F.col("pos")).alias("id"))
    return schedules.random_over(rows, 4, 100, 0.02)


@query("src_9_dispatch", f"""WITH r AS (SELECT event_type, event_id AS id, {_U('event_id', 1)} AS a, {_U('event_id', 2)} AS b, 10 * {_U('event_id', 1)} AS c, 10 * {_U('event_id', 2)} AS d, {_U('event_id', 4)} AS f FROM events)
SELECT event_type, 'circle2' AS dataset, CAST(count(*) FILTER (WHERE (a - 0.2) ** 2 + (b - 0.5) ** 2 > 0.15 ** 2) AS BIGINT) AS positive FROM r GROUP BY 1
UNION ALL SELECT event_type, 'sine2', CAST(count(*) FILTER (WHERE b <= sin(a)) AS BIGINT) FROM r GROUP BY 1
UNION ALL SELECT event_type, 'sea4', CAST(count(*) FILTER (WHERE (c + d <= 9) <> (f < 0.1)) AS BIGINT) FROM r GROUP BY 1""")
def src_9(spark, sf):
    """Generators by name over the events' ids: positive labels of each event type."""
    rows = table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"), F.lit(0).alias("concept"))
    part = lambda d: gen.samples(rows, d).groupBy("event_type").agg(F.sum("y").cast("long").alias("positive")).select("event_type", F.lit(d).alias("dataset"), "positive")
    return part("circle2").unionByName(part("sine2")).unionByName(part("sea4"))


@query("udf_5_sweep_plan", """WITH axes(family, parameter, v) AS (VALUES ('window', 'delta', [0.005, 0.01, 0.05, 0.1, 0.2]), ('window', 'interval', [20, 50, 100, 200]), ('stream', 'interval', [20, 50, 100, 200]), ('batch', 'batch', [25, 50, 100, 200]), ('batch', 'distance', [0.05, 0.1, 0.2, 0.3])),
modes(mode, family) AS (VALUES ('aw', 'window'), ('ha', 'stream'), ('fd', 'batch'), ('local', 'baseline')),
runs AS (SELECT mode, m.family, parameter, CAST(x AS DOUBLE) AS value FROM modes m JOIN (SELECT family, parameter, unnest(v) AS x FROM axes) a ON a.family = m.family UNION ALL SELECT mode, family, NULL, NULL FROM modes WHERE family = 'baseline'),
wanted AS (SELECT DISTINCT concat(CASE WHEN c_custkey % 4 = 0 THEN 'mnist' ELSE 'sine' END, c_nationkey) AS dataset, c_custkey AS seed FROM customer)
SELECT dataset, seed, mode, family, parameter, value, CAST(CASE WHEN family = 'batch' THEN 2 ELSE 1 END * CASE WHEN dataset LIKE 'mnist%' THEN 10 ELSE 1 END AS INT) AS cost FROM runs, wanted""")
def udf_5(spark, sf):
    """The runs of every dataset and seed of a table: here one of each customer's nation."""
    name = F.concat(F.when(F.col("c_custkey") % 4 == 0, "mnist").otherwise("sine"), F.col("c_nationkey").cast("string"))
    wanted = table(spark, sf, "customer").select(name.alias("dataset"), F.col("c_custkey").alias("seed")).distinct()
    return sweep.plan_of(wanted, {"aw": "window", "ha": "stream", "fd": "batch", "local": "baseline"}).drop("fingerprint")


@query("met_registry", STREAM_SQL + """SELECT client, round(avg(correct), 6) AS accuracy, round(avg(correct) FILTER (WHERE ld IS NULL OR pos >= ld + 50), 6) AS stable_accuracy,
round(coalesce(avg(correct) FILTER (WHERE pos < ld + 50), 0), 6) AS recovery_accuracy FROM stream GROUP BY client""")
def met_registry(spark, sf):
    """The registry's core profile over the stream's runs."""
    s = stream(table(spark, sf, "events")).withColumn("stable", matching.stable_mask(F.col("pos"), F.col("ld"), 50))
    out = metrics.compute({"sample": s}, ["client"], "core")
    return out.select("client", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("ml_1_client_models")
def ml_1(spark, sf):
    """A model for each client from its latest 200 samples: store-driven training. Samples are drawn by an id that holds the client's."""
    s = stream(table(spark, sf, "events")).where("client IS NOT NULL").select("client", "pos", "concept")
    samples = gen.samples(s.withColumn("id", F.col("pos") * 10 + F.col("client")), "sine2")
    store = latest(samples, ["client"], "pos", 200).withColumnRenamed("pos", "order")
    out = learning.train(store, ["client"], 2)
    return out.select("client", "n", F.round("loss", 4).alias("loss"), F.size("parameters").alias("parameters"))


@query("ml_6_gradient_projection", """WITH v AS (SELECT vec_id // 2 AS g, vec_id % 2 AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT a.g, a.i, a.e, b.e AS o, list_inner_product(a.e, b.e) AS d, list_inner_product(b.e, b.e) AS q FROM v a JOIN v b ON a.g = b.g AND a.i <> b.i),
c AS (SELECT g, i, CASE WHEN d < 0 AND q > 0 THEN list_transform(range(1, len(e) + 1), lambda k: e[k] - d / q * o[k]) ELSE e END AS e FROM p)
SELECT g, i, round(list_sum(list_transform(e, lambda x: x * x)), 5) AS square FROM c""")
def ml_6(spark, sf):
    """Updates of two whole vectors each, freed of their conflicts."""
    return _projected(table(spark, sf, "embeddings"))


def _projected(embeddings):
    v = embeddings.select(F.floor(F.col("vec_id") / 2).alias("g"), (F.col("vec_id") % 2).alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    groups = v.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias("vectors")).where(F.size("vectors") == 2)
    out = learning.project_conflicts(groups).select("g", F.posexplode("projected").alias("i", "e"))
    return out.select("g", F.col("i").cast("long").alias("i"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x), 5).alias("square"))
