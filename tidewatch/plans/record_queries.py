"""Records of models and runs: cutoffs and linkage, lineage, cached copies, snapshots, orders, and files written and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import clustering, lineage, matching, numbering, windows
from ..sources import files, published
from ..sources.scratch import fresh_place, written
from ..sources.streams import STREAM_SQL, stream
from ..sources.tables import table
from . import metrics
from .catalog import query
from .stream_queries import _MATCHED, TOLERANCE, _alarms, _truth
from .table_queries import _MATRIX, _WELCH, _matrix


def _s(spark, sf):
    return stream(table(spark, sf, "events"))


_CELLS = """c4 AS (SELECT greatest(a.total / a.n - d.total / d.n, b.total / b.n - c.total / c.n) AS distance, greatest({0}, {1}) AS score
FROM m a JOIN m b ON b.candidate = a.target AND b.target = a.candidate JOIN m c ON c.candidate = a.candidate AND c.target = a.candidate JOIN m d ON d.candidate = a.target AND d.target = a.target
WHERE a.candidate < a.target AND least(a.n, b.n, c.n, d.n) >= 5)""".format(_WELCH.format("a", "d"), _WELCH.format("b", "c"))


@query("clu_4_cutoffs", _MATRIX + f""", {_CELLS} SELECT 'distance' AS kind, 0.03 AS cut, count(*) FILTER (WHERE distance <= 0.03) AS linked, count(*) AS pairs FROM c4
UNION ALL SELECT 'confidence', round({clustering.cutoff('confidence')!r}, 6), count(*) FILTER (WHERE score <= {clustering.cutoff('confidence')!r}), count(*) FROM c4""")
def clu_4(spark, sf):
    """The pairs that each kind of cutoff links: a distance, or the quantile of a confidence."""
    m = _matrix(spark, sf)
    found = {"distance": (clustering.loss_distances(m), "distance", 0.03), "confidence": (clustering.standardized_distances(m), "score", None)}
    parts = []
    for kind, (pairs, score, distance) in found.items():
        cut = clustering.cutoff(kind, distance)
        parts.append(pairs.agg(F.lit(kind).alias("kind"), F.round(F.lit(cut), 6).alias("cut"), F.count(F.when(F.col(score) <= cut, 1)).alias("linked"), F.count("*").alias("pairs")))
    return parts[0].unionByName(parts[1])


def _models(spark, sf):
    """Models of rounds: twelve suppliers each, told apart by their balances."""
    return table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 12).alias("round"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("client"), "s_acctbal")


def _gaps(models):
    """Pairs of one round's models (at most twelve) with the distance of their balances."""
    a = models.select("round", F.col("id").alias("i"), F.col("s_acctbal").alias("x"))
    b = models.select("round", F.col("id").alias("j"), F.col("s_acctbal").alias("y"))
    return a.join(b, "round").where("i < j").select("round", "i", "j", F.abs(F.col("x") - F.col("y")).alias("distance"))


# In one dimension, single linkage joins neighbours in order whose gap is within the cut.
_SINGLE = """o AS (SELECT s_suppkey AS id, s_suppkey // 12 AS round, s_nationkey AS client, s_acctbal AS x, coalesce(s_acctbal - lag(s_acctbal) OVER w > 400, true) AS fresh, row_number() OVER w AS r FROM supplier WINDOW w AS (PARTITION BY s_suppkey // 12 ORDER BY s_acctbal, s_suppkey)),
g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY round ORDER BY r) AS run FROM o),
c AS (SELECT *, min(id) OVER (PARTITION BY round, run) AS cluster FROM g)"""


@query("clu_7_single_linkage", f"WITH {_SINGLE} SELECT round, id, cluster FROM c")
def clu_7(spark, sf):
    models = _models(spark, sf)
    return clustering.cluster(_gaps(models), models, ["round"], 400.0, "single")


@query("clu_15_lineage", f"""WITH {_SINGLE}, n AS (SELECT a.id, min({{'d': abs(a.x - b.x), 'j': b.id}}) AS m FROM o a JOIN o b ON a.round = b.round AND a.id <> b.id GROUP BY a.id)
SELECT c.id, round, client, coalesce(m.j, -1) AS nearest, round(m.d, 2) AS distance, cluster AS representative, cluster <> c.id AS absorbed FROM c LEFT JOIN n ON n.id = c.id""")
def clu_15(spark, sf):
    """What a round's clustering leaves on record of each model: registration, nearest other, representative, and whether it was absorbed."""
    models = _models(spark, sf)
    gaps = _gaps(models)
    near = clustering.nearest(gaps, models).select("id", "nearest", F.round("distance", 2).alias("distance"))
    of = clustering.cluster(gaps, models, ["round"], 400.0, "single").select("id", F.col("cluster").alias("representative"))
    return models.select("id", "round", "client").join(near, "id").join(of, "id").withColumn("absorbed", F.col("representative") != F.col("id"))


# Models (customers with orders) of a month, in groups of fifty by id; some pairs of a group are never evaluated.
_ROUNDS = """WITH RECURSIVE m AS MATERIALIZED (SELECT 12 * year(o_orderdate) + month(o_orderdate) AS round, o_custkey AS model, o_custkey // 50 AS part, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS x FROM orders GROUP BY ALL),
p AS MATERIALIZED (SELECT a.round, a.model AS i, b.model AS j, CAST(abs(a.x - b.x) AS BIGINT) AS distance FROM m a JOIN m b ON a.round = b.round AND a.part = b.part AND a.model < b.model WHERE (a.model + b.model) % 3 <> 0),
e AS MATERIALIZED (SELECT round, i, j FROM p WHERE distance <= 3000000 UNION ALL SELECT round, j, i FROM p WHERE distance <= 3000000),
reach AS (SELECT round, model, model AS other FROM m UNION SELECT r.round, r.model, e.j FROM reach r JOIN e ON e.round = r.round AND e.i = r.other),
c AS MATERIALIZED (SELECT round, model, min(other) AS representative FROM reach GROUP BY ALL)"""


def _rounds(spark, sf):
    """Models, evaluated pairs and clusters of each month."""
    month = 12 * F.year("o_orderdate") + F.month("o_orderdate")
    m = table(spark, sf, "orders").groupBy(month.alias("round"), F.col("o_custkey").alias("model")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("x"))
    m = written(m.withColumn("part", F.floor(F.col("model") / 50)), "models")
    a, b = (m.select("round", "part", F.col("model").alias(c), F.col("x").alias(f"x{c}")) for c in "ij")
    pairs = a.join(b, ["round", "part"]).where("i < j AND (i + j) % 3 <> 0").select("round", "i", "j", F.abs(F.col("xi") - F.col("xj")).alias("distance"))
    pairs = written(pairs, "model-pairs")
    node = lambda c: F.col("round").cast("long") * (1 << 40) + F.col(c)
    nodes = m.select(node("model").alias("id"), "round", "model")
    found = clustering.connected(pairs.select(node("i").alias("i"), node("j").alias("j"), "distance"), nodes.select("id"), 3_000_000)
    clusters = nodes.join(found, "id").select("round", "model", (F.col("component") % (1 << 40)).alias("representative"))
    return m, pairs, written(clusters, "model-clusters")


@query("clu_15_observations", _ROUNDS + """, sides AS (SELECT round, i AS model, j AS other, distance FROM p UNION ALL SELECT round, j, i, distance FROM p),
near AS (SELECT round, model, arg_min(other, (distance, other)) AS nearest, min(distance) AS distance FROM sides GROUP BY ALL),
inside AS (SELECT p.round, a.representative, max(distance) AS widest, count(*) AS evaluated FROM p JOIN c a ON a.round = p.round AND a.model = p.i JOIN c b ON b.round = p.round AND b.model = p.j WHERE a.representative = b.representative GROUP BY ALL),
sized AS (SELECT round, representative, count(*) AS size FROM c GROUP BY ALL)
SELECT c.round, c.model, coalesce(nearest, -1) AS nearest, near.distance, c.representative, size, widest, coalesce(evaluated, 0) AS evaluated, size * (size - 1) // 2 AS possible, c.model <> c.representative AS absorbed
FROM c JOIN sized s ON s.round = c.round AND s.representative = c.representative LEFT JOIN inside i ON i.round = c.round AND i.representative = c.representative LEFT JOIN near ON near.round = c.round AND near.model = c.model""")
def clu_15_observations(spark, sf):
    """What every month's clustering records of each model."""
    return lineage.observations(*_rounds(spark, sf))


@query("clu_15_ancestry", _ROUNDS + """, absorbed AS MATERIALIZED (SELECT * FROM c WHERE model <> representative),
line AS (SELECT round, model, representative AS ancestor, round AS last, 1 AS steps FROM absorbed
UNION ALL SELECT l.round, l.model, a.representative, a.round, l.steps + 1 FROM line l JOIN absorbed a ON a.model = l.ancestor AND a.round > l.last
  WHERE a.round = (SELECT min(b.round) FROM absorbed b WHERE b.model = l.ancestor AND b.round > l.last))
SELECT round, model, arg_max(ancestor, steps) AS ancestor, max(last) AS last, max(steps) AS steps FROM line GROUP BY round, model""")
def clu_15_ancestry(spark, sf):
    """Who stands in the end for each model that a month's clustering absorbed: its representative, whoever absorbed that in a later month, and so on."""
    return lineage.ancestry(_rounds(spark, sf)[2].where("model <> representative"))


# Stored orders by year; two deliveries fill blanks and add orders, a third contradicts one.
_PARTS = {
    "stored": "o_orderkey % 5 < 3", "first": "o_orderkey % 5 IN (2, 3)", "second": "o_orderkey % 5 IN (0, 4)",
}
_VALUES = {
    "stored": ("CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END", "CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END"),
    "first": ("CASE WHEN o_orderkey % 2 > 0 THEN o_totalprice END", "o_orderpriority"),
    "second": ("o_totalprice", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END"),
}


@query("snk_8_published_upserts", "WITH " + ", ".join(f"{n} AS (SELECT year(o_orderdate) AS y, o_orderkey AS k, {v} AS price, {w} AS priority FROM orders WHERE {_PARTS[n]})" for n, (v, w) in _VALUES.items()) + """
SELECT y, k, coalesce(s.price, f.price, t.price) AS price, coalesce(s.priority, f.priority, t.priority) AS priority FROM stored s FULL JOIN first f USING (y, k) FULL JOIN second t USING (y, k)""")
def snk_8_published(spark, sf):
    """SNK-8, SNK-9: a stored table is extended twice in place and read back; a delivery that contradicts it leaves it as it was."""
    o, path = table(spark, sf, "orders"), fresh_place(spark, "published")
    parts = {n: o.where(_PARTS[n]).select(F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("k"), F.expr(v).alias("price"), F.expr(w).alias("priority")) for n, (v, w) in _VALUES.items()}
    schema = parts["stored"].schema
    published.store(parts["stored"], path, "y")
    for name in ("first", "second"):
        published.extend(spark, path, parts[name], ["y", "k"], "y", schema)
    try:
        published.extend(spark, path, parts["second"].withColumn("price", F.col("price") + 1), ["y", "k"], "y", schema)
    except published.NotPublished:
        return published.read(spark, path, schema)
    raise AssertionError("a contradiction was published")


@query("lif_16_registrations", "SELECT o_custkey AS model, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS client, min(o_orderdate) AS registered, count(*) AS seen FROM orders GROUP BY o_custkey")
def lif_16(spark, sf):
    """Of repeated registrations of a model the first stands."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("model")).agg(F.min_by("o_orderpriority", at).alias("client"), F.min("o_orderdate").alias("registered"), F.count("*").alias("seen"))


@query("lif_15_snapshots", STREAM_SQL + """, r AS (SELECT client, pos // 50 AS round, count(*) AS n, sum(correct) AS c FROM stream GROUP BY ALL)
SELECT client, round, CAST(sum(n) OVER w AS BIGINT) AS samples, CAST(sum(c) OVER w AS BIGINT) AS correct, CAST(n AS BIGINT) AS new_samples FROM r WINDOW w AS (PARTITION BY client ORDER BY round)""")
def lif_15(spark, sf):
    """Counters as they stand at each round's end, and what the round added."""
    r = _s(spark, sf).groupBy("client", F.floor(F.col("pos") / 50).alias("round")).agg(F.count("*").alias("n"), F.sum("correct").alias("c"))
    w = Window.partitionBy("client").orderBy("round")
    held = r.select("client", "round", F.sum("n").over(w).alias("samples"), F.sum("c").over(w).alias("correct"), F.sum("n").over(w).alias("new_samples"))
    return windows.previous_difference(held, "client", "round", ["new_samples"])


@query("clu_14_cached_evaluation", STREAM_SQL + """, r AS (SELECT client, pos // 50 AS round, loss FROM stream WHERE pos // 50 < n // 50),
p AS (SELECT round + 1 AS round, avg(loss) AS cached FROM r GROUP BY 1)
SELECT client, round, count(*) AS n, round(avg(abs(loss - cached)), 6) AS error FROM r JOIN p USING (round) GROUP BY ALL""")
def clu_14(spark, sf):
    """Each client's samples against the parameter that the round before distributed; nothing was distributed before the first round."""
    own = windows.rounds(_s(spark, sf), "pos", "n", 50).select("client", "round", "loss")
    sent = agg.merge_statistics(own.groupBy("round", "client").agg(F.count("*").alias("n"), F.avg("loss").alias("mean")), ["round"])
    cached = sent.select((F.col("round") + 1).alias("round"), F.col("mean").alias("cached"))
    return own.join(cached, "round").groupBy("client", "round").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("loss") - F.col("cached"))), 6).alias("error"))


@query("win_10_durations", _MATCHED + """SELECT client, true_pos, pos, pos - true_pos AS delay, (pos // 50 + 1) * 50 - pos AS resolution_delay FROM matched""")
def win_10(spark, sf):
    """From change to alarm, and from alarm to the round's end that resolves it."""
    m = matching.match_events(_truth(spark, sf), _alarms(_s(spark, sf)), TOLERANCE).where("true_pos IS NOT NULL")
    return m.select("client", "true_pos", "pos", "delay", ((F.floor(F.col("pos") / 50) + 1) * 50 - F.col("pos")).alias("resolution_delay"))


@query("srt_3_baseline_order", "SELECT o_orderstatus AS schedule, o_orderkey AS run, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey % 5, o_orderpriority, o_totalprice, o_orderkey) AS place FROM orders")
def srt_3(spark, sf):
    """Within a schedule by seed, parameter and value."""
    o = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_custkey") % 5).alias("seed"), "o_orderpriority", "o_totalprice", "o_orderkey")
    o = numbering.numbered(o, ["seed", "o_orderpriority", "o_totalprice", "o_orderkey"], "place", ["o_orderstatus"])
    return o.select(F.col("o_orderstatus").alias("schedule"), F.col("o_orderkey").alias("run"), "place")


@query("prj_1_canonical_header", "SELECT 1 AS version, o_orderstatus AS mode, 'fixed' AS schedule, o_custkey AS seed, 'price' AS sweep_parameter, o_totalprice AS sweep_value FROM orders")
def prj_1(spark, sf):
    """Columns that no one reads go, missing ones come in at their places."""
    rows = table(spark, sf, "orders").withColumnsRenamed({"o_orderstatus": "mode", "o_custkey": "seed", "o_totalprice": "sweep_value"})
    return files.canonical(rows, {"version": F.lit(1), "schedule": F.lit("fixed"), "sweep_parameter": F.lit("price")}, ["version", "mode", "schedule", "seed", "sweep_parameter", "sweep_value"])


_RESULT = "o_orderstatus AS mode, 'd' || o_custkey % 3 AS dataset, o_custkey % 2 AS seed, round(o_totalprice / 1000, 3) AS accuracy"


@query("snk_1_results_and_back", f"SELECT dataset, mode, count(*) AS n, round(sum(accuracy), 3) AS accuracy, CAST(sum(seed) AS BIGINT) AS seeds FROM (SELECT {_RESULT} FROM orders) GROUP BY ALL")
def snk_1(spark, sf):
    """SNK-1, SRC-15, SRC-16: result rows as CSV with the fixed header, read back and checked."""
    path = fresh_place(spark, "results")
    rows = table(spark, sf, "orders").selectExpr("1 AS version", "o_orderstatus AS mode", "concat('d', o_custkey % 3) AS dataset", "'fixed' AS schedule", "cast(o_custkey % 2 AS int) AS seed", "'s' AS series", "'p' AS sweep_parameter", "0.5D AS sweep_value", "1D AS batch", "2D AS distance", "round(o_totalprice / 1000, 3) AS accuracy")
    files.write_results(rows, path)
    back = files.read_results(spark, [path], modes=["F", "O", "P"])
    return back.groupBy("dataset", "mode").agg(F.count("*").alias("n"), F.round(F.sum("accuracy"), 3).alias("accuracy"), F.sum("seed").alias("seeds"))


@query("snk_2_runs_and_back", "SELECT l_returnflag AS run, l_linenumber AS line, count(*) AS n, round(sum(l_quantity), 3) AS quantity FROM lineitem GROUP BY ALL")
def snk_2(spark, sf):
    """SNK-2, SRC-17, SRC-20: raw rows in folders by run, read back with the folders' values as columns."""
    path = fresh_place(spark, "runs")
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("line"), "l_orderkey", "l_quantity")
    files.write_runs(rows, path, ["run"])
    return spark.read.parquet(path).groupBy("run", "line").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("quantity"))


@query("snk_7_baseline", "SELECT o_orderstatus AS dataset, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def snk_7(spark, sf):
    """A baseline's rows, sorted within each dataset's folder, counted again after writing."""
    rows = table(spark, sf, "orders").where("o_totalprice > 1000").select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("value"))
    back = files.write_baseline(rows, fresh_place(spark, "baseline"), "dataset", ["run"])
    return back.groupBy("dataset").agg(F.count("*").alias("n"), F.min("run").alias("first"), F.max("run").alias("last"))


@query("src_19_source_list", "SELECT source AS root, lang AS dataset, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def src_19(spark, sf):
    """A list of sources with their datasets as JSON, read back and joined with the rows that it names."""
    path = fresh_place(spark, "sources")
    docs = table(spark, sf, "documents").select(F.col("source").alias("root"), F.col("lang").alias("dataset")).dropna()
    docs.groupBy("root").agg(F.sort_array(F.collect_set("dataset")).alias("datasets")).write.json(path)
    listed = files.read_sources(spark, path)
    return docs.groupBy("root", "dataset").agg(F.count("*").alias("n")).join(listed, ["root", "dataset"]).select("root", "dataset", "n")


@query("met_detection_profile", _MATCHED + f""", free AS (SELECT * FROM alarms ANTI JOIN matched USING (client, pos)),
ranked AS (SELECT f.client, f.pos, min(CASE WHEN f.pos - t.pos BETWEEN 0 AND {TOLERANCE} THEN 1 WHEN f.pos - t.pos BETWEEN -{TOLERANCE} AND -1 THEN 2
WHEN f.pos - t.pos BETWEEN {TOLERANCE} + 1 AND 2 * {TOLERANCE} THEN 3 ELSE 4 END) AS r FROM free f LEFT JOIN truth t USING (client) GROUP BY ALL),
s AS (SELECT client, avg(correct) AS accuracy, avg(correct) FILTER (WHERE ld IS NULL OR pos >= ld + 50) AS stable_accuracy, coalesce(avg(correct) FILTER (WHERE pos < ld + 50), 0) AS recovery_accuracy FROM stream GROUP BY client),
a AS (SELECT client, count(*) AS n, count(true_pos) AS k, avg(a.pos - a.pos % 13 - true_pos) AS bias, avg(abs(a.pos - a.pos % 13 - true_pos)) AS mae FROM alarms a LEFT JOIN matched m USING (client, pos) GROUP BY client),
u AS (SELECT client, {', '.join(f"CAST(sum(CAST(r = {i} AS INT)) AS BIGINT) AS {k}_fp_count" for i, k in enumerate(('duplicate', 'early', 'late', 'isolated'), 1))} FROM ranked GROUP BY client)
SELECT client, round(accuracy, 6) AS accuracy, round(stable_accuracy, 6) AS stable_accuracy, round(recovery_accuracy, 6) AS recovery_accuracy, n AS alarm_count, k AS alarm_matched, round(k / n, 6) AS alarm_matched_share,
k AS change_point_count, round(CASE WHEN n IS NOT NULL THEN coalesce(mae, 0) END, 6) AS change_point_mae, round(CASE WHEN n IS NOT NULL THEN coalesce(bias, 0) END, 6) AS change_point_bias, duplicate_fp_count, early_fp_count, late_fp_count, isolated_fp_count
FROM s LEFT JOIN a USING (client) LEFT JOIN u USING (client)""")
def met_detection_profile(spark, sf):
    """The registry's detection profile: quality, alarms, change points and false alarms by class, a row for each client."""
    s, truth = _s(spark, sf), _truth(spark, sf)
    events = matching.match_events(truth, _alarms(s), TOLERANCE).where("kind = 'event' AND client IS NOT NULL")
    tables = {
        "sample": s.withColumn("stable", matching.stable_mask(F.col("pos"), F.col("ld"), 50)),
        "alarm": events.withColumn("estimate", F.col("pos") - F.col("pos") % 13),
        "unmatched": matching.classify_unmatched(events.where("true_pos IS NULL").select("client", "pos"), truth, TOLERANCE),
    }
    return _six(metrics.compute(tables, ["client"], "detection"))


def _six(found):
    """Ratios and means to six decimals."""
    kinds = dict(found.dtypes)
    return found.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in found.columns])


@query("met_resource_profile", STREAM_SQL + """, r AS (SELECT client, pos // 50 AS round, count(*) AS n, count(DISTINCT concept) AS models, sum(frac) AS seconds FROM stream GROUP BY ALL)
SELECT client, 2 * count(*) AS comm_messages, count(*) AS comm_up, count(*) AS comm_down, CAST(sum(4 * 3 * n) AS BIGINT) AS comm_bytes, CAST(sum((n + 19) // 20) AS BIGINT) AS compute_calls, CAST(sum(n) AS BIGINT) AS compute_examples,
round(sum(seconds), 6) AS seconds_total, round(max(seconds), 6) AS seconds_max, round(avg(models), 6) AS model_count_mean, max(models) AS model_count_max, CAST(sum(models) AS BIGINT) AS model_count_auc FROM r GROUP BY client""")
def met_resource_profile(spark, sf):
    """The registry's resource profile over rounds (updates every twenty samples, seconds from the samples) and transfers (values up, twice
    as many down)."""
    n = F.count("*")
    rounds = _s(spark, sf).groupBy("client", F.floor(F.col("pos") / 50).alias("round")).agg(
        n.alias("examples"), F.ceil(n / 20).alias("calls"), F.sum("frac").alias("seconds"), F.countDistinct("concept").alias("models")
    )
    ways = F.explode(F.array(F.struct(F.lit("up").alias("direction"), F.col("examples").alias("values")), F.struct(F.lit("down").alias("direction"), (2 * F.col("examples")).alias("values"))))
    return _six(metrics.compute({"round": rounds, "transfer": rounds.select("client", ways.alias("t")).select("client", "t.*")}, ["client"], "resource"))
