"""Queries over the star tables: cross-evaluation matrices, consolidation, weighted averages, upserts, orders, sets, labels, fingerprints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions import text as tx
from ..operators import aggregates as agg
from ..operators import clustering, matching, numbering
from ..sources.tables import table
from .catalog import query

# Cross-evaluation: candidate and target models are months of shipping modulo 6 and 5 return/status pairs.
_MATRIX = """WITH e AS (SELECT l_suppkey % 6 AS candidate, l_partkey % 6 AS target, l_discount * 5 + (CASE WHEN l_suppkey % 6 = l_partkey % 6 THEN 0 ELSE (l_suppkey % 6) * 0.01 END) AS loss FROM lineitem),
m AS (SELECT candidate, target, count(*) AS n, sum(loss) AS total, sum(loss * loss) AS squares FROM e GROUP BY ALL)"""


def _losses(spark, sf):
    c, t = F.col("l_suppkey") % 6, F.col("l_partkey") % 6
    return table(spark, sf, "lineitem").select(c.alias("candidate"), t.alias("target"), (F.col("l_discount") * 5 + F.when(c == t, 0).otherwise(c * 0.01)).alias("loss"))


def _matrix(spark, sf):
    return agg.sufficient(_losses(spark, sf), ["candidate", "target"], F.col("loss"))


@query("agg_2_sufficient_statistics", _MATRIX + "SELECT candidate, target, n, round(total, 4) AS total, round(squares, 4) AS squares FROM m")
def agg_2(spark, sf):
    return _matrix(spark, sf).select("candidate", "target", "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"))


@query("agg_3_paired_differences", """SELECT l_returnflag AS g, count(*) AS n, round(sum(l_discount - l_tax), 4) AS total, round(sum((l_discount - l_tax) ** 2), 4) AS squares FROM lineitem GROUP BY 1""")
def agg_3(spark, sf):
    out = agg.sufficient(table(spark, sf, "lineitem"), ["l_returnflag"], F.col("l_discount") - F.col("l_tax"))
    return out.select(F.col("l_returnflag").alias("g"), "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"))


@query("jn_6_cross_evaluation", """WITH held AS (SELECT DISTINCT l_suppkey % 20 AS holder, l_partkey % 6 AS target FROM lineitem),
picked AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY target ORDER BY (holder * 7919 + target * 104729) % 1009, holder) <= 3)
SELECT c AS candidate, target, holder FROM picked, unnest(range(0, 6)) AS t(c)""")
def jn_6(spark, sf):
    """Every model on up to three holders of every target, in a fixed pseudo-random order."""
    held = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("holder"), (F.col("l_partkey") % 6).alias("target")).distinct()
    w = Window.partitionBy("target").orderBy((F.col("holder") * 7919 + F.col("target") * 104729) % 1009, "holder")
    picked = held.withColumn("r", F.row_number().over(w)).where("r <= 3")
    return picked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("candidate"), "target", "holder")


@query("jn_7_held_models", "SELECT DISTINCT m FROM (SELECT l_suppkey % 7 AS m FROM lineitem UNION ALL SELECT s_suppkey % 11 FROM supplier UNION ALL SELECT o_custkey % 3 FROM orders)")
def jn_7(spark, sf):
    parts = [table(spark, sf, t).select((F.col(c) % k).alias("m")) for t, c, k in (("lineitem", "l_suppkey", 7), ("supplier", "s_suppkey", 11), ("orders", "o_custkey", 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("jn_8_symmetric_pairs", _MATRIX + ", p AS (SELECT least(candidate, target) AS low, greatest(candidate, target) AS high, n, total FROM m WHERE candidate <> target) SELECT low, high, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 4) AS total FROM p GROUP BY ALL")
def jn_8(spark, sf):
    return matching.pair_sums(_matrix(spark, sf), "candidate", "target", ["n", "total"]).withColumn("total", F.round("total", 4))


@query("clu_1_loss_distances", _MATRIX + """SELECT a.candidate AS i, a.target AS j, round(greatest(a.total / a.n - d.total / d.n, b.total / b.n - c.total / c.n), 6) AS distance
FROM m a JOIN m b ON b.candidate = a.target AND b.target = a.candidate JOIN m c ON c.candidate = a.candidate AND c.target = a.candidate JOIN m d ON d.candidate = a.target AND d.target = a.target
WHERE a.candidate < a.target AND least(a.n, b.n, c.n, d.n) >= 5""")
def clu_1(spark, sf):
    return clustering.loss_distances(_matrix(spark, sf)).withColumn("distance", F.round("distance", 6))


_WELCH = """(({0}.total / {0}.n - {1}.total / {1}.n) / sqrt(greatest(({0}.squares - {0}.total * {0}.total / {0}.n) / ({0}.n - 1), 0) / {0}.n + greatest(({1}.squares - {1}.total * {1}.total / {1}.n) / ({1}.n - 1), 0) / {1}.n))"""


@query("clu_2_standardized_increase", _MATRIX + f"""SELECT a.candidate AS i, a.target AS j, round(greatest({_WELCH.format('a', 'd')}, {_WELCH.format('b', 'c')}), 5) AS score
FROM m a JOIN m b ON b.candidate = a.target AND b.target = a.candidate JOIN m c ON c.candidate = a.candidate AND c.target = a.candidate JOIN m d ON d.candidate = a.target AND d.target = a.target
WHERE a.candidate < a.target""")
def clu_2(spark, sf):
    return clustering.standardized_distances(_matrix(spark, sf)).withColumn("score", F.round("score", 5))


@query("clu_3_paired_upper_bound", f"""SELECT l_suppkey % 10 AS g, count(*) AS n, round(avg(l_discount - l_tax) + {st.quantile(0.95)!r} * sqrt(greatest((sum((l_discount - l_tax) ** 2) - sum(l_discount - l_tax) ** 2 / count(*)) / (count(*) - 1), 0) / count(*)), 6) AS bound
FROM lineitem GROUP BY 1""")
def clu_3(spark, sf):
    found = agg.sufficient(table(spark, sf, "lineitem").withColumn("g", F.col("l_suppkey") % 10), ["g"], F.col("l_discount") - F.col("l_tax"))
    return found.select("g", "n", F.round(st.upper_bound(F.col("n"), F.col("total"), F.col("squares")), 6).alias("bound"))


def _edges(spark, sf):
    """Customers linked to others of near account balance in their nation: a graph with chains."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_custkey")
    c = numbering.with_previous(c, ["c_acctbal", "c_custkey"], {"c_custkey": "i", "c_acctbal": "b"}, ["c_nationkey"])
    return c.where("i IS NOT NULL").select("i", F.col("c_custkey").alias("j"), (F.col("c_acctbal") - F.col("b")).alias("distance"))


_EDGES = """WITH e AS (SELECT lag(c_custkey) OVER w AS i, c_custkey AS j, c_acctbal - lag(c_acctbal) OVER w AS distance, c_nationkey AS k FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey))"""


@query("clu_5_connected_components", """WITH o AS (SELECT c_custkey AS id, c_nationkey AS k, coalesce(c_acctbal - lag(c_acctbal) OVER w > 150, true) AS fresh, row_number() OVER w AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)),
g AS (SELECT id, k, sum(CAST(fresh AS INT)) OVER (PARTITION BY k ORDER BY r) AS run FROM o)
SELECT id, min(id) OVER (PARTITION BY k, run) AS component FROM g""")
def clu_5(spark, sf):
    """The graph is chains, so SQL finds its components as runs."""
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return clustering.connected(_edges(spark, sf), nodes, 150.0)


_LINKAGE = """WITH RECURSIVE s AS (SELECT s_suppkey // 12 AS round, s_suppkey AS id, s_acctbal AS x FROM supplier),
dist AS MATERIALIZED (SELECT a.round, a.id AS i, b.id AS j, abs(a.x - b.x) AS d FROM s a JOIN s b ON a.round = b.round AND a.id <> b.id),
walk AS (
SELECT round, list(DISTINCT [id]) AS clusters, true AS going FROM s GROUP BY round
UNION ALL
SELECT round, CASE WHEN best IS NULL THEN clusters ELSE list_append(list_filter(clusters, lambda c: c[1] <> best.a AND c[1] <> best.b), list_sort(list_concat(list_filter(clusters, lambda c: c[1] = best.a)[1], list_filter(clusters, lambda c: c[1] = best.b)[1]))) END, best IS NOT NULL
FROM (SELECT round, any_value(clusters) AS clusters, min({'d': d, 'a': a, 'b': b}) FILTER (WHERE d <= 800 AND n = size) AS best
 FROM (SELECT w.round, any_value(w.clusters) AS clusters, p.a[1] AS a, q.b[1] AS b, len(any_value(p.a)) * len(any_value(q.b)) AS size, max(dist.d) AS d, count(dist.d) AS n
  FROM walk w, unnest(w.clusters) AS p(a), unnest(w.clusters) AS q(b) LEFT JOIN dist ON dist.round = w.round AND list_contains(p.a, dist.i) AND list_contains(q.b, dist.j) WHERE w.going AND (p.a[1] < q.b[1] OR len(w.clusters) = 1) GROUP BY w.round, p.a[1], q.b[1])
 GROUP BY round))
SELECT round, id, c[1] AS cluster FROM (SELECT round, unnest(clusters) AS c FROM walk WHERE NOT going), unnest(c) AS t(id)"""


@query("clu_6_complete_linkage", _LINKAGE)
def clu_6(spark, sf):
    """Models of each round (here: twelve suppliers) by complete linkage of account balance gaps."""
    s = table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 12).alias("round"), F.col("s_suppkey").alias("id"), "s_acctbal")
    a = s.select("round", F.col("id").alias("i"), F.col("s_acctbal").alias("x"))
    b = s.select("round", F.col("id").alias("j"), F.col("s_acctbal").alias("y"))
    edges = a.join(b, "round").where("i < j").select("round", "i", "j", F.abs(F.col("x") - F.col("y")).alias("distance"))
    return clustering.complete_linkage(edges, s, ["round"], 800.0)


@query("clu_6_reciprocal_merges", _LINKAGE)
def clu_6_merges(spark, sf):
    """The same by rounds of joins over all models, however many a round has."""
    s = table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 12).alias("round"), F.col("s_suppkey").alias("id"), "s_acctbal")
    a = s.select("round", F.col("id").alias("i"), F.col("s_acctbal").alias("x"))
    b = s.select("round", F.col("id").alias("j"), F.col("s_acctbal").alias("y"))
    edges = a.join(b, "round").where("i < j").select("round", "i", "j", F.abs(F.col("x") - F.col("y")).alias("distance"))
    return clustering.reciprocal_linkage(edges, s, ["round"], 800.0)


@query("clu_8_merge_representatives", """WITH m AS (SELECT l_suppkey % 9 AS id, (l_suppkey % 9) % 4 AS cluster, count(*) AS n, avg(l_discount) AS mean FROM lineitem GROUP BY ALL)
SELECT min(id) AS representative, count(*) AS members, CAST(sum(n) AS BIGINT) AS n, round(sum(mean * n) / sum(n), 6) AS mean FROM m GROUP BY cluster""")
def clu_8(spark, sf):
    """Destructive merge: smallest id stands for the cluster with the weighted mean; AGG-6."""
    m = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 9).alias("id")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean")).withColumn("cluster", F.col("id") % 4)
    merged = agg.merge_statistics(m, ["cluster"])
    return m.groupBy("cluster").agg(F.min("id").alias("representative"), F.count("*").alias("members")).join(merged, "cluster").select("representative", "members", "n", F.round("mean", 6).alias("mean"))


@query("clu_9_shared_parameters", """WITH m AS (SELECT l_suppkey % 9 AS id, (l_suppkey % 9) % 4 AS cluster, count(*) AS n, avg(l_discount) AS mean FROM lineitem GROUP BY ALL)
SELECT id, n, round(sum(mean * n) OVER (PARTITION BY cluster) / sum(n) OVER (PARTITION BY cluster), 6) AS mean FROM m""")
def clu_9(spark, sf):
    """All members take the average; ids and statistics stay."""
    m = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 9).alias("id")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean")).withColumn("cluster", F.col("id") % 4)
    return m.drop("mean").join(agg.merge_statistics(m, ["cluster"]).select("cluster", "mean"), "cluster").select("id", "n", F.round("mean", 6).alias("mean"))


@query("clu_10_noninferiority_gate", f"""WITH d AS (SELECT l_suppkey % 10 AS id, count(*) AS n, sum(l_discount - l_tax) AS t, sum((l_discount - l_tax) ** 2) AS q FROM lineitem GROUP BY 1),
b AS (SELECT id, id % 4 AS cluster, n >= 5 AND t / n + {st.quantile(0.95)!r} * sqrt(greatest((q - t * t / n) / (n - 1), 0) / n) <= 0.0115 AS fine FROM d),
v AS (SELECT cluster, bool_and(fine) AS kept FROM b GROUP BY cluster)
SELECT id, CASE WHEN kept THEN b.cluster ELSE id END AS cluster, kept FROM b JOIN v USING (cluster)""")
def clu_10(spark, sf):
    d = agg.sufficient(table(spark, sf, "lineitem").withColumn("id", F.col("l_suppkey") % 10), ["id"], F.col("l_discount") - F.col("l_tax"))
    return clustering.gate(d, d.select("id", (F.col("id") % 4).alias("cluster")), 0.0115)


@query("clu_12_policy_and_maturity", """WITH c AS (SELECT s_suppkey % 10 AS round, count(*) FILTER (WHERE s_acctbal > 9000) AS new, count(*) AS n FROM supplier GROUP BY 1)
SELECT round, new AS new_models, new > 0 AS on_new_model, true AS every_round, false AS disabled, CAST(coalesce(sum(n) OVER (ORDER BY round RANGE BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING), 0) AS BIGINT) AS mature FROM c""")
def clu_12(spark, sf):
    """CLU-12 and RND-6: of each of ten rounds, whether clustering is due by each policy, and the models that have been isolated for three rounds."""
    new = F.count(F.when(F.col("s_acctbal") > 9000, 1))
    rounds = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 10).alias("round")).agg(new.alias("new_models"), F.count("*").alias("n"))
    created = rounds.select(F.col("round").alias("created"), F.col("n").alias("models"))
    old = rounds.join(F.broadcast(created), clustering.mature(F.col("round"), F.col("created"), 3), "left").groupBy("round").agg(F.coalesce(F.sum("models"), F.lit(0)).alias("mature"))
    due = {p: clustering.due(p, F.col("new_models") > 0) for p in ("on_new_model", "every_round", "disabled")}
    return rounds.select("round", "new_models", *(c.alias(p) for p, c in due.items())).join(old, "round")


@query("srt_8_nearest_neighbour", _EDGES + """, u AS (SELECT i AS id, j AS other, distance FROM e WHERE i IS NOT NULL AND distance <= 60 UNION ALL SELECT j, i, distance FROM e WHERE i IS NOT NULL AND distance <= 60)
SELECT c_custkey AS id, coalesce(arg_min(other, (distance, other)), -1) AS nearest, round(min(distance), 6) AS distance, count(other) AS evaluated FROM customer LEFT JOIN u ON id = c_custkey GROUP BY c_custkey""")
def srt_8(spark, sf):
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return clustering.nearest(_edges(spark, sf).where("distance <= 60"), nodes).withColumn("distance", F.round("distance", 6))


@query("agg_4_weighted_vectors", """WITH e AS (SELECT label % 5 AS model, vec_id AS owner, vec_id % 4 AS w, embedding FROM embeddings), l AS (SELECT model, owner, w, i - 1 AS at, CAST(embedding[i] AS DOUBLE) AS v FROM e, unnest(range(1, len(embedding) + 1)) AS t(i))
SELECT model, "at", round(CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) ELSE arg_min(v, owner) END, 5) AS value FROM l GROUP BY ALL""")
def agg_4(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") % 5).alias("model"), F.col("vec_id").alias("owner"), (F.col("vec_id") % 4).alias("w"), "embedding")
    return agg.weighted_vectors(e, ["model"], "embedding", "w").withColumn("value", F.round("value", 5))


@query("agg_5_backbone_and_heads", """WITH e AS (SELECT label % 5 AS model, vec_id % 10 AS client, vec_id % 4 AS w, embedding FROM embeddings WHERE vec_id % 4 > 0), l AS (SELECT model, w, i - 1 AS at, CAST(embedding[i] AS DOUBLE) AS v FROM e, unnest(range(1, len(embedding) + 1)) AS t(i))
SELECT -1 AS model, "at", round(sum(v * w) / sum(w), 5) AS value FROM l WHERE "at" < 8 GROUP BY "at" UNION ALL SELECT model, "at", round(sum(v * w) / sum(w), 5) FROM l WHERE "at" >= 8 GROUP BY ALL""")
def agg_5(spark, sf):
    """The first eight places are a backbone that all models share (model -1), the others heads of their models."""
    e = table(spark, sf, "embeddings").select((F.col("label") % 5).cast("int").alias("model"), F.col("vec_id").alias("owner"), (F.col("vec_id") % 4).alias("w"), "embedding").where("w > 0")
    shared = agg.weighted_vectors(e.withColumns({"model": F.lit(-1), "embedding": F.slice("embedding", 1, 8)}), ["model"], "embedding", "w")
    heads = agg.weighted_vectors(e, ["model"], "embedding", "w").where("at >= 8")
    return shared.unionByName(heads).withColumn("value", F.round("value", 5))


@query("agg_7_simple_average", "SELECT i - 1 AS at, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY 1")
def agg_7(spark, sf):
    return table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("at", "v")).groupBy("at").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("value"))


@query("agg_18_largest_statistic", "SELECT l_suppkey % 9 AS id, max(n) AS n, arg_min(mean, (-n, s)) AS mean FROM (SELECT l_suppkey, l_suppkey AS s, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY ALL) GROUP BY 1")
def agg_18(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean")).withColumn("id", F.col("l_suppkey") % 9)
    return agg.largest_statistic(s, ["id"], "n", "l_suppkey", ["mean"])


@query("agg_20_payload_size", "SELECT label, CAST(sum(len(embedding)) AS BIGINT) AS n_values, CAST(4 * sum(len(embedding)) AS BIGINT) AS bytes FROM embeddings GROUP BY label")
def agg_20(spark, sf):
    total = F.sum(F.size("embedding").cast("long"))
    return table(spark, sf, "embeddings").groupBy("label").agg(total.alias("n_values"), (4 * total).alias("bytes"))


@query("agg_21_communication", """SELECT o_custkey % 10 AS client, count(*) FILTER (WHERE o_orderstatus = 'O') AS up, count(*) FILTER (WHERE o_orderstatus = 'F') AS down, count(*) AS messages,
CAST(4 * sum(CASE WHEN o_orderstatus IN ('O', 'F') THEN length(o_orderpriority) ELSE 0 END) AS BIGINT) AS bytes FROM orders GROUP BY 1""")
def agg_21(spark, sf):
    status = F.col("o_orderstatus")
    size = F.when(status.isin("O", "F"), F.length("o_orderpriority").cast("long")).otherwise(0)
    return table(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("client")).agg(F.count(F.when(status == "O", 1)).alias("up"), F.count(F.when(status == "F", 1)).alias("down"), F.count("*").alias("messages"), (4 * F.sum(size)).alias("bytes"))


_PAIRS = """WITH v AS (SELECT vec_id // 20 AS g, vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT a.g, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS c FROM v a JOIN v b ON a.g = b.g AND a.id < b.id
WHERE list_inner_product(a.e, a.e) > 0 AND list_inner_product(b.e, b.e) > 0)"""


@query("agg_22_gradient_conflicts", _PAIRS + "SELECT g, count(*) AS pairs, round(sum(c), 4) AS cosine_sum, CAST(count(*) FILTER (WHERE c < 0) AS BIGINT) AS conflicts, round(coalesce(sum(c) FILTER (WHERE c < 0), 0), 4) AS negative_sum FROM p GROUP BY g")
def agg_22(spark, sf):
    """Within updates (groups of 20 vectors), over pairs of vectors."""
    v = table(spark, sf, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 20))
    out = agg.conflicts(v, ["g"], "vec_id", "embedding")
    return out.withColumns({c: F.round(c, 4) for c in ("cosine_sum", "negative_sum")})


# Sweep-result tables: dataset = market segment, series = priority with a bracketed value, seed = nation.
_SWEEP = """WITH r AS (SELECT c_mktsegment AS dataset, o_orderpriority || ' [' || (o_orderkey % 4) || ']' AS label, c_nationkey AS seed, CAST(o_orderkey % 4 AS DOUBLE) AS x, o_totalprice / 1000 AS y FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _sweep(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    v = F.col("o_orderkey") % 4
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("dataset"), F.concat("o_orderpriority", F.lit(" ["), v, F.lit("]")).alias("label"), F.col("c_nationkey").alias("seed"), v.cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))


@query("agg_15_sweep_spread", _SWEEP + "SELECT dataset, label, count(*) AS n, round(avg(x), 6) AS x_mean, round(stddev_pop(x), 6) AS x_std, round(avg(y), 5) AS y_mean, round(stddev_pop(y), 5) AS y_std FROM r GROUP BY ALL")
def agg_15(spark, sf):
    out = agg.spread(_sweep(spark, sf), ["dataset", "label"], ["x", "y"])
    return out.withColumns({"x_mean": F.round("x_mean", 6), "x_std": F.round("x_std", 6), "y_mean": F.round("y_mean", 5), "y_std": F.round("y_std", 5)})


@query("agg_16_trial_summary", _SWEEP + ", l AS (SELECT dataset, 'x' AS metric, x AS v FROM r UNION ALL SELECT dataset, 'y', y FROM r) SELECT dataset, metric, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM l GROUP BY ALL")
def agg_16(spark, sf):
    long = _sweep(spark, sf).unpivot(["dataset"], ["x", "y"], "metric", "v")
    return long.groupBy("dataset", "metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_pop("v"), 5).alias("std"))


@query("agg_17_clustering_outcomes", """WITH p AS (SELECT l_returnflag AS decision, l_linestatus = 'O' AS merged, l_quantity AS n, l_discount AS d, l_tax AS s FROM lineitem)
SELECT decision, merged, count(*) AS pairs, round(sum(n), 3) AS n, round(sum(d * n) / sum(n), 6) AS weighted, round(avg(d), 6) AS distance, round(avg(s), 6) AS score FROM p GROUP BY ALL""")
def agg_17(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("decision"), (F.col("l_linestatus") == "O").alias("merged"))
    n = F.col("l_quantity")
    return p.agg(F.count("*").alias("pairs"), F.round(F.sum(n), 3).alias("n"), F.round(F.sum(F.col("l_discount") * n) / F.sum(n), 6).alias("weighted"), F.round(F.avg("l_discount"), 6).alias("distance"), F.round(F.avg("l_tax"), 6).alias("score"))


@query("agg_9_noninferiority_summary", """WITH x AS (SELECT l_suppkey % 5 AS round, l_partkey % 7 AS rep, l_quantity AS n, l_discount < 0.05 AS ok FROM lineitem)
SELECT count(DISTINCT (round, rep)) AS candidates, count(DISTINCT CASE WHEN ok THEN (round, rep) END) AS accepted, round(sum(n), 3) AS n FROM x""")
def agg_9(spark, sf):
    pair = F.struct((F.col("l_suppkey") % 5).alias("round"), (F.col("l_partkey") % 7).alias("rep"))
    return table(spark, sf, "lineitem").agg(F.countDistinct(pair).alias("candidates"), F.countDistinct(F.when(F.col("l_discount") < 0.05, pair)).alias("accepted"), F.round(F.sum("l_quantity"), 3).alias("n"))


@query("agg_11_telemetry", """WITH t AS (SELECT o_custkey % 10 AS client, sum(o_totalprice) / 1e5 AS s, max(CASE WHEN o_orderkey % 50 <> 0 THEN ln(o_totalprice) END) AS e FROM orders GROUP BY 1)
SELECT count(*) AS clients, round(sum(s), 4) AS seconds_total, round(max(s), 4) AS seconds_max, round(avg(s), 4) AS seconds_mean, round(max(e), 5) AS log_e_max FROM t""")
def agg_11(spark, sf):
    finite = F.when(F.col("o_orderkey") % 50 != 0, F.ln("o_totalprice"))
    t = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 10).alias("client")).agg((F.sum("o_totalprice") / 1e5).alias("s"), F.max(finite).alias("e"))
    return t.agg(F.count("*").alias("clients"), F.round(F.sum("s"), 4).alias("seconds_total"), F.round(F.max("s"), 4).alias("seconds_max"), F.round(F.avg("s"), 4).alias("seconds_mean"), F.round(F.max("e"), 5).alias("log_e_max"))


@query("jn_9_overlaps", """WITH a AS (SELECT o_custkey AS k, o_orderstatus AS cfg, o_orderpriority AS exe, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderstatus AS cfg, o_orderpriority AS exe FROM orders WHERE o_orderkey % 2 = 1)
SELECT a.k, count(*) AS overlaps, CAST(sum(CAST(a.exe = b.exe AS INT)) AS BIGINT) AS same_execution FROM a JOIN b ON a.k = b.k AND a.cfg = b.cfg GROUP BY a.k""")
def jn_9(spark, sf):
    """Runs with equal configurations, and equal executions among them: counted by group on either side, so that no pairs are made."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("cfg"), F.col("o_orderpriority").alias("exe"), "o_orderkey")
    sides = [o.where(f"o_orderkey % 2 = {i}").groupBy("k", "cfg", "exe").agg(F.count("*").alias(n)) for i, n in ((0, "a"), (1, "b"))]
    both = sides[0].join(sides[1], ["k", "cfg", "exe"], "full_outer").na.fill(0, ["a", "b"])
    by = both.groupBy("k", "cfg").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("same"))
    return by.where("a * b > 0").groupBy("k").agg(F.sum(F.col("a") * F.col("b")).alias("overlaps"), F.sum("same").alias("same_execution"))


@query("jn_10_upsert", """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS v FROM customer WHERE c_custkey % 5 < 4), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END END AS v FROM customer WHERE c_custkey % 5 > 0)
SELECT coalesce(a.k, b.k) AS k, round(coalesce(a.v, b.v), 4) AS v, coalesce(a.v <> b.v, false) AS conflict FROM a FULL JOIN b ON a.k = b.k""")
def jn_10(spark, sf):
    """SNK-8's merge: blanks are filled, different values are conflicts."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    a = c.where(k % 5 < 4).select(k.alias("k"), F.when(k % 3 > 0, F.col("c_acctbal")).alias("v"))
    b = c.where(k % 5 > 0).select(k.alias("k"), F.when(k % 4 > 0, F.col("c_acctbal") + F.when(k % 11 == 0, 1).otherwise(0)).alias("v"))
    return matching.upsert(a, b, ["k"], ["v"]).withColumn("v", F.round("v", 4))


@query("jn_11_remap_ids", "SELECT o_orderkey AS id, coalesce(n_regionkey, o_custkey % 40) AS model FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40")
def jn_11(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("model"))
    mapping = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("old"), F.col("n_regionkey").cast("long").alias("new"))
    return matching.remap(rows, mapping, "model").select("id", "model")


@query("jn_13_log_reconciliation", """WITH log AS (SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS logged FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS id, round(coalesce(logged, c_acctbal), 4) AS value, logged IS NOT NULL AS exact FROM customer LEFT JOIN log ON o_custkey = c_custkey""")
def jn_13(spark, sf):
    """SNK-9's rule: the last log record overrides what is stored; SRC-18: later records overwrite earlier."""
    log = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("logged"))
    c = table(spark, sf, "customer").join(log, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("id"), F.round(F.coalesce("logged", "c_acctbal"), 4).alias("value"), F.col("logged").isNotNull().alias("exact"))


@query("set_1_union_rows", "SELECT n_name AS name, 'nation' AS kind, n_regionkey AS parent FROM nation UNION ALL SELECT r_name, 'region', NULL FROM region")
def set_1(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.col("n_regionkey").alias("parent"))
    return n.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")), allowMissingColumns=True)


@query("set_2_model_ids", "SELECT DISTINCT l_suppkey % 13 - 2 AS id FROM lineitem WHERE l_suppkey % 13 - 2 >= 0")
def set_2(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 13 - 2).alias("id")).where("id >= 0").distinct()


@query("set_3_missing_capabilities", "SELECT p_partkey AS id, array_to_string(list_sort(list_filter(string_split(p_type, ' '), lambda x: NOT list_contains(string_split(p_name, ' '), x))), ',') AS missing FROM part")
def set_3(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(F.filter(F.split("p_type", " "), lambda x: ~F.array_contains(F.split("p_name", " "), x))), ",").alias("missing"))


@query("set_4_shared_fields", """SELECT o_orderkey AS id, CAST(len(list_intersect(list_distinct(string_split(o_orderpriority, '')), list_distinct(string_split(o_orderstatus || 'EIGH', '')))) AS BIGINT) AS shared FROM orders""")
def set_4(spark, sf):
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    both = F.array_intersect(chars(F.col("o_orderpriority")), chars(F.concat("o_orderstatus", F.lit("EIGH"))))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.size(both).cast("long").alias("shared"))


@query("set_5_candidate_ids", "SELECT DISTINCT l_suppkey % 6 AS candidate, l_linestatus AS target FROM lineitem")
def set_5(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 6).alias("candidate"), F.col("l_linestatus").alias("target")).distinct()


@query("srt_1_legend_order", _SWEEP + """, l AS (SELECT DISTINCT label FROM r) SELECT label, row_number() OVER (ORDER BY CASE WHEN label LIKE '%URGENT%' THEN 0 ELSE 1 END, regexp_replace(label, ' \\[.*$', ''), CAST(regexp_extract(label, '\\[([0-9]+)\\]$', 1) AS DOUBLE), label) AS place FROM l""")
def srt_1(spark, sf):
    """Group, method, numeric sweep value, label; labels are few."""
    w = Window.orderBy(F.when(F.col("label").contains("URGENT"), 0).otherwise(1), tx.method_of(F.col("label")), tx.bracket_value(F.col("label")), "label")
    return _sweep(spark, sf).select("label").distinct().withColumn("place", F.row_number().over(w).cast("long"))


@query("srt_2_table_order", _SWEEP + "SELECT dataset, label, x, row_number() OVER (PARTITION BY dataset ORDER BY x, label) AS place FROM (SELECT DISTINCT dataset, label, x FROM r)")
def srt_2(spark, sf):
    w = Window.partitionBy("dataset").orderBy("x", "label")
    return _sweep(spark, sf).select("dataset", "label", "x").distinct().withColumn("place", F.row_number().over(w).cast("long"))


@query("srt_4_best_reuse", "SELECT o_custkey AS client, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1")
def srt_4(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client")).agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("srt_5_initialisation", """SELECT o_custkey AS client, CASE o_custkey % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'best' ELSE 'average' END AS policy,
round(CASE o_custkey % 3 WHEN 0 THEN max_by(o_totalprice, o_orderkey) WHEN 1 THEN min(o_totalprice) ELSE avg(o_totalprice) END, 1) AS value FROM orders GROUP BY 1""")
def srt_5(spark, sf):
    k = F.col("o_custkey") % 3
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("a"), F.min("o_totalprice").alias("b"), F.avg("o_totalprice").alias("c"))
    return g.select(F.col("o_custkey").alias("client"), F.when(k == 0, "current").when(k == 1, "best").otherwise("average").alias("policy"), F.round(F.when(k == 0, F.col("a")).when(k == 1, F.col("b")).otherwise(F.col("c")), 1).alias("value"))


@query("srt_7_weight_leader", "SELECT o_custkey AS client, arg_max(o_orderkey, (o_orderpriority, o_orderkey % 2 = 0, -o_orderkey)) AS leader FROM orders GROUP BY 1")
def srt_7(spark, sf):
    """Greatest weight; the preferred (even ones here) wins ties, then the smallest id."""
    key = F.struct("o_orderpriority", (F.col("o_orderkey") % 2 == 0).alias("p"), (-F.col("o_orderkey")).alias("i"))
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client")).agg(F.max_by("o_orderkey", key).alias("leader"))


@query("srt_9_longest_job_first", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS turn FROM part QUALIFY turn <= 100")
def srt_9(spark, sf):
    """The first hundred jobs to start: a top-k, so no global sort."""
    top = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size").orderBy(F.desc("p_retailprice"), F.desc("p_size"), "p_partkey").limit(100)
    w = Window.orderBy(F.desc("p_retailprice"), F.desc("p_size"), "p_partkey")
    return top.select(F.col("p_partkey").alias("id"), F.row_number().over(w).cast("long").alias("turn"))


@query("srt_10_sampled_holders", "SELECT l_suppkey AS model, l_orderkey AS holder FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(CAST(l_orderkey AS VARCHAR)), l_orderkey) <= 3")
def srt_10(spark, sf):
    """Three holders of each model in an order fixed by a digest (a sampling operator)."""
    w = Window.partitionBy("l_suppkey").orderBy(F.md5(F.col("l_orderkey").cast("string")), "l_orderkey")
    held = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    return held.withColumn("r", F.row_number().over(w)).where("r <= 3").select(F.col("l_suppkey").alias("model"), F.col("l_orderkey").alias("holder"))


@query("prj_2_canonical_rows", _SWEEP + """SELECT dataset, label, seed, CASE WHEN abs(y - x) <= 1e-8 + 1e-5 * abs(x) THEN 'same' WHEN x = 0 THEN 'batch' WHEN x = 1 THEN 'distance' ELSE 'series' END AS parameter, count(*) AS n FROM r GROUP BY ALL""")
def prj_2(spark, sf):
    r = _sweep(spark, sf)
    kind = F.when(st.close(F.col("y"), F.col("x")), "same").when(F.col("x") == 0, "batch").when(F.col("x") == 1, "distance").otherwise("series")
    return r.groupBy("dataset", "label", "seed", kind.alias("parameter")).agg(F.count("*").alias("n"))


@query("prj_3_predicate_scan", "SELECT o_orderkey AS id, o_orderpriority AS series FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000")
def prj_3(spark, sf):
    o = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 1000))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("series"))


@query("prj_4_plot_rows", _SWEEP + "SELECT dataset, label, count(*) AS n FROM r WHERE label LIKE '%HIGH%' OR (label LIKE '5-%' AND x >= 2) GROUP BY ALL")
def prj_4(spark, sf):
    r = _sweep(spark, sf)
    return r.where(F.col("label").contains("HIGH") | (F.col("label").startswith("5-") & (F.col("x") >= 2))).groupBy("dataset", "label").agg(F.count("*").alias("n"))


@query("prj_5_configuration_fingerprints", """SELECT c_custkey AS id, sha256('{"acct":' || (c_custkey % 7) || CASE WHEN c_custkey % 2 = 0 THEN ',"nation":' || c_nationkey ELSE '' END || ',"segment":"' || c_mktsegment || '"}') AS fingerprint FROM customer""")
def prj_5(spark, sf):
    """Options that don't matter are null and drop out of the canonical JSON."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("acct"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("segment"))
    return c.select("id", tx.fingerprint("segment", "nation", "acct").alias("fingerprint"))


@query("prj_7_sweep_inference", _SWEEP + """, l AS (SELECT DISTINCT label FROM r) SELECT label, trim(regexp_replace(label, '\\s*\\[[^\\]]*\\]\\s*$', '')) AS method, CAST(regexp_extract(label, '\\[(-?[0-9]+)\\]$', 1) AS DOUBLE) AS value,
CASE WHEN label LIKE '1-%' THEN 'batch' WHEN label LIKE '2-%' THEN 'distance' END AS parameter FROM l""")
def prj_7(spark, sf):
    """PRJ-7 and PRJ-8."""
    label = F.col("label")
    kind = F.when(label.startswith("1-"), "batch").when(label.startswith("2-"), "distance")
    return _sweep(spark, sf).select("label").distinct().select("label", tx.method_of(label).alias("method"), tx.bracket_value(label).alias("value"), kind.alias("parameter"))


@query("prj_9_representatives", _SWEEP + """, l AS (SELECT DISTINCT regexp_replace(label, ' \\[.*$', '') AS method, label, x FROM r)
SELECT method, label FROM l WHERE abs(x - 2) <= 1e-8 + 2e-5 QUALIFY row_number() OVER (PARTITION BY method ORDER BY label) = 1""")
def prj_9(spark, sf):
    r = _sweep(spark, sf).select(tx.method_of(F.col("label")).alias("method"), "label", "x").where(st.close(F.col("x"), F.lit(2.0)))
    return r.groupBy("method").agg(F.min("label").alias("label"))


@query("prj_10_dataset_order", _SWEEP + """, d AS (SELECT DISTINCT dataset FROM r) SELECT dataset, row_number() OVER (ORDER BY coalesce(nullif(list_position(['MACHINERY', 'BUILDING'], dataset), 0), 99), dataset) AS place FROM d""")
def prj_10(spark, sf):
    known = F.array(F.lit("MACHINERY"), F.lit("BUILDING"))
    rank = F.coalesce(F.nullif(F.array_position(known, F.col("dataset")), F.lit(0)), F.lit(99))
    return _sweep(spark, sf).select("dataset").distinct().withColumn("place", F.row_number().over(Window.orderBy(rank, "dataset")).cast("long"))


@query("prj_11_fixed_parameters", "SELECT o_custkey AS id, CASE count(DISTINCT o_orderstatus) WHEN 0 THEN '=?' WHEN 1 THEN '=' || min(o_orderstatus) ELSE '=varied' END AS text FROM orders GROUP BY 1")
def prj_11(spark, sf):
    n = F.countDistinct("o_orderstatus")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.when(n == 0, "=?").when(n == 1, F.concat(F.lit("="), F.min("o_orderstatus"))).otherwise("=varied").alias("text"))


@query("prj_12_series_text", "SELECT c_custkey AS id, concat_ws(' ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN '[A=' || c_nationkey || ']' END, CASE WHEN c_acctbal < 0 THEN '[debt]' END) AS series FROM customer")
def prj_12(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("[A="), "c_nationkey", F.lit("]"))), F.when(F.col("c_acctbal") < 0, "[debt]")).alias("series"))


@query("prj_13_predictions", """WITH x AS (SELECT vec_id, label % len(embedding) AS y, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings), s AS (SELECT vec_id, y, z, list_sum(list_transform(z, lambda v: exp(v))) AS t FROM x)
SELECT vec_id AS id, CAST(list_position(z, list_max(z)) - 1 AS BIGINT) AS predicted, round(1 - exp(z[y + 1]) / t, 5) AS loss FROM s""")
def prj_13(spark, sf):
    """Arg-max class, and one less the softmax of the true one, over all scores of a vector."""
    z = F.transform("embedding", lambda v: v.cast("double"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % F.size("embedding")).cast("int").alias("y"), z.alias("z"))
    return e.select("id", (F.array_position("z", F.array_max("z")) - 1).alias("predicted"), F.round(1 - F.get(st.softmax(F.col("z")), F.col("y")), 5).alias("loss"))


@query("fn_names", "SELECT p_partkey AS id, trim(regexp_replace(p_name || ' #' || p_brand || '!', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS stem, substr(sha256(p_type), 1, 12) AS digest FROM part")
def fn_names(spark, sf):
    name = F.concat("p_name", F.lit(" #"), "p_brand", F.lit("!"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.sanitized(name).alias("stem"), F.substring(F.sha2("p_type", 256), 1, 12).alias("digest"))


@query("fn_bounded_stems", "SELECT doc_id AS id, CASE WHEN length(t) <= 72 THEN t ELSE substr(t, 1, 59) || '_' || substr(sha256(t), 1, 12) END AS stem FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS t FROM documents)")
def fn_bounded(spark, sf):
    """File names from whole texts."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tx.bounded_stem(tx.sanitized(F.col("text"))).alias("stem"))


@query("fn_json_properties", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 5) AS value FROM events GROUP BY 1")
def fn_json(spark, sf):
    e = table(spark, sf, "events").select(F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("value"))


@query("fn_number_text", "SELECT DISTINCT l_discount AS x, replace(regexp_replace(printf('%.6f', l_discount), '\\.?0+$', ''), '.', 'p') AS text FROM lineitem")
def fn_numbers(spark, sf):
    return table(spark, sf, "lineitem").select("l_discount").distinct().select(F.col("l_discount").alias("x"), tx.number_text(F.col("l_discount")).alias("text"))


@query("src_18_log_scan", "SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(max_by(url, page_id), '/([a-z]{2})/', 1) AS lang, count(*) AS n FROM pages GROUP BY 1")
def src_18(spark, sf):
    """Keyed records parsed from text lines; the last of a key stands."""
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    return table(spark, sf, "pages").groupBy(host.alias("host")).agg(F.regexp_extract(F.max_by("url", "page_id"), "/([a-z]{2})/", 1).alias("lang"), F.count("*").alias("n"))


@query("snk_4_recovery_table", _SWEEP + "PIVOT r ON CAST(x AS INT) IN (0, 1, 2, 3) USING round(avg(y), 5) GROUP BY dataset")
def snk_4(spark, sf):
    return _sweep(spark, sf).withColumn("k", F.col("x").cast("int")).groupBy("dataset").pivot("k", [0, 1, 2, 3]).agg(F.round(F.avg("y"), 5))


@query("snk_10_dedupe_by_fingerprint", "SELECT o_custkey AS k, o_orderstatus AS cfg, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1, 2")
def snk_10(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("cfg")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"))


@query("lif_5_registrations", "SELECT s_suppkey AS temporary, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS BIGINT) AS id FROM supplier WHERE s_acctbal > 0")
def lif_5(spark, sf):
    """Dense ids in client order."""
    some = table(spark, sf, "supplier").where("s_acctbal > 0").select("s_nationkey", "s_suppkey")
    return numbering.numbered(some, ["s_nationkey", "s_suppkey"], "id").select(F.col("s_suppkey").alias("temporary"), "id")


@query("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 3) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 3).alias("quantity"))


@query("ext_top_k", "SELECT c_nationkey AS nation, c_custkey AS id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 5")
def ext_top_k(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").withColumn("r", F.row_number().over(w)).where("r <= 5").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))


@query("ext_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey)")
def ext_semi(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    part = lambda how, kind: c.join(o, "c_custkey", how).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return part("left_semi", "with").unionByName(part("left_anti", "without"))


@query("ext_session_windows", """WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS fresh FROM events),
s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_sessions(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").alias("start"), "n")
