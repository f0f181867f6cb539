"""Pairwise loss distances, clustering of models, and consolidation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..sources.scratch import forget, written
from .components import components, contracted


def _cells(matrix: DataFrame, scope: list[str]) -> DataFrame:
    """Cells (``candidate``, ``target``, ``n``, ``total``, ``squares``) joined into unordered pairs: ``ij``, ``ji``, ``ii``, ``jj``."""
    side = lambda name: F.struct("n", "total", "squares").alias(name)
    ij = matrix.where("candidate < target").select(*scope, F.col("candidate").alias("i"), F.col("target").alias("j"), side("ij"))
    ji = matrix.where("candidate > target").select(*scope, F.col("target").alias("i"), F.col("candidate").alias("j"), side("ji"))
    own = matrix.where("candidate = target")
    ii = own.select(*scope, F.col("candidate").alias("i"), side("ii"))
    jj = own.select(*scope, F.col("candidate").alias("j"), side("jj"))
    return ij.join(ji, [*scope, "i", "j"]).join(ii, [*scope, "i"]).join(jj, [*scope, "j"])


def loss_distances(matrix: DataFrame, scope: list[str] | None = None, least: int = 5) -> DataFrame:
    """``i``, ``j``, ``distance``: the greater of the two mean loss increases of one model on the other's data; pairs with a cell of
    fewer than ``least`` samples are absent."""
    scope = scope or []
    mean = lambda c: F.col(f"{c}.total") / F.col(f"{c}.n")
    cells = _cells(matrix, scope)
    for c in ("ij", "ji", "ii", "jj"):
        cells = cells.where(F.col(f"{c}.n") >= least)
    return cells.select(*scope, "i", "j", F.greatest(mean("ij") - mean("jj"), mean("ji") - mean("ii")).alias("distance"))


def standardized_distances(matrix: DataFrame, scope: list[str] | None = None, margin: float = 0.0) -> DataFrame:
    """``i``, ``j``, ``score``: the greater standardised increase."""
    scope = scope or []
    part = lambda c: (F.col(f"{c}.n"), F.col(f"{c}.total"), F.col(f"{c}.squares"))
    return _cells(matrix, scope).select(
        *scope, "i", "j", F.greatest(st.standardized_increase(part("ij"), part("jj"), margin), st.standardized_increase(part("ji"), part("ii"), margin)).alias("score")
    )


def cutoff(kind: str, distance: float = 0.1, confidence: float = 0.95) -> float:
    """The largest score that still links two models."""
    return distance if kind == "distance" else st.quantile(confidence)


def connected(edges: DataFrame, nodes: DataFrame, cut: float, score: str = "distance") -> DataFrame:
    """``id`` and ``component`` (smallest id) over edges with a score of at most ``cut``; missing edges link nothing."""
    linked = edges.where(F.col(score) <= cut).select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b"))
    found = components(contracted(linked.where("a > b")))
    return nodes.join(found, nodes["id"] == found["node"], "left").select("id", F.coalesce("root", "id").alias("component"))


#: Models of a scope that one task may link.
GROUPED_UP_TO = 500


def complete_linkage(edges: DataFrame, nodes: DataFrame, scope: list[str], cut: float) -> DataFrame:
    """``scope``, ``id``, ``cluster`` (smallest member): clusters merge, nearest pair first (of equal distances the pair of smallest members), while all
    their members' distances are known and at most ``cut``.

    Scopes of at most ``GROUPED_UP_TO`` models are linked by a task each, larger ones by :func:`reciprocal_linkage`; both give the same.
    """
    sizes = written(nodes.groupBy(*scope).agg((F.count("*") > GROUPED_UP_TO).alias("large")), "scopes")
    if sizes.where("large").isEmpty():
        return _grouped_linkage(edges, nodes, scope, cut)
    of = lambda df, large: df.join(sizes.where(F.col("large") == large), scope, "left_semi")
    return _grouped_linkage(of(edges, False), of(nodes, False), scope, cut).unionByName(reciprocal_linkage(of(edges, True), of(nodes, True), scope, cut))


def reciprocal_linkage(edges: DataFrame, nodes: DataFrame, scope: list[str], cut: float) -> DataFrame:
    """Complete linkage by rounds of joins: in a round all pairs of clusters merge that are each other's nearest.

    Such a pair comes before any other pair of either, and the distance of a merged cluster to a third is the greater of two that don't come
    before it, so merging it at once is what nearest-first does sooner or later. A merged cluster keeps a distance where all pairs of its parts have one; pairs beyond ``cut`` can never
    be within a cluster and are dropped at the outset. Each round is a written table; its rows are the pairs that are left.
    """
    key = F.struct("distance", "i", "j")
    pairs = edges.where(F.col("distance") <= cut).select(*scope, F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), F.col("distance").cast("double").alias("distance"))
    pairs, left = _counted(pairs, "linkage")
    members = written(nodes.select(*scope, F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("cluster")), "linked")
    while left:
        ends = pairs.select(*scope, F.explode(F.array("i", "j")).alias("cluster"), key.alias("pair"))
        nearest = ends.groupBy(*scope, "cluster").agg(F.min("pair").alias("pair"))
        # Both ends of a pair name it.
        merges = nearest.groupBy(*scope, "pair").agg(F.count("*").alias("n")).where("n = 2").select(*scope, F.col("pair.i").alias("into"), F.col("pair.j").alias("gone"))
        merges = written(merges, "merges")
        parts = merges.select(*scope, F.explode(F.array("into", "gone")).alias("cluster"), "into")
        before, was = pairs, members
        members = written(was.join(parts, [*scope, "cluster"], "left").select(*scope, "id", F.coalesce("into", "cluster").alias("cluster")), "linked")
        at = lambda c: parts.select(*scope, F.col("cluster").alias(c), F.col("into").alias(f"{c}_into"))
        moved = pairs.join(at("i"), [*scope, "i"], "left").join(at("j"), [*scope, "j"], "left")
        a, b = F.coalesce("i_into", "i"), F.coalesce("j_into", "j")
        wanted = F.when(F.col("i_into").isNull(), 1).otherwise(2) * F.when(F.col("j_into").isNull(), 1).otherwise(2)
        moved = moved.where(a != b).groupBy(*scope, F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.max("distance").alias("distance"), F.count("*").alias("n"), F.max(wanted).alias("wanted"))
        pairs, left = _counted(moved.where("n = wanted").drop("n", "wanted"), "linkage")
        for table in (before, merges, was):
            forget(table)
    return members.select(*scope, "id", "cluster")


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    seen = Observation()
    return written(df.observe(seen, F.count("*").alias("n")), name), seen.get["n"]


def _grouped_linkage(edges: DataFrame, nodes: DataFrame, scope: list[str], cut: float) -> DataFrame:
    """Complete linkage of bounded scopes, each by one task."""
    known = edges.select(*scope, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("distance").cast("double").alias("distance"))
    rows = nodes.select(*scope, F.col("id").cast("long").alias("i"), F.col("id").cast("long").alias("j"), F.lit(0.0).alias("distance")).unionByName(known)
    schema = nodes.select(*scope, F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("cluster")).schema

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["i"] == pdf["j"]
        clusters = [(i,) for i in sorted(pdf.loc[own, "i"].unique())]
        far = {}
        for i, j, d in pdf.loc[~own, ["i", "j", "distance"]].itertuples(index=False):
            far[(i,), (j,)] = far[(j,), (i,)] = d
        while True:
            options = [(far[a, b], a, b) for x, a in enumerate(clusters) for b in clusters[x + 1 :] if (a, b) in far]
            if not options or (best := min(options))[0] > cut:
                break
            _, a, b = best
            merged = tuple(sorted(a + b))
            clusters = sorted([c for c in clusters if c not in (a, b)])
            for c in clusters:
                if (a, c) in far and (b, c) in far:
                    far[merged, c] = far[c, merged] = max(far[a, c], far[b, c])
            clusters = sorted([*clusters, merged])
        out = pd.DataFrame([(i, c[0]) for c in clusters for i in c], columns=["id", "cluster"])
        for s in scope:
            out[s] = pdf[s].iloc[0]
        return out[[*scope, "id", "cluster"]]

    return rows.groupBy(*scope).applyInPandas(link, schema)


def cluster(edges: DataFrame, nodes: DataFrame, scope: list[str], cut: float, linkage: str) -> DataFrame:
    """``scope``, ``id``, ``cluster`` (smallest member) by ``single`` or ``complete`` linkage; edges join nodes of one scope only."""
    if linkage == "complete":
        return complete_linkage(edges, nodes, scope, cut)
    if linkage != "single":
        raise ValueError(f"unknown linkage {linkage!r}")
    found = connected(edges, nodes.select("id"), cut).withColumnRenamed("component", "cluster")
    return nodes.select(*scope, "id").join(found, "id").select(*scope, "id", "cluster")


def nearest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each model the nearest other (distance, then id): ``nearest`` -1 and a null distance where none was evaluated, and ``evaluated``."""
    both = edges.select(F.col("i").alias("id"), F.col("j").alias("other"), "distance").unionByName(edges.select(F.col("j").alias("id"), F.col("i").alias("other"), "distance"))
    best = both.groupBy("id").agg(F.min(F.struct("distance", "other")).alias("b"), F.count("*").alias("evaluated"))
    return nodes.join(best, "id", "left").select("id", F.coalesce("b.other", F.lit(-1)).alias("nearest"), F.col("b.distance").alias("distance"), F.coalesce("evaluated", F.lit(0)).alias("evaluated"))


def gate(differences: DataFrame, members: DataFrame, margin: float, confidence: float = 0.95, least: int = 5) -> DataFrame:
    """``id`` and ``cluster``, where a cluster any of whose members' upper bounds of loss difference passes ``margin`` (or lacks samples) falls
    apart into its members."""
    bound = st.upper_bound(F.col("n"), F.col("total"), F.col("squares"), confidence)
    fine = F.coalesce((F.col("n") >= max(least, 2)) & (bound <= margin), F.lit(False))
    joined = members.join(differences, "id", "left")
    verdict = joined.groupBy("cluster").agg(F.bool_and(fine).alias("fine"))
    return members.join(verdict, "cluster").select("id", F.when(F.col("fine"), F.col("cluster")).otherwise(F.col("id")).alias("cluster"), F.col("fine").alias("kept"))


def due(policy: str, new_model: Column) -> Column:
    """Whether clustering runs: ``disabled``, ``every_round`` or ``on_new_model``."""
    return {"disabled": F.lit(False), "every_round": F.lit(True), "on_new_model": new_model}[policy]


def mature(round_: Column, created: Column, isolation: int) -> Column:
    """Whether a model takes part in clustering."""
    return round_ >= created + isolation
