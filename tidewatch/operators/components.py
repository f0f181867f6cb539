"""Connected components of graphs of any size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import forget, written


#: Edges that a task contracts at a time.
AT_ONCE = 1_000_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect what ``edges`` (a, b) connect: each task's are replaced, slice by slice, by links to the smallest node that they reach
    there. Where edges of a chain lie together, that is most of the work, done without a shuffle."""

    def forest(parent: dict[int, int]) -> pa.RecordBatch:
        for node in sorted(parent):
            parent[node] = parent[parent[node]]  # roots are smaller, so theirs are known
        nodes = [n for n, root in parent.items() if n != root]
        return pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array([parent[n] for n in nodes], type=pa.int64())], names=["a", "b"])

    def run(batches):
        parent: dict[int, int] = {}
        seen = 0
        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                ends = []
                for x in (a, b):
                    parent.setdefault(x, x)
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    ends.append(x)
                if ends[0] != ends[1]:
                    parent[max(ends)] = min(ends)
            seen += batch.num_rows
            if seen >= AT_ONCE:
                yield forest(parent)
                parent, seen = {}, 0
        if parent:
            yield forest(parent)

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges`` (a, b): the smallest node that it reaches.

    Alternating large-star and small-star steps; each round is a written table, so lineage stays short and a lost executor
    costs one round. Rounds grow with the logarithm of the longest chain.
    """
    now, state = _round(edges.select("a", "b"))
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before = state
        after, state = _round(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        forget(now)
        now = after
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges; their count and an order-free digest, taken while writing, to see that a round changed nothing."""
    seen = Observation()
    digest = F.xxhash64("a", "b")
    metrics = (F.count("*").alias("n"), F.bit_xor(digest).alias("xor"), F.sum(digest.cast("decimal(38,0)")).alias("sum"))
    table = written(edges.observe(seen, *metrics), "edges")
    return table, tuple(seen.get[k] for k in ("n", "xor", "sum"))
