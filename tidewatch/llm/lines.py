"""Line dedup by site-relative frequency: lines on too large a share of their host's pages are boilerplate and go.

A line's share is the number of the host's pages that contain it over the host's page total. It is boilerplate where the share
exceeds ``MAX_RATIO`` and at least ``MIN_PAGES`` pages contain it. A host has at most (mean distinct lines of a page) /
``MAX_RATIO`` such lines, so its list is bounded whatever its size; the counting group-by is pre-aggregated, its key holds the
line's digest, so a host with a third of all rows spreads over all tasks.

Lists of up to ``BROADCAST_BYTES`` in all are broadcast. Larger ones meet the pages by a shuffled join, for which a host with more than
a ``HEAVY``-th of all pages (there are fewer than ``HEAVY``) is split by its texts into shares of that size, each with a copy of the list.

Defined results: a null text stays null; blank lines are neither counted nor dropped; rows with a null host are a host of their
own; a repeated row counts as a page each time; a page whose lines all go keeps its row with an empty text or, with ``spare``, its whole text. Lines end at
line feeds and are compared exactly (by 128-bit digest). An empty table gives an empty result. All columns stay; ``n_lines`` and
``n_dropped`` are added, replacing columns of these names, unless ``counts`` is false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

MAX_RATIO = 0.05
MIN_PAGES = 3
#: Digest bytes of boilerplate lists that are broadcast; larger ones are joined by shuffling on the host.
BROADCAST_BYTES = 16 << 20
#: Entries of a list that each line is compared with one by one.
SHORT = 64
#: A host with more than one in so many of all pages is split for the shuffled join.
HEAVY = 4096


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n", -1)


def boilerplate(pages: DataFrame, host_col: str, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, its number of ``pages``, and ``drop``, the sorted digests of its boilerplate lines."""
    totals = pages.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("pages"))
    shown = F.filter(_lines(text_col), lambda x: F.trim(x) != "")
    digests = F.array_distinct(F.transform(shown, lambda x: F.md5(x)))
    counts = (
        pages.where(F.col(text_col).isNotNull())
        .select(F.col(host_col).alias("host"), F.explode(digests).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    both = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    common = both.where(F.col("n") > max_ratio * F.col("pages")).select("c.host", "pages", "line")
    return common.groupBy("host", "pages").agg(F.array_sort(F.collect_list("line")).alias("drop"))


def _with_lists(pages: DataFrame, found: DataFrame, host_col: str, drop: str) -> DataFrame:
    """``pages`` with their host's list as column ``drop``, null where it has none."""
    host, share = fresh(pages, "host"), fresh(pages, "share")
    found = found.withColumnRenamed("host", host).withColumnRenamed("drop", drop)
    size = found.agg(F.sum(32 * F.size(drop) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(found.drop("pages")), F.col(host_col).eqNullSafe(F.col(host)), "left").drop(host)
    total, own, n = pages.count(), fresh(pages, "own"), fresh(pages, "shares")
    sized = found.withColumn(n, F.ceil(F.col("pages") * HEAVY / total).cast("int"))
    heavy = F.broadcast(sized.where(F.col(n) > 1).select(F.col(host).alias(own), n))
    dealt = pages.join(heavy, F.col(host_col).eqNullSafe(F.col(own)), "left")
    dealt = dealt.withColumn(share, F.pmod(F.xxhash64(*pages.columns), F.coalesce(n, F.lit(1))))
    copies = sized.select(host, drop, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("copy"))
    met = dealt.join(copies, F.col(host_col).eqNullSafe(F.col(host)) & (F.col(share) == F.col("copy")), "left")
    return met.select(*pages.columns, drop)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kept(lines: Column, drop: Column) -> Column:
    """The lines that are not in the list. In a long list, first the few of it that the page holds are found by hashing; then each line is
    held against these."""

    def without(of: Column, met: Column) -> Column:
        return F.filter(of, lambda x: ~F.array_contains(met, F.md5(x)))

    met = lambda of: F.array_intersect(F.transform(of, lambda x: F.md5(x)), drop)
    few = lambda of: _bound(met(of), lambda m: F.when(F.size(m) > 0, without(of, m)).otherwise(of))
    return F.when(drop.isNull(), lines).when(F.size(drop) <= SHORT, without(lines, drop)).otherwise(_bound(lines, few))


def drop_boilerplate(
    pages: DataFrame, host_col: str, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, spare: bool = False, counts: bool = True
) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text_col``, and the numbers of lines and of dropped ones. With ``spare``, a page
    of which only blank lines would be left stays as it is."""
    added = ("n_lines", "n_dropped") if counts else ()
    if {host_col.lower(), text_col.lower()} & set(added):
        raise ValueError("the columns of hosts and texts can't be called like the numbers that are added")
    kept_columns = [c for c in pages.columns if c.lower() not in added]
    found = written(boilerplate(pages, host_col, text_col, max_ratio, min_pages), "boilerplate")
    drop, kept = fresh(pages, "drop"), fresh(pages, "kept")
    joined = _with_lists(pages, found, host_col, drop).withColumn(kept, _kept(_lines(text_col), F.col(drop)))
    if spare:
        joined = joined.withColumn(kept, F.when(F.exists(kept, lambda x: F.trim(x) != ""), F.col(kept)).otherwise(_lines(text_col)))
    lines = F.coalesce(F.size(_lines(text_col)), F.lit(0))
    n = {"n_lines": lines, "n_dropped": F.when(F.col(text_col).isNull(), 0).otherwise(lines - F.size(kept))}
    text = F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n")).alias(text_col)
    return joined.select(*(text if c == text_col else F.col(c) for c in kept_columns), *(n[c].alias(c) for c in added))
