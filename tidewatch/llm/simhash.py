"""SimHash near-duplicates: fingerprints, pigeonhole blocks joined and verified, linked groups.

Fingerprints at ``RADIUS`` or fewer differing bits are linked. A 64-bit fingerprint is split into ``RADIUS + 1`` blocks,
so two linked ones share at least one block. Exact copies meet in one fingerprint first, by a pre-aggregated group-by.
Distinct fingerprints of a block value with at most ``PAIRS_UP_TO`` members are joined on the block and verified by
Hamming distance. In larger blocks, where pairs would grow with the square, the other bits are split into ``RADIUS + 1`` blocks
again, and block and inner block are joined and verified alike. Where that too is crowded, as in a large group of near copies,
each fingerprint is dealt to itself and its 64 one-bit variants: two differ in at most two bits exactly if they share such a variant,
and a variant has at most 65 members, so the same links come out of groups of bounded size.

Rows and block members whose key holds more than a ``HEAVY``-th of all meet its row by a broadcast of fewer than ``HEAVY`` rows.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other. Rows with a null ``doc_id`` get
a fingerprint and the component of their fingerprint, but never name one. Repeated rows share their component. An empty table
gives an empty result. Ids keep their type. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import forget, fresh, join_counted, map_slices, texts, written

SEED = 42
RADIUS = 2
PAIRS_UP_TO = 64
#: Shingles whose bits are unpacked at a time: memory stays bounded for any text.
AT_ONCE = 1 << 17


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's ``width``-word shingles, repeats included, as a signed integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        votes = [digest(b" ".join(words), SEED)]
        n, ones = 1, np.unpackbits(np.array(votes, dtype="<u8").view(np.uint8), bitorder="little").astype(np.int64)
    else:
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        n = len(words) - width + 1
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, n, AT_ONCE):
            to = min(n, at + AT_ONCE)
            spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
            hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), dtype="<u8", count=to - at)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id``, ``tie`` (hash of the text) and ``fp`` (signed 64-bit) of each row."""

    def run(batch):
        values = [fingerprint(t, width) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch["id"], batch["tie"], pa.array(values, type=pa.int64())], names=["id", "tie", "fp"])

    chosen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return map_slices(chosen, run, chosen.select("id", "tie", F.col("tie").alias("fp")).schema)


def _signed(bits) -> int:
    value = sum(1 << b for b in bits)
    return value - (value >> 63 << 64)


def _parts(bits: list[int]) -> list[list[int]]:
    """Bits in ``RADIUS + 1`` runs of about one length."""
    ends = [round(len(bits) * i / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return [bits[a:b] for a, b in zip(ends, ends[1:])]


_OUTER = _parts(list(range(64)))
#: The bits of each block; and of each block with each block of the other bits.
BLOCKS = [_signed(block) for block in _OUTER]
INNER_BLOCKS = [_signed([*block, *part]) for block in _OUTER for part in _parts([b for b in range(64) if b not in block])]


def _dealt(masks: list[int], start: int = 0):
    """A fingerprint's blocks: number and bits."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(masks, start)])


def _joined(dealt: DataFrame, pairs_up_to: int, used: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Verified pairs of the blocks with few members, and the members (``fp``, ``block``) of the others."""
    dealt = written(dealt, "simhash-dealt")
    sizes = written(dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    members = join_counted(dealt, sizes, ["block", "value"], dealt.count())
    used += [dealt, sizes]
    small = members.where(F.col("n") <= pairs_up_to)
    left = small.select("block", "value", F.col("fp").alias("a"))
    right = small.select("block", "value", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return left.join(right, ["block", "value"]).where((F.col("a") > F.col("b")) & near).select("a", "b"), members.where(F.col("n") > pairs_up_to).select("fp", "block")


def links(distinct: DataFrame, pairs_up_to: int = PAIRS_UP_TO, used: list[DataFrame] | None = None) -> DataFrame:
    """Edges ``(a, b)``, a > b, that connect the distinct fingerprints ``fp`` as their links do. Tables that the edges read, for the
    caller to delete, are added to ``used``."""
    used = [] if used is None else used
    paired, crowded = _joined(distinct.select("fp", F.explode(_dealt(BLOCKS)).alias("k")).select("fp", "k.*"), pairs_up_to, used)
    n = RADIUS + 1
    of_block = F.when(F.col("block") == 0, _dealt(INNER_BLOCKS[:n])).when(F.col("block") == 1, _dealt(INNER_BLOCKS[n : 2 * n], n)).otherwise(_dealt(INNER_BLOCKS[2 * n :], 2 * n))
    inner, packed = _joined(crowded.select("fp", F.explode(of_block).alias("k")).select("fp", "k.*"), pairs_up_to, used)

    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    variants = packed.select("fp").distinct().select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    hub = met.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where(F.col("a") > F.col("b")).select("a", "b")
    return paired.unionByName(inner).unionByName(hub).distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id``, ``tie``, ``fp``, ``root`` (one fingerprint of the row's linked group) and ``component_id`` (the group's smallest id)."""
    prints = written(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    used: list[DataFrame] = []
    roots = components(links(distinct.select("fp"), used=used))
    for table in used:
        forget(table)
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    smallest = linked.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    of_linked = linked.join(smallest, "root").select("fp", "root", "component_id")
    of_all = distinct.join(of_linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return join_counted(prints, written(of_all, "simhash-roots"), ["fp"], prints.count()).drop("n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    return grouped(docs, id_col, text_col, width).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one row of each linked group: that of the smallest id and, where several texts of the group have that id, the smallest
    hash of the text. Groups are told apart by their fingerprints, so different texts under one id are different documents. Of repeated
    rows (one id, one text) one stays, whatever other columns hold; rows with a null id all stay."""
    picks = grouped(docs, id_col, text_col, width).where("id = component_id").groupBy("root").agg(F.min("id").alias("id"), F.min("tie").alias("tie"))
    own, tie = fresh(docs, "id"), fresh(docs, "tie")
    picks = written(picks.select(F.col("id").alias(own), F.col("tie").alias(tie)), "simhash-kept")
    rows = docs.withColumns({own: F.col(id_col), tie: F.xxhash64(text_col)})
    kept = rows.join(picks, [own, tie], "left_semi").dropDuplicates([own, tie]).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
