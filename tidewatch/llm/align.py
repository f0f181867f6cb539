"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in a corpus.

The tokens of B form a static index of intervals: their starts and ends, both sorted, as tokens follow one another. For each token of A two
bisections stab it: the first token of B that ends behind A's start, and the first that begins at or behind A's end; the tokens
between are all that overlap. A position between two tokens of B that no token of A spans, and the other way round, is a boundary of groups.

A text is cut into stretches, white space and what follows up to the next, where neither tokenizer joins anything across (:func:`stretches`). What is
true of a stretch recurs with it, so only distinct ones are encoded, held in bounded memos, and aligned; a text is put together from its stretches.

How often two ids are linked is counted in three steps that no frequent id can crowd. Tasks write blocks of documents with the distinct pairs
of each block; the pairs of all blocks are summed up by pair, with each pair's share compared to the most frequent of its B id (a
B id has no more pairs than A has ids); the sums go back to the blocks that hold the pair, one list for each block, bounded by its text.

Defined results: a null or empty text, and one whose A or B tokens' bytes differ from space + text (such as one with U+2581), has no
tokens: zeros and an empty ``groups_sha256``. Rows are documents of their own, repeated ones too; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import Memo, located, only, slices, written

#: Text of a block: the larger, the fewer distinct pairs in all.
BLOCK_BYTES = 1 << 20
#: Blocks that a task takes at the end, and the most tasks there; beyond these, tasks take more blocks, batch by batch.
BLOCKS_A_TASK, MOST_TASKS = 2, 20_000
#: A pair's key: A's id times this, and B's id.
WIDTH = 1 << 20
#: Stretches that A's encoder gets in one string.
_TOGETHER = 256

#: White space and what follows up to the next white space. A cut is made before a space or line feed only, and behind a character
#: that is no white space in anyone's book; stranger white space stays inside a stretch.
_STRETCH = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*|\s+")


def stretches(text: str) -> list[str]:
    """Parts of ``text`` in order: no token of a byte-level or piece vocabulary runs over their ends (:class:`Tokenizers` checks)."""
    return _STRETCH.findall(text)


class Tokenizers:
    """The two encoders on stretches, and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(located(path_a))
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=located(path_b))
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if not self.b.is_control(i) and re.search(r"[^ ][ \n]", self.bytes_b[-1].decode("latin-1")):
                raise ValueError(f"a piece runs over a cut: {piece!r}")
        for i, token in enumerate(self.bytes_a):
            if re.search(r"\S[ \n]", token.decode(errors="ignore")):
                raise ValueError(f"a token runs over a cut: {token!r}")
        self.lead = len(self.b.encode("\n"))
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        if max(len(self.bytes_a), len(self.bytes_b)) > WIDTH:
            raise ValueError(f"more than {WIDTH} ids")

    def encode_a(self, found: list[str]) -> list[list[int]]:
        """Stretches go many to a call, as nothing is joined across their ends, and are told apart by their lengths in bytes."""
        groups = [found[at : at + _TOGETHER] for at in range(0, len(found), _TOGETHER)]
        out: list[list[int]] = []
        for group, e in zip(groups, self.a.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = e.ids
            ends = np.cumsum([len(s.encode()) for s in group])
            after = np.cumsum(self.size_a[ids]) if ids else np.zeros(0, dtype=np.int64)
            cuts = np.searchsorted(after, ends) + 1
            if len(after) < cuts[-1] or (after[cuts - 1] != ends).any():
                out += [x.ids for x in self.a.encode_batch_fast(group, add_special_tokens=False)]
            else:
                cuts = cuts.tolist()
                out += [ids[p:q] for p, q in zip([0, *cuts], cuts)]
        return out

    def encode_both(self, found: list[str]) -> list[list[int]]:
        """For each stretch how many tokens A has, these, and B's."""
        return [[len(a), *a, *b] for a, b in zip(self.encode_a(found), self.encode_b(found))]

    def encode_b(self, found: list[str]) -> list[list[int]]:
        """The library puts a space before what it encodes, unless that is empty: it takes the place of a stretch's own, or of one before a
        line feed that is let go."""
        own = [len(s) > 1 and s[0] == " " for s in found]
        ids = self.b.encode([s[1:] if o else "\n" + s for s, o in zip(found, own)], num_threads=1)
        return [x if o else x[self.lead :] for x, o in zip(ids, own)]


def stab(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query [begin, end) the first and one past the last of the sorted, disjoint intervals [starts, ends) that overlap it."""
    return np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, end, side="left")


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … (sizes[0] of them), first[1], …"""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


class Aligned:
    """Stretches' tokens aligned, all at once over their bytes one after the other. ``a``, ``b``: ids; ``bounds_a``, ``bounds_b``: each stretch's.

    ``link_a``, ``link_b``: indexes of the linked tokens, ``links``: each stretch's bounds among them; ``group_a``, ``group_b``: each token's group."""

    def __init__(self, a, bounds_a, b, bounds_b, size_a, size_b):
        self.a, self.b, self.bounds_a, self.bounds_b = a, b, bounds_a, bounds_b
        # The bytes of a stretch, by A; B's may differ where the stretch isn't whole, so both get the room of the longer.
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        zero_a, zero_b = np.concatenate([[0], end_a])[bounds_a], np.concatenate([[0], end_b])[bounds_b]
        room = np.maximum(np.diff(zero_a), np.diff(zero_b))
        base = np.cumsum(room) - room
        end_a += np.repeat(base - zero_a[:-1], np.diff(bounds_a))
        end_b += np.repeat(base - zero_b[:-1], np.diff(bounds_b))
        begin_a, begin_b = end_a - size_a[a], end_b - size_b[b]
        first, last = stab(begin_b, end_b, begin_a, end_a)
        sizes = last - first
        self.link_a, self.link_b = np.repeat(np.arange(len(a)), sizes), _ranges(first, sizes)
        self.links = np.concatenate([[0], np.cumsum(sizes)])[bounds_a]
        # A's end is a boundary if the B token before the first that begins there or behind ends there too.
        closes_a = (last > 0) & (end_b[np.maximum(last - 1, 0)] == end_a) if len(b) else np.zeros(len(a), dtype=bool)
        closed = end_a[closes_a]
        self.group_a = np.concatenate([[0], np.cumsum(closes_a)])[:-1]
        self.group_b = np.searchsorted(closed, end_b, side="left")
        self.closes_a, self.closes_b = closes_a, np.isin(end_b, closed, assume_unique=True)
        self.groups = np.concatenate([[0], np.cumsum(closes_a)])[bounds_a]


def align(ids_a, ids_b, size_a: np.ndarray, size_b: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[list[int], list[int]]]]:
    """Linked index pairs of one text's tokens, and its groups as (A ids, B ids)."""
    a, b = np.asarray(ids_a, dtype=np.int64), np.asarray(ids_b, dtype=np.int64)
    x = Aligned(a, np.array([0, len(a)]), b, np.array([0, len(b)]), size_a, size_b)
    groups = [(a[x.group_a == g].tolist(), b[x.group_b == g].tolist()) for g in range(int(x.closes_a.sum()))]
    return list(zip(x.link_a.tolist(), x.link_b.tolist())), groups


class _Worker:
    """A worker's memo of both encodings, and its tables of how ids are written in groups."""

    def __init__(self, path_a: str, path_b: str):
        self.two = Tokenizers(path_a, path_b)
        self.memo = Memo(self.two.encode_both, limit=250_000, chars=8 << 20)
        n = max(len(self.two.bytes_a), len(self.two.bytes_b))
        self.written = pa.array([b"%d%s" % (i, end) for i in range(n) for end in (b",", b"|", b";")], type=pa.binary())

    def tokens(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and B's of the stretches one after the other, and how many each has."""
        both, sizes = self.memo.joined(found)
        begin = np.cumsum(sizes) - sizes
        n_a = both[begin].astype(np.int64)
        n_b = sizes - 1 - n_a
        return both[_ranges(begin + 1, n_a)].astype(np.int64), n_a, both[_ranges(begin + 1 + n_a, n_b)].astype(np.int64), n_b

    def whole(self, found: list[str], ids: np.ndarray, counts: np.ndarray, table: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which stretches are the bytes of their ids."""
        data, said = b"".join([table[i] for i in ids.tolist()]), [s.encode() for s in found]
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        if data == b"".join(said) and (np.diff(ends) == np.fromiter(map(len, said), dtype=np.int64, count=len(said))).all():
            return np.ones(len(found), dtype=bool)
        ends = ends.tolist()
        return np.array([data[p:q] == s for s, p, q in zip(said, ends, ends[1:])], dtype=bool)

    def written_groups(self, x: Aligned) -> pa.Array:
        """``a1,a2|b1;`` and so on for each stretch: A's token comes behind the tokens of the groups before it, B's behind A's of its group too."""
        before = np.searchsorted(x.group_b, x.group_a, side="left")  # B tokens of the groups before
        after = np.searchsorted(x.group_a, x.group_b, side="right")  # A tokens up to this group's last
        codes = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        codes[np.arange(len(x.a)) + before] = 3 * x.a + np.where(x.closes_a, 1, 0)
        codes[np.arange(len(x.b)) + after] = 3 * x.b + np.where(x.closes_b, 2, 0)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array((x.bounds_a + x.bounds_b).astype(np.int32)), self.written.take(pa.array(codes))), b"")


def _worker(path_a: str, path_b: str) -> _Worker:
    return only(("align", path_a, path_b), lambda: _Worker(path_a, path_b))


def _block(part: pa.RecordBatch, path_a: str, path_b: str) -> dict:
    """A slice's documents: what each has by itself, the distinct pairs of all, and which of these each document's links are."""
    worker = _worker(path_a, path_b)
    two, found, counts = worker.two, [], [0]
    for t in part["text"].to_pylist():
        cut = stretches(f" {t}") if t else []
        found += cut
        counts.append(len(cut))
    coded = pa.array(found, type=pa.string()).dictionary_encode()
    distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.cumsum(counts)
    a, n_a, b, n_b = worker.tokens(distinct)
    whole = worker.whole(distinct, a, n_a, two.bytes_a, two.size_a) & worker.whole(distinct, b, n_b, two.bytes_b, two.size_b)
    # A stretch that isn't whole counts as one without tokens; its documents have none at all.
    keep_a, keep_b = np.repeat(whole, n_a), np.repeat(whole, n_b)
    n_a, n_b = n_a * whole, n_b * whole
    bounds_a, bounds_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    x = Aligned(a[keep_a], bounds_a, b[keep_b], bounds_b, two.size_a, two.size_b)

    good = np.logical_and.reduceat(np.append(whole[index], True), bounds[:-1]) if len(bounds) > 1 else np.zeros(0, dtype=bool)
    good &= np.diff(bounds) > 0
    rows_good = np.repeat(good, np.diff(bounds))
    index = index[rows_good]
    bounds = np.concatenate([[0], np.cumsum(np.diff(bounds) * good)])

    def total(each: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(each[index])])
        return np.diff(sums[bounds])

    n_links = np.diff(x.links)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), worker.written_groups(x).take(pa.array(index))), b"")
    _, at, data = joined.buffers()
    at = np.frombuffer(at, dtype=np.int32)[: len(joined) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    shas = [hashlib.sha256(view[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(at, at[1:])]

    keys = x.a[x.link_a] * WIDTH + x.b[x.link_b]
    used = np.zeros(len(whole), dtype=bool)
    used[index] = True
    pairs = np.unique(keys[np.repeat(used, n_links)])
    place = np.searchsorted(pairs, keys)  # of stretches in use only
    rows = _ranges(x.links[:-1][index], n_links[index])
    per_document = place[rows]
    return {
        "doc_id": part["doc_id"],
        "n_a": total(n_a), "n_b": total(n_b), "n_groups": total(np.diff(x.groups)), "n_links": total(n_links), "groups_sha256": shas,
        "pairs": pairs, "times": np.bincount(per_document, minlength=len(pairs)), "links": per_document.astype(_place_type(len(pairs))).tobytes(),
    }


def _place_type(pairs: int) -> str:
    """What a place among so many pairs is written as."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of documents: ``block``, lists over its documents, its distinct ``pairs``, how many ``times`` each is linked, and
    ``links``, the documents' links one after the other as places in ``pairs`` (two bytes each, four where a block has more pairs than that)."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    longs = F.array(F.lit(0).cast("long"))
    schema = chosen.select(
        F.lit(0).cast("long").alias("block"), F.array("doc_id").alias("doc_id"), *(longs.alias(c) for c in _COUNTS), F.array(F.lit("")).alias("groups_sha256"),
        longs.alias("pairs"), longs.alias("times"), F.lit("").cast("binary").alias("links"),
    ).schema

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                made, arrays = _block(part, path_a, path_b), [pa.array([block])]
                for field in schema.names[1:-1]:
                    values = made[field]
                    values = values if isinstance(values, pa.Array) else pa.array(values, type=pa.string() if field == "groups_sha256" else pa.int64())
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values))
                arrays.append(pa.array([made["links"]], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                block += 1

    return chosen.mapInArrow(run, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """``pair``, ``total`` (links of the whole corpus that link its ids) and ``best``: whether no pair of its B id has more."""
    each = made.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("total"))
    each = written(each, "align-pairs")
    most = each.groupBy((F.col("pair") % WIDTH).alias("b")).agg(F.max("total").alias("most"))
    return each.withColumn("b", F.col("pair") % WIDTH).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def digest(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of each row."""
    made = written(blocks(docs, path_a, path_b, id_col, text_col), "align-blocks", compression="zstd")
    asked = made.select("block", F.posexplode("pairs").alias("at", "pair"))
    # A task takes few blocks, as one block's lists are as large as its text; the hint keeps them from being sorted.
    n = max(1, min(made.count() // BLOCKS_A_TASK, MOST_TASKS))
    told = asked.join(pair_counts(made), "pair").repartition(n, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "total", "best"))).alias("told"))
    told = told.select("block", F.col("told.total").alias("total"), F.col("told.best").alias("best"))
    both = made.select("block", "doc_id", *_COUNTS, "groups_sha256", "links").repartition(n, "block").join(told.hint("shuffle_hash"), "block", "left")
    names = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    zero = F.lit(0).cast("long")
    schema = docs.select(F.col(id_col).alias("doc_id")).select("doc_id", *(zero.alias(c) for c in names[1:-1]), F.lit("").alias("groups_sha256")).schema

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].values for c in ("doc_id", *_COUNTS, "groups_sha256")}
                n = row["n_links"].to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(n)])
                for name in ("best", "total"):
                    told = batch[name][i].values
                    value = told.to_numpy(zero_copy_only=False).astype(np.int64) if told is not None else np.zeros(0, dtype=np.int64)
                    links = np.frombuffer(batch["links"][i].as_buffer(), dtype=_place_type(len(value)))
                    row[name] = np.diff(np.concatenate([[0], np.cumsum(value[links])])[bounds])
                columns = [row["doc_id"], *(row[c] for c in _COUNTS), pa.array(row["best"]), pa.array(row["total"]), row["groups_sha256"]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, schema)
