"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified exactly.

An item's windows are its runs of ``WINDOW`` words; each is a set of shingles of ``SHINGLE`` words (one shingle for a shorter
window). Shingles are ordered by rarity: their number of occurrences in all documents. A document that contains the whole window
contains all its shingles, so for exact containment the necessary prefix is the window's rarest shingle, and only documents
with that one are candidates. The shingle's place in the window and in the document gives the only possible start (positional
bound), the window must end within the document (length bound), and its words are compared one by one.

Benchmarks of up to ``BROADCAST_WINDOWS`` windows and ``BROADCAST_BYTES`` are broadcast and documents are scanned where they lie. Larger ones are joined
by shuffle on the shingle's hash: :func:`scan_by_shuffle`, with the same results; only documents' shingles that a bitmap of fixed size lets pass cross
the network; a frequent shingle is dealt to ``SALTS`` keys or, once its
places are counted, met by a broadcast of the few such, and the rows of a text with many copies are spread.

Ids keep their type. Defined results: null and empty texts have no words; an item without words has no window; repeated items and documents count as
rows of their own (an item id once for each document); empty tables give no hits. Other columns are ignored by :func:`scan`
and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import left_join_spread
from .common import fresh, join_counted, map_slices, slices, texts, written

WINDOW = 10
SHINGLE = 5
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Bits of a shingle's hash by which documents' shingles are told apart before they cross the network: a bitmap of 32 MB.
FILTER_BITS = 28
#: Keys that the places of one shingle are dealt to before they are counted.
SALTS = 64

_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and all that isn't ASCII."""
    return (text or "").encode().translate(_FOLD).split()


def _windows(ws: list[bytes]) -> list[list[bytes]]:
    n = min(WINDOW, len(ws))
    return [ws[i : i + n] for i in range(len(ws) - n + 1)] if n else []


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item`` (its id as text) and ``window`` (its words, space-joined), distinct."""

    def run(batch):
        rows = [(i, b" ".join(w).decode()) for i, t in zip(batch["item"].to_pylist(), texts(batch)) for w in _windows(words(t))]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.string()) for k in (0, 1)], names=["item", "window"])

    chosen = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return map_slices(chosen, run, "item string, window string").where("item is not null").distinct()


class Index:
    """The windows of a bounded benchmark, as word ids, and their shingles' keys."""

    def __init__(self, rows: list[tuple[str, str]]):
        windows = sorted({w for _, w in rows})
        self.split = [w.encode().split(b" ") for w in windows]
        self.vocab = {w: i for i, w in enumerate(sorted({w for ws in self.split for w in ws}), 1)}
        at = {w: i for i, w in enumerate(windows)}
        self.items: list[list[str]] = [[] for _ in windows]
        for item, w in rows:
            self.items[at[w]].append(item)
        self.length = np.array([len(ws) for ws in self.split], dtype=np.int64)
        self.ids = np.full((len(windows), WINDOW), -1, dtype=np.int64)
        for i, ws in enumerate(self.split):
            self.ids[i, : len(ws)] = [self.vocab[w] for w in ws]
        self.count: dict[int, int] = {}

    @staticmethod
    def keys(ids: np.ndarray, size: int) -> np.ndarray:
        """A 64-bit key of each run of ``size`` ids; collisions are sorted out by the comparison of words."""
        n = len(ids) - size + 1
        key = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(size)
            key ^= key >> np.uint64(29)
        return key

    @cached_property
    def shingles(self) -> list[tuple[int, int, int, int]]:
        """(size, key, window, offset) of every window's shingles."""
        out = []
        for w, n in enumerate(self.length.tolist()):
            size = min(SHINGLE, n)
            out += [(size, int(k), w, o) for o, k in enumerate(self.keys(self.ids[w, :n], size))]
        return out

    def tables(self, counts: dict[tuple[int, int], int] | None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: sorted keys with window and offset; of all shingles, or given counts, of each window's rarest."""
        chosen = self.shingles
        if counts is not None:
            best: dict[int, tuple] = {}
            for s in chosen:
                rank = (counts.get(s[:2], 0), s[3])
                if s[2] not in best or rank < best[s[2]][0]:
                    best[s[2]] = (rank, s)
            chosen = [s for _, s in best.values()]
        out = {}
        for size in {s[0] for s in chosen}:
            of = sorted(s[1:] for s in chosen if s[0] == size)
            out[size] = (np.array([s[0] for s in of], dtype=np.uint64), np.array([s[1] for s in of]), np.array([s[2] for s in of]))
        return out

    def read(self, batch_texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The documents' word ids in a row (0: in no item), parted and padded by zeros; and each one's number of words."""
        get, ids, sizes, gap = self.vocab.get, [0] * WINDOW, [], [0] * WINDOW
        for t in batch_texts:
            ws = words(t)
            sizes.append(len(ws))
            ids += [get(w, 0) for w in ws]
            ids += gap
        return np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)


def _runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` item words follow one another."""
    filled = np.concatenate([[0], np.cumsum(ids > 0)])
    return np.flatnonzero(filled[size:] - filled[:-size] == size)


def _found(ids: np.ndarray, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, and for each the range of equal ``keys``."""
    at = _runs(ids, size)
    key = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[at + j].astype(np.uint64) + np.uint64(size)
        key ^= key >> np.uint64(29)
    lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
    hit = hi > lo
    return at[hit], lo[hit], hi[hit]


def _counts(docs: DataFrame, index) -> dict[tuple[int, int], int]:
    """Occurrences of each item shingle in all documents; as many rows as the benchmark has shingles."""

    def run(batches):
        tables = index.value.tables(None)
        unique = {size: np.unique(t[0]) for size, t in tables.items()}
        sums = {size: np.zeros(len(k), dtype=np.int64) for size, k in unique.items()}
        for batch in batches:
            for part in slices(batch):
                ids, _ = index.value.read(texts(part))
                for size, keys in unique.items():
                    _, lo, _ = _found(ids, size, keys)
                    sums[size] += np.bincount(lo, minlength=len(keys))
        rows = [(size, int(k), int(n)) for size, keys in unique.items() for k, n in zip(keys.view(np.int64), sums[size]) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["size", "key", "n"]
        )

    summed = docs.select("text").mapInArrow(run, "size int, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
    return {(r.size, r.key % (1 << 64)): r.n for r in summed.toPandas().itertuples()}


def _hits(index: Index, tables, batch_texts) -> list[tuple[int, int, list[str]]]:
    """For each document: words, words hit, sorted ids of items with a window in it."""
    ids, sizes = index.read(batch_texts)
    starts = WINDOW + np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]])
    places, chosen = [], []
    for size, (keys, window, offset) in tables.items():
        at, lo, hi = _found(ids, size, keys)
        many = hi - lo
        entry = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
        places.append(np.repeat(at, many) - offset[entry])
        chosen.append(window[entry])
    start, window = np.concatenate(places), np.concatenate(chosen)
    same = np.ones(len(start), dtype=bool)
    for j in range(WINDOW):
        same &= (ids[np.minimum(start + j, len(ids) - 1)] == index.ids[window, j]) | (j >= index.length[window])
    start, window = start[same], window[same]
    cover = np.bincount(start, minlength=len(ids) + 1) - np.bincount(start + index.length[window], minlength=len(ids) + 1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
    n_hit = hit[starts + sizes] - hit[starts]
    items: list[set[str]] = [set() for _ in sizes]
    of = np.searchsorted(starts, start, side="right") - 1
    for doc, w in np.unique(np.stack([of, window]), axis=1).T.tolist():
        items[doc].update(index.items[w])
    return [(int(n), int(h), sorted(i)) for n, h, i in zip(sizes, n_hit, items)]


def _schema(docs: DataFrame):
    long = F.lit(None).cast("long")
    return docs.select("doc_id", long.alias("n_words"), long.alias("n_hit"), F.lit(None).cast("array<string>").alias("items")).schema


def _scan_batch(rows, ids) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array([r[k] for r in rows], type=pa.int64()) for k in (0, 1)), pa.array([r[2] for r in rows], type=pa.list_(pa.string()))],
        names=["doc_id", "n_words", "n_hit", "items"],
    )


def _prepared(docs: DataFrame, benchmark: DataFrame):
    """The broadcast index and its prefix tables; None where the benchmark is too large, with its windows."""
    windows = written(item_windows(benchmark), "windows")
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()
    if n > BROADCAST_WINDOWS or size > BROADCAST_BYTES:
        return None, windows
    sc = docs.sparkSession.sparkContext
    index = sc.broadcast(Index([tuple(r) for r in windows.collect()]))
    tables = sc.broadcast(index.value.tables(_counts(docs, index))) if index.value.items else None
    return (index, tables), windows


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit`` (words inside an occurrence of a window) and ``items`` (sorted ids) of each document."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ready, windows = _prepared(chosen, benchmark)
    if ready is None:
        return scan_by_shuffle(chosen, windows)
    index, tables = ready

    def run(batch):
        rows = _hits(index.value, tables.value, texts(batch)) if tables else [(len(words(t)), 0, []) for t in texts(batch)]
        return _scan_batch(rows, batch["doc_id"])

    return map_slices(chosen, run, _schema(chosen))


def _hash(ws: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(ws)) - (1 << 63)


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """One bit for each value of the last ``FILTER_BITS`` bits of the shingles' hashes: a filter of fixed size whatever the benchmark's. Its blocks
    are put together by tasks."""
    low = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    blocks = shingles.select(F.shiftright(low, 16).alias("block"), low.bitwiseAND(0xFFFF).cast("int").alias("bit")).groupBy("block").agg(F.collect_set("bit").alias("set"))

    def packed(batches):
        for batch in batches:
            found = []
            for x in batch["set"]:
                marks = np.zeros(1 << 16, dtype=bool)
                marks[x.values.to_numpy()] = True
                found.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(found, type=pa.binary())], names=["block", "bytes"])

    out = np.zeros(1 << FILTER_BITS >> 3, dtype=np.uint8)
    for block, data in blocks.mapInArrow(packed, "block long, bytes binary").toLocalIterator():
        out[block << 13 : block + 1 << 13] = np.frombuffer(data, dtype=np.uint8)
    return out


def _maybe(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a hash may be one of the bitmap's."""
    low = hashes & (8 * len(bitmap) - 1)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def scan_by_shuffle(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """:func:`scan` for a benchmark of any size: shingle hashes of both sides meet in a shuffled join."""

    def of_windows(batch):
        out = []
        for w in batch["window"].to_pylist():
            ws = w.encode().split(b" ")
            size = min(SHINGLE, len(ws))
            out += [(w, o, size, _hash(ws[o : o + size])) for o in range(len(ws) - size + 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))],
            names=["window", "offset", "size", "key"],
        )

    distinct = windows.select("window").distinct()
    shingles = written(map_slices(distinct, of_windows, "window string, offset int, size int, key long", "window"), "shingles")
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # 1 to SHINGLE

    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(shingles))

    def of_docs(batch):
        out: list[tuple] = []
        for key, t in zip(batch["row"].to_pylist(), texts(batch)):
            ws = words(t)
            for size in sizes:
                hashes = [_hash(ws[i : i + size]) for i in range(len(ws) - size + 1)]
                out += [(key, i, size, hashes[i]) for i in np.flatnonzero(_maybe(bits.value, np.array(hashes, dtype=np.int64))).tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))],
            names=["row", "at", "size", "key"],
        )

    keyed = docs.withColumn("row", identity("text"))  # equal texts share their hits
    places = map_slices(keyed.select("row", "text").dropDuplicates(["row"]), of_docs, "row string, at int, size int, key long")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    wanted = shingles.select("size", "key").distinct().select("size", "key", salts)
    salted = places.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
    met = written(salted.join(wanted, ["size", "key", "salt"], "left_semi").drop("salt"), "shingle-places")
    rarity = met.groupBy("size", "key").agg(F.count("*").alias("n"))
    prefix = (
        shingles.join(rarity, ["size", "key"], "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "size", "key")).alias("p"))
        .select("window", "p.*")
    )
    candidates = join_counted(met, written(prefix, "shingle-prefix"), ["size", "key"], met.count())
    candidates = candidates.select("row", "window", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
    items = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    by_row = candidates.join(items, "window").groupBy("row").agg(F.collect_list(F.struct("window", "start", "items")).alias("found"))

    def verify(batch):
        rows = []
        for t, found in zip(texts(batch), batch["found"].to_pylist()):
            ws, hit, items = words(t), set(), set()
            for f in found or []:
                w = f["window"].encode().split(b" ")
                if ws[f["start"] : f["start"] + len(w)] == w:
                    hit.update(range(f["start"], f["start"] + len(w)))
                    items.update(f["items"])
            rows.append((len(ws), len(hit), sorted(items)))
        return _scan_batch(rows, batch["doc_id"])

    return map_slices(left_join_spread(keyed, by_row, "row").select("doc_id", "text", "found"), verify, _schema(docs))


def identity(text_col: str) -> Column:
    """What stands for a text where equal ones are merged: its SHA-256, so that different texts are never taken for one. Null is as empty."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def digest(found: DataFrame) -> DataFrame:
    """The result of :func:`scan` with the items as number and digest."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that contain a window of an item."""
    ready, windows = _prepared(docs.select(F.col(text_col).alias("text")), benchmark)
    if ready is None:
        row = fresh(docs, "row")
        keyed = docs.withColumn(row, identity(text_col))
        single = keyed.select(F.col(row).alias("doc_id"), F.col(text_col).alias("text")).dropDuplicates(["doc_id"])
        bad = scan_by_shuffle(single, windows).where("n_hit > 0").select(F.col("doc_id").alias(row), F.lit(True).alias(fresh(keyed, "bad")))
        return left_join_spread(keyed, bad, row).where(F.col(bad.columns[1]).isNull()).select(*docs.columns)
    index, tables = ready
    if tables is None:
        return docs

    def run(batch):
        clean = [h == 0 for _, h, _ in _hits(index.value, tables.value, texts(batch, text_col))]
        return batch.filter(pa.array(clean, type=pa.bool_()))

    return map_slices(docs, run, docs.schema, text_col)


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
