"""Shared helpers: bounded slices of Arrow batches, and memos of recurring strings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..operators.skew import fresh, join_counted  # noqa: F401
from ..sources.scratch import forget, fresh_place, written  # noqa: F401

#: Text that one step inside a task handles at a time.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose texts have about ``limit`` bytes together; a longer text stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    ends, at, n = np.cumsum(lengths), 0, len(lengths)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with ``fn`` applied to bounded slices of each batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                if (out := fn(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch[column].to_pylist()


def flat(lists: list[np.ndarray], dtype) -> pa.ListArray:
    """A list column from one array for each row."""
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(dtype)))


def located(path: str) -> str:
    """A vocabulary file's place on this machine: a bare name is one of the installed public vocabularies."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


_live: dict = {}


def only(key, make: Callable):
    """The worker's object for ``key``, kept from task to task; making another one lets it go, so that a worker which runs several
    operators in turn holds one memo at a time."""
    if key not in _live:
        _live.clear()
        _live[key] = make()
    return _live[key]


class Memo:
    """Integer lists of recurring strings, by string: each distinct one is computed once while it is held.

    ``compute`` maps a list of strings to a list of integer sequences. Past ``limit`` strings, or ``chars`` characters, those met only
    once are let go, then all but the most used half, so a task's memory is bounded whatever the vocabulary; results don't depend
    on what is held. ``kept`` hears which rows stay.
    """

    def __init__(self, compute: Callable[[list[str]], list], limit: int = 600_000, chars: int = 16 << 20, dtype=np.int32, kept: Callable[[np.ndarray], None] | None = None):
        self.compute, self.limit, self.chars, self.dtype, self.kept = compute, limit, chars, dtype, kept
        self.rows: dict[str, int] = {}
        self.uses = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)
        self.values = np.zeros(0, dtype=dtype)
        self.held = 0

    def _shrink(self) -> None:
        stay = np.flatnonzero(self.uses > 1)
        if len(stay) > self.limit // 2:
            stay = np.sort(stay[np.argsort(-self.uses[stay], kind="stable")[: self.limit // 2]])
        names = list(self.rows)
        names = [names[i] for i in stay.tolist()]
        if sum(map(len, names)) > self.chars // 2:
            names, stay = [], stay[:0]
        self.values, sizes = self._gather(stay)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.rows = dict(zip(names, range(len(names))))
        self.uses = self.uses[stay] // 2
        self.held = sum(map(len, names))
        if self.kept:
            self.kept(stay)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Row numbers of ``words``; valid until the next call."""
        rows = self._known(words)
        if (missing := np.flatnonzero(rows < 0)).size:
            if len(self.rows) + missing.size > self.limit or self.held > self.chars:
                self._shrink()
                rows = self._known(words)
                missing = np.flatnonzero(rows < 0)
            new = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            found, base = self.compute(new), len(self.rows)
            self.held += sum(map(len, new))
            self.rows.update(zip(new, range(base, base + len(new))))
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.values = np.concatenate([self.values, np.fromiter(chain.from_iterable(found), dtype=self.dtype, count=int(sizes.sum()))])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])
            rows[missing] = self._known([words[i] for i in missing.tolist()])
        self.uses += np.bincount(rows, minlength=len(self.uses))
        return rows

    def _known(self, words: list[str]) -> np.ndarray:
        get = self.rows.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.starts[rows]
        sizes = self.starts[rows + 1] - begin
        at = np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        return self.values[at], sizes

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``words`` one after the other, and each list's length."""
        return self._gather(self.lookup(words))
