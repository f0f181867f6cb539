"""SentencePiece encoding by streaming Viterbi, and decoding.

A text is cut into vocabulary pieces so that the sum of the pieces' scores is greatest (of equal sums, the one whose last piece is
longest, then the one before, and so on). Spaces are the pieces' word marks, one is put before the text, and characters that no
piece covers become byte pieces, so decoding returns every text exactly.

The search reads a stretch character by character. It keeps scores of the starts of open pieces only, which are no further back than the
longest piece, and whenever the
backpointer paths of all of these run through one boundary, the pieces before it are final and are committed (in a text on
which two ways of cutting stay abreast, backpointers wait until one wins). No piece of the vocabulary
holds a line feed or a space after another character, so paths always converge there, as they do between letters, digits and marks where
no piece joins these; recurring stretches between such boundaries are computed once while a bounded memo holds them.

The vocabulary file scores pieces by rank (minus the rank in merge order); the search takes its scores as they are.

Defined results: a null text has null ids and decodes to null; an empty text has the ids of the lone word mark; the mark's own
character (U+2581) in a text becomes byte pieces. Other columns are kept by :func:`encode_column`, :func:`decode_column`.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, flat, located, map_slices, only, texts

MARK = "▁"
#: What a character without a piece scores below the least scored piece.
UNKNOWN_PENALTY = 10.0


_LETTER, _MARK_CHAR, _DIGIT = re.compile(r"[^\W\d_²³¹¼½¾]"), re.compile(r"[!-/:-@\[-`{-~]"), re.compile("[0-9]")
#: Stretches between boundaries that no piece runs over: words with the spaces before them, line feeds.
_STRETCH = re.compile("\n| *[^ \n]+| +")
#: The same for a vocabulary in which no piece joins a letter and an ASCII mark, or a digit and anything else.
_FINE_STRETCH = re.compile(
    r"\n| *[0-9]{1,3}| *[^\W\d_²³¹¼½¾]++(?=[!-@\[-`{-~ \n]|$)| *[!-/:-@\[-`{-~]++(?=[^\W\d_²³¹¼½¾]|[0-9 \n]|$)| *[^ \n]+| +"
)


class Vocabulary:
    """Pieces, scores and byte pieces of a model file; a piece's word mark is a space here."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=located(path))
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.trie: dict = {}
        self.longest = 1
        self.stretch = _FINE_STRETCH
        scores = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                piece = piece.replace(MARK, " ")
                self.bytes_of.append(piece.encode())
                self.add(piece, i, model.get_score(i))
                scores.append(model.get_score(i))
        self.unknown = min(scores) - UNKNOWN_PENALTY

    def add(self, piece: str, piece_id: int, score: float) -> None:
        node = self.trie
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = (score, piece_id)
        self.longest = max(self.longest, len(piece))
        if " " in piece.lstrip(" ") or "\n" in piece:
            raise ValueError(f"a piece runs over a word boundary: {piece!r}")
        joins = [(x.match(a), y.match(b)) for a, b in zip(piece, piece[1:]) for x, y in ((_LETTER, _MARK_CHAR), (_MARK_CHAR, _LETTER))]
        if any(x and y for x, y in joins) or (len(piece) > 1 and _DIGIT.search(piece)):
            self.stretch = _STRETCH


class StreamingViterbi:
    """Feeds on characters; ``commit`` receives ids (below zero: -1 - code point, for a character without a piece)."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.out = vocab, []
        self.nodes: list[tuple[int, float, dict]] = []  # open starts (none older than the longest piece), their scores and places in the trie
        self.at, self.now = 0, 0.0  # the last boundary and its score
        self.back: dict[int, tuple[int, int]] = {}  # boundary: the one before and the piece between, since the last commit
        self.base = 0  # the last committed boundary
        self.check_at = 2 * vocab.longest

    def feed(self, characters: str) -> None:
        """Each character extends every open start, opens one, and scores the boundary behind it."""
        trie, unknown = self.vocab.trie, self.vocab.unknown
        nodes, at, score, back = self.nodes, self.at, self.now, self.back
        for c in characters:
            best, still = -np.inf, []
            nodes.append((at, score, trie))
            for start, before, node in nodes:
                node = node.get(c)
                if node is not None:
                    still.append((start, before, node))
                    hit = node.get("")
                    if hit is not None and before + hit[0] > best:
                        best, link = before + hit[0], (start, hit[1])
            # the last of them is the character by itself
            if (node is None or hit is None) and score + unknown > best:
                best, link = score + unknown, (at, -1 - ord(c))
            at, score, nodes = at + 1, best, still
            back[at] = link
            if at >= self.check_at:
                self.nodes, self.at, self.now = nodes, at, score
                self.commit(self.meeting())
                back = self.back
                self.check_at = at + max(2 * self.vocab.longest, at - self.base)  # walks add up to the stretch's length
        self.nodes, self.at, self.now = nodes, at, score

    @property
    def score(self) -> dict[int, float]:
        """The window: scores of the boundaries from which a piece may yet begin or go on."""
        return {start: before for start, before, _ in self.nodes} | {self.at: self.now}

    def meeting(self) -> int:
        """The last boundary that the paths of all surviving boundaries run through."""
        # Whoever extends a path next starts at an open start or here.
        alive = {self.at, *(s for s, *_ in self.nodes)}
        while len(alive) > 1:
            last = max(alive)
            alive.discard(last)
            alive.add(self.back[last][0])
        return alive.pop()

    def commit(self, to: int) -> None:
        ids, at = [], to
        while at > self.base:
            before, piece = self.back[at]
            ids.append(piece)
            at = before
        self.out += reversed(ids)
        if to > self.base:
            self.back = {k: v for k, v in self.back.items() if k > to}
            self.base = to

    def finish(self) -> list[int]:
        self.commit(self.at)
        return self.out


def viterbi(vocab: Vocabulary, stretch: str) -> list[int]:
    """The ids of a stretch (spaces as word marks) by the streaming search."""
    search = StreamingViterbi(vocab)
    search.feed(stretch)
    ids = search.finish()
    if min(ids, default=0) < 0:
        ids = [i for piece in ids for i in ([piece] if piece >= 0 else [vocab.byte_ids[b] for b in chr(-1 - piece).encode()])]
    return ids


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _memo(path: str) -> Memo:
    """The worker's memo for a model file."""
    return only(("pieces", path), lambda: Memo(lambda found: [viterbi(_vocabulary(path), s) for s in found], limit=400_000))


def encode(batch_texts: list[str | None], path: str) -> list[np.ndarray | None]:
    """The ids of each text."""
    memo, stretch = _memo(path), _vocabulary(path).stretch
    found, counts = [], []
    for t in batch_texts:
        parts = stretch.findall(f" {t}") if t is not None else []
        found += parts
        counts.append(len(parts))
    ids, sizes = memo.joined(found)
    bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])]
    return [None if t is None else ids[a:b] for t, a, b in zip(batch_texts, bounds, bounds[1:])]


def decode(ids, path: str) -> str | None:
    """The text of ids from :func:`encode`."""
    if ids is None:
        return None
    table = _vocabulary(path).bytes_of
    return b"".join([table[i] for i in np.asarray(ids).tolist()]).decode()[1:]


def _lists(ids: list[np.ndarray | None]) -> pa.ListArray:
    lists = flat([np.zeros(0, np.int32) if x is None else x for x in ids], np.int32)
    return pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array([x is None for x in ids], type=pa.bool_()))


def encode_column(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` in ``out_col`` (which replaces a column of that name)."""
    kept = [c for c in docs.columns if c.lower() != out_col.lower()]

    def run(batch):
        arrays = [batch[c] for c in kept] + [_lists(encode(texts(batch, text_col), path))]
        return pa.RecordBatch.from_arrays(arrays, names=[*kept, out_col])

    schema = docs.select(*kept, F.lit(None).cast("array<int>").alias(out_col)).schema
    return map_slices(docs, run, schema, text_col)


def decode_column(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids_col`` in ``out_col`` (which replaces a column of that name)."""
    kept = [c for c in encoded.columns if c.lower() != out_col.lower()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part[ids_col]
                decoded = [decode(column[i].values.to_numpy() if column[i].is_valid else None, path) for i in range(len(column))]
                yield pa.RecordBatch.from_arrays([part[c] for c in kept] + [pa.array(decoded, type=pa.string())], names=[*kept, out_col])

    schema = encoded.select(*kept, F.lit(None).cast("string").alias(out_col)).schema
    return encoded.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, path: str, text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``n_pieces``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers), ``decoded_sha256`` and
    ``lossless`` (the ids decode to the text): encoding and decoding in one pass, so that a task keeps one worker and one memo. With ``digest_only``, neither the ids nor the text are returned."""
    names = ("ids", "n_pieces", "ids_crc32", "decoded_sha256", "lossless", *([text_col] if digest_only else []))
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]

    def run(batch):
        values = texts(batch, text_col)
        ids = encode(values, path)
        decoded = [decode(x, path) for x in ids]
        columns = {
            "n_pieces": pa.array([None if x is None else len(x) for x in ids], type=pa.int64()),
            "ids_crc32": pa.array([None if x is None else zlib.crc32(x.astype("<u4").tobytes()) for x in ids], type=pa.int64()),
            "decoded_sha256": pa.array([None if d is None else hashlib.sha256(d.encode()).hexdigest() for d in decoded], type=pa.string()),
            "lossless": pa.array([a == b for a, b in zip(values, decoded)], type=pa.bool_()),
        } | ({} if digest_only else {"ids": _lists(ids)})
        return pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns.values()], names=[*kept, *columns])

    long, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    added = {"n_pieces": long, "ids_crc32": long, "decoded_sha256": text, "lossless": F.lit(None).cast("boolean")} | ({} if digest_only else {"ids": F.lit(None).cast("array<int>")})
    return map_slices(docs, run, docs.select(*kept, *(x.alias(c) for c, x in added.items())).schema, text_col)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids_crc32``, ``decoded_sha256``, ``lossless`` of each row."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return encode_checked(chosen, path, digest_only=True)
