"""BPE encoding as a transducer with bounded lookahead, and decoding by an incremental byte-to-text machine.

A merge list is *proper* if each merge comes after those that make its two parts. For such a list, what is read later can change the
tokens of what was read before only near its end: a merge over the end takes the last token of what is common to both readings, a later
merge may take the token before that together with what the first one made, and so on. Each such merge comes later in the list than the one before, and its
right part begins with the left part of that one, so the longest chain in bytes is found in one pass over the list
(:meth:`Merges.lookahead`). The transducer (:class:`Transducer`) holds about twice that many symbols at most: tokens that end before the
lookahead are final and leave. What is held doesn't depend on the length of the text. A list that isn't proper has no such bound; its words are held whole.

Texts are cut as the vocabulary file says: special tokens' strings first, then canonical composition, lower case, and runs of letters,
single digits, runs of marks; white space is dropped, and the last symbol of a cut carries the word end. Recurring cuts are encoded
once while a bounded memo holds them.

Decoding concatenates the entries' bytes and turns them into text as they come (:class:`ByteToText` keeps the one to three bytes of a
character that has begun, at most). A file without a decoder, as the word vocabulary, decodes to its entries joined by a space; one with a byte-level decoder to the text itself.

Defined results: a null text has null ids and decodes to null (:func:`digest` takes it as empty); an empty text has no ids; ids that the
file doesn't have are left out in decoding. Rows stay as they are, repeated ones too; other columns are kept, and one that is called like
the result, in whatever case, is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, located, map_slices, only

#: Text that a task handles at a time; the more, the fewer distinct stretches in all.
TEXT_AT_ONCE = 4 << 20


# What the word vocabulary's reader knows of characters newer than unicodedata's 15.1: letters and numbers of Unicode 16, and
# the lower case of capitals up to Unicode 17. Any other unassigned character counts as a mark.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(kind: str, newer) -> str:
    """The characters of a general category, as ranges for a pattern's brackets."""
    ranges: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in (*ranges, *newer))


@lru_cache(maxsize=1)
def _cuts() -> re.Pattern:
    """Short forms, runs of letters, single numbers, runs of what is neither nor blank."""
    letters, numbers = _class("L", _NEW_LETTERS), _class("N", _NEW_NUMBERS)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_BLANK}{letters}{numbers}]+")


_ASCII_CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """A merge list over token ids: ``rank`` holds the place of a pair in the list, ``products`` what is made there."""

    def __init__(self, merges: list[tuple[int, int, int]], lengths: dict[int, int] | None = None):
        self.rank = {(a, b): i for i, (a, b, _) in enumerate(merges)}
        self.products = [made for _, _, made in merges]
        self.merges = merges
        self.length = dict(lengths or {})
        for a, b, made in merges:
            self.length[made] = self.length.get(a, 1) + self.length.get(b, 1)
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        for i, (_, _, made) in enumerate(merges):
            first.setdefault(made, i)
            last[made] = i
        self.proper = len(self.rank) == len(merges) and all(last.get(a, -1) < i and last.get(b, -1) < i for i, (a, b, _) in enumerate(merges))

    def lookahead(self) -> int | None:
        """How many symbols at the end of what was read may yet be cut otherwise; None without a bound (the list isn't proper)."""
        if not self.proper:
            return None
        begins: dict[int, frozenset] = {}  # the tokens with which a token begins, in any way of making it
        reach: dict[int, int] = {}  # the longest chain so far whose last merge has this left part
        made_from: dict[int, list[int]] = {}
        for a, _, made in self.merges:
            made_from.setdefault(made, []).append(a)

        def beginnings(token: int) -> frozenset:
            if token not in begins:
                begins[token] = frozenset({token}.union(*(beginnings(a) for a in made_from.get(token, ()))))
            return begins[token]

        for a, b, _ in self.merges:
            chain = self.length.get(a, 1) + max(reach.get(t, 0) for t in beginnings(b))
            reach[a] = max(reach.get(a, 0), chain)
        return max(reach.values(), default=0)

    def apply(self, symbols: list[int]) -> list[int]:
        """The tokens of ``symbols``: the merge that is first in the list, at its leftmost place, again and again."""
        get, products, never, tokens = self.rank.get, self.products, len(self.products), list(symbols)
        found = [get(pair, never) for pair in zip(tokens, tokens[1:])]
        while found and (best := min(found)) < never:
            i = found.index(best)
            made = tokens[i] = products[best]
            del tokens[i + 1], found[i]
            if i:
                found[i - 1] = get((tokens[i - 1], made), never)
            if i < len(found):
                found[i] = get((made, tokens[i + 1]), never)
        return tokens


class Transducer:
    """Symbols in, final tokens out; holds at most about twice the lookahead. ``feed`` and ``finish`` return the tokens that became final."""

    def __init__(self, merges: Merges, lookahead: int | None):
        self.merges, self.lookahead = merges, lookahead
        self.held: list[int] = []
        self.most = None if lookahead is None else 2 * max(lookahead, 8)

    def feed(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        if self.most is None:
            self.held += symbols
            return out
        for at in range(0, len(symbols), self.most):
            self.held += symbols[at : at + self.most]
            if len(self.held) >= self.most:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        final, end, bound, length = [], 0, len(self.held) - self.lookahead, self.merges.length
        for token in self.merges.apply(self.held):
            after = end + length.get(token, 1)
            if after > bound:
                break
            final.append(token)
            end = after
        del self.held[:end]
        return final

    def finish(self, symbols: list[int] = ()) -> list[int]:
        out = self.feed(list(symbols)) + self.merges.apply(self.held)
        self.held = []
        return out


class ByteToText:
    """Bytes in, text out as soon as its characters are complete; what is no UTF-8 becomes U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            b = data[-back]
            if b & 0xC0 != 0x80:  # the last character's first byte
                if back < (2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0):
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Vocabulary:
    """A byte-level vocabulary with word ends, read from its file."""

    def __init__(self, path: str):
        with open(located(path), encoding="utf-8") as f:
            file = json.load(f)
        model, alphabet = file["model"], byte_alphabet()
        ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges([(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        self.lookahead = self.merges.lookahead()
        self.inner = [ids[c] for c in alphabet]
        self.last = [ids[c + self.end] for c in alphabet]
        #: What each id decodes to, with what comes between two of them.
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.entries: dict[int, bytes] = {}
        self.between = b"" if file.get("decoder") else b" "
        for token, i in ids.items():
            self.entries[i] = bytes(byte_of[c] for c in token) if file.get("decoder") else token.encode()
        for token, i in self.special.items():
            self.entries[i] = token.encode()

    def cuts(self, stretch: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if stretch.isascii():
            return _ASCII_CUTS.findall(stretch.lower())
        # lower() would tell a final sigma apart
        return _cuts().findall(unicodedata.normalize("NFC", stretch).replace("Σ", "σ").translate(_NEW_LOWER).lower())

    def encode_cut(self, word: str) -> list[int]:
        """One word through the transducer, whose last symbol carries the word end."""
        if word in self.special:
            return [self.special[word]]
        data, machine = word.encode(), Transducer(self.merges, self.lookahead)
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if machine.most is None or len(symbols) < machine.most:  # the machine would hold them all to the end
            return self.merges.apply(symbols)
        return machine.feed(symbols[:-1]) + machine.finish(symbols[-1:])


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Worker:
    """A worker's memo of words, and its tables of what ids are written and decoded as."""

    def __init__(self, path: str):
        vocab = self.vocab = _vocabulary(path)
        self.memo = Memo(lambda words: [vocab.encode_cut(w) for w in words], limit=400_000)
        size = max(vocab.entries) + 1
        self.numbers = pa.array([b"%d " % i for i in range(size)], type=pa.binary())
        # An entry that the machine turns into whole characters from its start needs no state.
        texts, self.closed = [], np.ones(size, dtype=bool)
        for i in range(size):
            machine, entry = ByteToText(), vocab.entries.get(i, b"")
            texts.append(machine.feed(entry + vocab.between).encode())
            self.closed[i] = not machine.held and i in vocab.entries and b"\xef\xbf\xbd" not in texts[-1]
        self.texts = pa.array(texts, type=pa.binary())

    def cuts(self, stretch: str) -> list[str]:
        vocab = self.vocab
        if "<|" not in stretch or vocab.split_special is None:
            return vocab.cuts(stretch)
        out: list[str] = []
        for part in vocab.split_special.split(stretch):
            out += [part] if part in vocab.special else vocab.cuts(part)
        return out

    def encode_distinct(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each stretch one after the other, and the bounds of each."""
        words, counts = [], [0]
        for s in stretches:
            found = self.cuts(s)
            words += found
            counts.append(len(found))
        ids, sizes = self.memo.joined(words)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]


def _worker(path: str) -> _Worker:
    return only(("bpe", path), lambda: _Worker(path))


def _stretches(column: pa.Array) -> tuple[pa.ListArray, pa.DictionaryArray]:
    """Each text's stretches between ASCII blanks, lower-cased where that can't hide a special token, and the distinct ones."""
    column = pc.fill_null(column, "")
    special = pc.match_substring(column, "<|")
    lower = pc.ascii_lower(column)
    split = pc.ascii_split_whitespace(pc.if_else(special, column, lower) if pc.any(special).as_py() else lower)
    return split, split.flatten().dictionary_encode()


def encode_lists(column: pa.Array, path: str) -> pa.ListArray:
    """The ids of each text; a null text's are null."""
    worker, (split, coded) = _worker(path), _stretches(column)
    ids, bounds = worker.encode_distinct(coded.dictionary.to_pylist())
    found = coded.indices.to_numpy(zero_copy_only=False)
    size = (bounds[1:] - bounds[:-1])[found]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(bounds[:-1][found] - ends[:-1], size)
    offsets = np.asarray(split.offsets)
    return pa.ListArray.from_arrays(
        pa.array(ends[offsets - offsets[0]].astype(np.int32)), pa.array(ids[at].astype(np.int32, copy=False)), mask=pc.is_null(column)
    )


def decode(ids, path: str) -> str | None:
    """The text of ids, as the file's decoder has it."""
    if ids is None:
        return None
    vocab, machine = _vocabulary(path), ByteToText()
    known = [vocab.entries[i] for i in np.asarray(ids).tolist() if i in vocab.entries]
    out = [machine.feed(e + vocab.between) for e in known[:-1]] + [machine.feed(e) for e in known[-1:]]
    return "".join(out) + machine.finish()


def _with(df: DataFrame, name: str, kind: str):
    """The columns that stay, and the schema with ``name`` behind them."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return kept, df.select(*kept, F.lit(None).cast(kind).alias(name)).schema


def encode_column(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` in ``out_col``."""
    kept, schema = _with(docs, out_col, "array<int>")

    def run(batch):
        return pa.RecordBatch.from_arrays([*(batch[c] for c in kept), encode_lists(batch[text_col], path)], names=[*kept, out_col])

    return map_slices(docs, run, schema, text_col, TEXT_AT_ONCE)


def decode_column(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids_col`` in ``out_col``."""
    kept, schema = _with(encoded, out_col, "string")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decode(x.values.to_numpy() if x.is_valid else None, path) for x in part[ids_col]]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(texts, type=pa.string())], names=[*kept, out_col])

    return encoded.mapInArrow(run, schema)


def _joined(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The concatenated entries of ``table`` for each list of ids."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), table.take(pa.array(ids))), b"")


def _sha256_without_last(joined: pa.Array) -> list[str]:
    """The digest of each value without its last byte."""
    _, offsets, data = joined.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[joined.offset : joined.offset + len(joined) + 1].tolist()
    data = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at, at[1:])]


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space), ``decoded_sha256`` of each row; null counts as empty.

    What distinct stretches of a slice are encoded as, written as and decoded to is put together for each text in Arrow."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch):
        worker, (split, coded) = _worker(path), _stretches(batch["text"])
        if worker.vocab.between != b" " or not worker.closed[list(worker.vocab.entries)].all():
            return plain(batch)
        ids, bounds = worker.encode_distinct(coded.dictionary.to_pylist())
        n = pa.array(np.diff(bounds))
        columns = [batch["doc_id"]]
        offsets = np.asarray(split.offsets)
        offsets = (offsets - offsets[0]).astype(np.int32)
        total = np.concatenate([[0], np.cumsum(n.take(coded.indices).to_numpy(zero_copy_only=False))])
        columns.append(pa.array(np.diff(total[offsets]).astype(np.int64)))
        for table in (worker.numbers, worker.texts):
            texts = _joined(table, ids, bounds).take(coded.indices)
            columns.append(pa.array(_sha256_without_last(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), b"")), type=pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def plain(batch):
        lists = encode_lists(pc.fill_null(batch["text"], ""), path)
        rows = [x.values.to_numpy() for x in lists]
        columns = [
            pa.array([len(x) for x in rows], type=pa.int64()),
            pa.array([hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in rows], type=pa.string()),
            pa.array([hashlib.sha256(decode(x, path).encode()).hexdigest() for x in rows], type=pa.string()),
        ]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    text = F.lit("").alias
    schema = chosen.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), text("ids_sha256"), text("decoded_sha256")).schema
    return map_slices(chosen, run, schema, "text", TEXT_AT_ONCE)
