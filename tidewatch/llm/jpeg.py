"""Media columns: progressive JPEG written from payload bytes, read back by its scans, and turned into RGB tensors.

The format's unit is the quantised coefficient: a payload of 64-byte blocks becomes 8x8 blocks of coefficients (byte less ``ZERO``, in
zigzag order), six to a 16x16 macroblock of a colour image with halved chroma (four Y, one Cb, one Cr), so that every byte is kept. The
file has eight scans: DC of all components with its last bit left out, Y in two spectral bands, Cb and Cr in full with their last bits
left out, and the refinement scans that bring the last bits of Cb, Cr and DC.

The decoder takes any 8-bit Huffman-coded progressive file of one or three components: it accumulates all scans (first and refining, DC and
AC, end-of-band runs, restart intervals) into coefficient arrays, dequantises, inverse-transforms in numpy, repeats chroma samples to
full resolution, and converts to RGB. Entropy-coded data is decoded in lanes: the restart intervals of all images of a batch whose
scans are alike advance together, one symbol a step, by numpy arrays. Lanes are taken in bounded numbers, so working memory beyond the
coefficients stays bounded.

Defined results: a null or empty text has a payload of 64 zero bytes; a null file decodes to nulls; repeated rows are encoded each; an
empty table gives no rows. Other columns are ignored by :func:`encode_column` and kept by :func:`decode_column`.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, texts

#: The byte value whose coefficient is zero.
ZERO = 96
#: Blocks, and macroblocks of the DC scans, between restart markers.
INTERVAL = 8
INTERVAL_DC = 8
#: Macroblocks in a row of the image.
ROW = 1024
#: Restart intervals encoded or decoded together.
LANES = 4096
SLICE = 1 << 20

# Fixed value: the zigzag order of the format, by diagonals.
ZIGZAG = np.array(
    [r * 8 + c for d in range(15) for r, c in ((d - c, c) if d % 2 == 0 else (c, d - c) for c in range(8)) if 0 <= r < 8 and 0 <= c < 8]
)


@dataclass(frozen=True)
class Spec:
    """A scan: components, spectral band, bit positions before and after."""

    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int


SCRIPT = (
    Spec((0, 1, 2), 0, 0, 0, 1),
    Spec((0,), 1, 5, 0, 0),
    Spec((0,), 6, 63, 0, 0),
    Spec((1,), 1, 63, 0, 1),
    Spec((2,), 1, 63, 0, 1),
    Spec((1,), 1, 63, 1, 0),
    Spec((2,), 1, 63, 1, 0),
    Spec((0, 1, 2), 0, 0, 1, 0),
)


# --- Huffman codes ---


#: A run beyond any band.
PAST = 64


class Code:
    """A canonical code from the lengths of its symbols."""

    def __init__(self, lengths: dict[int, int]):
        self.counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
        self.symbols = sorted(lengths, key=lambda s: (lengths[s], s))
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.table = np.zeros(1 << 16, np.int64)  # by the next 16 bits: length * 256 + symbol
        self._assign([(s, lengths[s]) for s in self.symbols])

    def _assign(self, ordered: list[tuple[int, int]]) -> None:
        code, before = 0, 0
        for s, n in ordered:
            code <<= n - before
            self.code[s], self.length[s], before = code, n, n
            self.table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            code += 1

    @cached_property
    def whole(self) -> np.ndarray:
        """By the next 16 bits, where they hold a coefficient's code and its bits: value << 16 | run << 8 | bits; a lone end of
        band has run ``PAST``. Below ``1`` bits: to be read in two steps."""
        length, run, size = self.table >> 8, (self.table >> 4) & 15, self.table & 15
        extra = (np.arange(1 << 16) >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1)
        fits = (length > 0) & (length + size <= 16) & ((size > 0) | (run == 15))
        out = np.where(fits, _extend(extra, size) << 16 | run << 8 | length + size, 0)
        return np.where((length > 0) & (size == 0) & (run == 0), PAST << 8 | length, out)

    @classmethod
    def read(cls, counts: bytes, symbols: bytes) -> Code:
        lengths = [n for n, count in enumerate(counts, 1) for _ in range(count)]
        out = cls.__new__(cls)
        cls.__init__(out, dict(zip(symbols, lengths)))
        if out.symbols != list(symbols):  # same lengths in another order of symbols
            out._assign(list(zip(symbols, lengths)))
        return out


def _own_codes() -> dict[tuple[int, int], Code]:
    """By class (0 DC, 1 AC) and number: DC; AC for first scans (letters have four or five bits, a blank seven); AC for refinements."""
    ends = [r << 4 for r in range(15)]
    first = {s: n for s, n in ((4, 2), (5, 2), (3, 3), (7, 3), (1, 4), (2, 4), (6, 5), (0, 5))}
    first |= {x: 12 for x in [*ends, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))] if x not in first}
    refine = {0: 1, 1: 3} | {r << 4 | 1: 6 for r in range(1, 16)} | {x: 8 for x in [*ends[1:], 0xF0]}
    return {(0, 0): Code({s: 4 for s in range(12)}), (1, 0): Code(first), (1, 1): Code(refine)}


_OWN = _own_codes()
_SIZE = np.array([int(v).bit_length() for v in range(1 << 12)])


# --- writing ---


def _pack(values: np.ndarray, lengths: np.ndarray, interval: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``n`` intervals' codes, each filled up with ones, and each one's number of bytes."""
    bits = np.bincount(interval, weights=lengths, minlength=n).astype(np.int64)
    size = (bits + 7) >> 3
    base = np.cumsum(size) - size
    at = np.cumsum(lengths) - lengths + (base * 8 - (np.cumsum(bits) - bits))[interval]
    byte, window = at >> 3, values << (40 - (at & 7) - lengths)
    total = int(size.sum())
    out = np.zeros(total + 5)
    for j in range(5):
        part = (window >> (32 - 8 * j)) & 255
        if j < 2 or part.any():
            out[j:] += np.bincount(byte, weights=part, minlength=total + 5)[: total + 5 - j]
    fill = np.flatnonzero(size)
    out[base[fill] + size[fill] - 1] += (1 << (size[fill] * 8 - bits[fill])) - 1
    return out[:total].astype(np.uint8), size


def _ac_first(c: np.ndarray, low: int, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and blocks of a band's first scan; ``c``: block x place."""
    n, width = c.shape
    v = np.abs(c) >> low
    at = np.flatnonzero(v.ravel())
    block = at // width
    k = at - block * width
    value = v.ravel()[at].astype(np.int64)
    before = np.concatenate([[-1], k[:-1]])
    before[np.concatenate([[True], block[1:] != block[:-1]])[: len(at)]] = -1
    run = k - before[: len(k)] - 1
    size = _SIZE[value]
    symbol = (run & 15) << 4 | size
    extra = np.where(c.ravel()[at] > 0, value, value ^ ((1 << size) - 1))
    values, lengths = code.code[symbol] << size | extra, code.length[symbol] + size
    if (long := run >> 4).any():
        group = np.repeat(np.arange(len(at)), long + 1)
        final = np.concatenate([group[1:] != group[:-1], [True]])
        values = np.where(final, values[group], code.code[0xF0])
        lengths, block = np.where(final, lengths[group], code.length[0xF0]), block[group]
    ended = np.ones(n, bool)
    ended[at[k == width - 1] // width] = False
    ends = np.flatnonzero(ended)
    place = np.searchsorted(block, ends, side="right")
    return np.insert(values, place, code.code[0]), np.insert(lengths, place, code.length[0]), np.insert(block, place, ends)


def _ac_refine(c: np.ndarray, low: int, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and blocks of a band's refinement by the bit at ``low``."""
    n, width = c.shape
    v = np.abs(c) >> low
    new, old, zero = v == 1, v > 1, v == 0
    # zeros since the last new one, and whether a new one follows
    zeros = np.cumsum(zero, axis=1)
    mark = np.maximum.accumulate(np.where(new, zeros, 0), axis=1)
    since = zeros - mark
    follows = np.flip(np.maximum.accumulate(np.flip(new, axis=1), axis=1), axis=1)
    skip = zero & (since > 0) & (since % 16 == 0) & follows
    event = np.zeros((n, width + 1), bool)
    event[:, :width] = new | skip
    last = np.where(event.any(axis=1), width - np.argmax(event[:, ::-1], axis=1), -1)
    event[:, width] = last < width - 1
    at = np.flatnonzero(event.ravel())
    block, k = np.divmod(at, width + 1)
    is_new = np.zeros(len(at), bool)
    inside = k < width
    flat = block[inside] * width + k[inside]
    is_new[inside] = new.ravel()[flat]
    symbol = np.where(inside, 0xF0, 0)
    run = since.ravel()[np.maximum(flat - 1, 0)] * (k[inside] > 0)  # zeros before it since the last new one
    run = np.where(new.ravel()[np.maximum(flat - 1, 0)] & (k[inside] > 0), 0, run)
    symbol[inside] = np.where(is_new[inside], (run & 15) << 4 | 1, 0xF0)
    sign = np.zeros(len(at), np.int64)
    sign[inside] = c.ravel()[flat] > 0
    values = np.where(is_new, code.code[symbol] << 1 | sign, code.code[symbol])
    lengths = code.length[symbol] + is_new
    fixes = np.flatnonzero(old.ravel())
    fix_block, fix_k = np.divmod(fixes, width)
    owner = np.searchsorted(at, fix_block * (width + 1) + fix_k)
    order = np.argsort(np.concatenate([2 * np.arange(len(at)), 2 * owner + 1]), kind="stable")
    values = np.concatenate([values, v.ravel()[fixes].astype(np.int64) & 1])[order]
    lengths = np.concatenate([lengths, np.ones(len(fixes), np.int64)])[order]
    return values, lengths, np.concatenate([block, fix_block])[order]


def _dc(c: np.ndarray, spec: Spec, component: np.ndarray, interval: np.ndarray, code: Code):
    """Codes and lengths of DC values in scan order."""
    if spec.high:
        return (c >> spec.low) & 1, np.ones(len(c), np.int64)
    v = c >> spec.low
    before = np.zeros(len(v), np.int64)
    for i in np.unique(component):
        of = np.flatnonzero(component == i)
        same = np.concatenate([[False], interval[of][1:] == interval[of][:-1]])
        before[of[same]] = v[of[np.flatnonzero(same) - 1]]
    gap = v - before
    size = _SIZE[np.abs(gap)]
    extra = np.where(gap > 0, gap, np.abs(gap) ^ ((1 << size) - 1))
    return code.code[size] << size | extra, code.length[size] + size


def _scan_data(coefficients: np.ndarray, spec: Spec, order: np.ndarray, component: np.ndarray, starts: np.ndarray, unit: int) -> list[bytes]:
    """Each image's data for a scan; ``order``: blocks of all images in scan order, from ``starts``, ``unit`` to an interval."""
    counts = np.diff(starts)
    within = np.arange(len(order)) - np.repeat(starts[:-1], counts)
    parts = -(-counts // unit)  # intervals of each image
    first = np.cumsum(parts) - parts
    interval = within // unit + np.repeat(first, counts)
    number = np.arange(int(parts.sum())) - np.repeat(first, parts)  # an interval's number in its image
    pieces, sizes = [], []
    for at in range(0, len(number), LANES):
        to = min(len(number), at + LANES)
        a, b = np.searchsorted(interval, [at, to])
        part = coefficients[order[a:b], spec.first : spec.last + 1].astype(np.int64)
        inner = interval[a:b] - at
        if spec.last == 0:
            values, lengths = _dc(part[:, 0], spec, component[a:b], inner, _OWN[0, 0])
            block = np.arange(b - a)
        else:
            values, lengths, block = (_ac_refine if spec.high else _ac_first)(part, spec.low, _OWN[1, min(1, spec.high)])
        data, size = _pack(values, lengths, inner[block], to - at)
        # zero bytes after 255, restart markers between an image's intervals
        ff = data == 255
        markers = np.cumsum(number[at:to] > 0)
        owner = np.repeat(np.arange(to - at), size)
        place = np.arange(len(data)) + np.cumsum(ff) - ff + 2 * markers[owner]
        out = np.zeros(len(data) + int(ff.sum()) + 2 * int(markers[-1]), np.uint8)
        out[place] = data
        begin = place[np.cumsum(size) - size]
        marked = np.flatnonzero(number[at:to] > 0)
        out[begin[marked] - 2], out[begin[marked] - 1] = 255, 0xD0 + (number[at:to][marked] - 1) % 8
        ends = np.concatenate([begin[1:] - 2 * (number[at:to] > 0)[1:], [len(out)]])
        pieces.append(out)
        sizes.append(np.diff(np.concatenate([[0], ends])))
    data, ends = np.concatenate(pieces).tobytes(), np.cumsum(np.concatenate(sizes))
    cuts = [0, *ends[np.cumsum(parts) - 1].tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def _tables() -> bytes:
    codes = b"".join(bytes([kind << 4 | i, *c.counts, *c.symbols]) for (kind, i), c in _OWN.items())
    return _segment(0xDB, bytes([0] + [1] * 64)) + _segment(0xC4, codes)


def _scan_header(spec: Spec) -> bytes:
    body = bytes([len(spec.components)]) + b"".join(bytes([i + 1, min(1, spec.high)]) for i in spec.components)
    restart = _segment(0xDD, struct.pack(">H", INTERVAL_DC if spec.last == 0 else INTERVAL))
    return restart + _segment(0xDA, body + bytes([spec.first, spec.last, spec.high << 4 | spec.low]))


def _grid(m: int) -> tuple[int, int]:
    """Width and height in macroblocks for ``m`` of them."""
    w = min(m, ROW)
    return w, -(-m // w)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload of a positive multiple of 64 bytes."""
    n = np.array([len(p) // 64 for p in payloads])
    grids = [_grid(-(-int(k) // 6)) for k in n]
    total = np.array([w * h * 6 for w, h in grids])
    base = np.cumsum(total) - total
    coefficients = np.zeros((int(total.sum()), 64), np.int16)
    rows = np.repeat(base, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    coefficients[rows] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64).astype(np.int16) - ZERO
    orders: dict[tuple[int, ...], list[np.ndarray]] = {(0,): [], (1,): [], (2,): []}
    for (w, h), b in zip(grids, base.tolist()):
        blocks = b + np.arange(w * h * 6).reshape(h, w, 6)
        orders[0,].append(blocks[:, :, :4].reshape(h, w, 2, 2).transpose(0, 2, 1, 3).ravel())
        orders[1,].append(blocks[:, :, 4].ravel())
        orders[2,].append(blocks[:, :, 5].ravel())
    data = []
    for spec in SCRIPT:
        if spec.last == 0:
            order, starts, unit = np.arange(len(coefficients)), np.concatenate([base, [len(coefficients)]]), 6 * INTERVAL_DC
            component = np.tile([0, 0, 0, 0, 1, 2], len(order) // 6)
        else:
            lists = orders[spec.components]
            order, starts, unit = np.concatenate(lists), np.cumsum([0, *map(len, lists)]), INTERVAL
            component = np.zeros(0)
        data.append(_scan_data(coefficients, spec, order, component, starts, unit))
    headers, tables = [_scan_header(s) for s in SCRIPT], _tables()
    out = []
    for i, ((w, h), k) in enumerate(zip(grids, n.tolist())):
        frame = struct.pack(">BHHB", 8, h * 16, w * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        head = [b"\xff\xd8", _segment(0xFE, b"blocks %d" % k), tables, _segment(0xC2, frame)]
        out.append(b"".join([*head, *(x for header, of in zip(headers, data) for x in (header, of[i])), b"\xff\xd9"]))
    return out


# --- reading ---


@dataclass
class Image:
    height: int
    width: int
    sampling: list[tuple[int, int]]  # horizontal, vertical of each component
    quant: list[np.ndarray]
    comments: list[bytes] = field(default_factory=list)
    scans: list = field(default_factory=list)  # (spec, codes' keys, restart interval, data from, to)
    base: list[int] = field(default_factory=list)  # first block of each component
    shape: list[tuple[int, int]] = field(default_factory=list)  # blocks down and across, with those that fill macroblocks


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


@lru_cache(maxsize=64)
def _code_of(body: bytes) -> Code:
    return Code.read(body[:16], body[16:])


def parse(data: bytes) -> Image:
    """Headers and the places of scans."""
    quant, codes, restart, image, at = {}, {}, 0, None, 2
    ids: list[int] = []
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    comments = []
    while data[at + 1] != 0xD9:
        marker, (n,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = body[1:size]
                body = body[size:]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            comments.append(body)
        elif marker == 0xC2:
            bits, height, width, k = struct.unpack_from(">BHHB", body)
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(k)]
            if bits != 8 or k not in (1, 3):
                raise ValueError("only 8 bits and one or three components")
            ids = [p[0] for p in parts]
            image = Image(height, width, [(p[1] >> 4, p[1] & 15) if k > 1 else (1, 1) for p in parts], [p[2] for p in parts], comments)
        elif marker == 0xDA:
            k = body[0]
            chosen = tuple(ids.index(body[1 + 2 * i]) for i in range(k))
            first, last, bits = body[1 + 2 * k : 4 + 2 * k]
            spec = Spec(chosen, first, last, bits >> 4, bits & 15)
            tables = tuple(codes.get((1, body[2 + 2 * i] & 15) if last else (0, body[2 + 2 * i] >> 4), b"") for i in range(k))
            to = _MARKER.search(data, at).start()
            image.scans.append((spec, tables, restart, at, to))
            at = to
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError(f"not a progressive Huffman-coded file (marker {marker:x})")
    image.quant = [quant[q] for q in image.quant]
    h_max, v_max = (max(s[i] for s in image.sampling) for i in (0, 1))
    across, down = -(-image.width // (8 * h_max)), -(-image.height // (8 * v_max))
    image.shape = [(down * v, across * h) for h, v in image.sampling]
    return image


def _scan_order(image: Image, spec: Spec) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks in the scan's order, their components, and blocks to a macroblock."""
    order, component, unit = _order_of(image.height, image.width, tuple(image.sampling), tuple(image.shape), spec.components)
    return order + image.base[0], component, unit


@lru_cache(maxsize=512)
def _order_of(height: int, width: int, sampling: tuple, shape: tuple, components: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    """:func:`_scan_order` from an image's first block on."""
    base = np.cumsum([0, *(down * across for down, across in shape)])
    grids = [base[i] + np.arange(shape[i][0] * shape[i][1]).reshape(shape[i]) for i in components]
    if len(components) == 1:
        (i,) = components
        h_max, v_max = (max(s[j] for s in sampling) for j in (0, 1))
        h, v = sampling[i]
        down, across = -(-(-(-height * v // v_max)) // 8), -(-(-(-width * h // h_max)) // 8)
        order = grids[0][:down, :across].ravel()
        return order, np.full(len(order), i, np.int8), 1
    parts, component = [], []
    for i, g in zip(components, grids):
        h, v = sampling[i]
        down, across = shape[i][0] // v, shape[i][1] // h
        parts.append(g.reshape(down, v, across, h).transpose(0, 2, 1, 3).reshape(down * across, v * h))
        component += [i] * (h * v)
    order = np.concatenate(parts, axis=1)
    return order.ravel(), np.tile(np.array(component, np.int8), len(order)), len(component)


class _Bits:
    """Lanes of bits over one buffer."""

    def __init__(self, data: np.ndarray):
        b = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.int64)
        self.window = (b[:-4] << 32) | (b[1:-3] << 24) | (b[2:-2] << 16) | (b[3:-1] << 8) | b[4:]

    def at(self, p: np.ndarray) -> np.ndarray:
        """40 bits from each position's byte on, moved so that the position comes first."""
        return (np.take(self.window, p >> 3, mode="clip") << (p & 7)) & 0xFFFFFFFFFF


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((bits >> np.maximum(size - 1, 0)) & 1, bits, bits - (1 << size) + 1) * (size > 0)


def _lanes(datas: list[bytes], counts: list[int], unit: list[int]):
    """The intervals of several images' scan data: buffer without markers and filling; first byte, first block and blocks of each."""
    raw = np.frombuffer(b"".join(datas) + b"\0", np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    follow = raw[ff + 1]
    image_at = np.cumsum([0, *map(len, datas)])
    marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[ff[follow == 0] + 1] = False
    keep[marks], keep[marks + 1], keep[-1] = False, False, False
    starts = np.sort(np.concatenate([image_at[:-1], marks + 2]))
    place = np.cumsum(keep) - keep
    of = np.searchsorted(image_at, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(of, of)
    counts, unit = np.array(counts), np.array(unit)
    first = np.minimum(number * unit[of], counts[of])
    blocks = np.minimum(unit[of], counts[of] - first)
    return raw[keep], place[starts], first + (np.cumsum(counts) - counts)[of], blocks


def _decode_dc(bits: _Bits, p, at, n, order, component, spec: Spec, codes, coefficients) -> None:
    pred = np.zeros((len(p), int(component.max()) + 1 if len(component) else 1), np.int64)
    lookup = {c: code for c, code in zip(spec.components, codes)}
    for step in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > step)
        block, comp = order[at[on] + step], component[at[on] + step]
        x = bits.at(p[on])
        if spec.high:
            coefficients[block, 0] |= ((x >> 39) << spec.low).astype(np.int16)
            p[on] += 1
            continue
        found = np.zeros(len(on), np.int64)
        for c, code in lookup.items():
            mine = comp == c
            found[mine] = code.table[x[mine] >> 24]
        length, size = found >> 8, found & 255
        extra = (x >> (40 - length - size)) & ((1 << size) - 1)
        pred[on, comp] += _extend(extra, size)
        p[on] += length + size
        coefficients[block, 0] = pred[on, comp] << spec.low


def _decode_ac_first(bits: _Bits, p, at, n, order, spec: Spec, code: Code, flat) -> None:
    end = at + n
    on = np.flatnonzero(n > 0)
    p, at, end = p[on], at[on], end[on]
    k, base = np.full(len(p), spec.first), order[at] * 64
    whole = code.whole
    while len(p):
        x = bits.at(p)
        found = whole[x >> 24]
        size = found & 255
        p += size
        k += (found >> 8) & 255
        ends = 1  # blocks that an end of band ends
        if not size.all():
            w = np.flatnonzero(size == 0)
            short = code.table[x[w] >> 24]
            length, run, more = short >> 8, (short >> 4) & 15, short & 15
            finish = more == 0
            more = np.where(finish, run, more)
            extra = (x[w] >> (40 - length - more)) & ((1 << more) - 1)
            p[w] += length + more
            k[w] += np.where(finish, PAST, run)
            found[w] = np.where(finish, 0, _extend(extra, more)) << 16
            ends = np.ones(len(p), np.int64)
            ends[w] = np.where(finish, (1 << run) + extra, 1)
        inside = k <= spec.last
        value = (found >> 16) << spec.low
        if inside.all():
            flat[base + k] = value  # a run of 16 zeros puts one more zero
        else:
            w = np.flatnonzero(inside)
            flat[base[w] + k[w]] = value[w]
        k += 1
        over = k > spec.last
        if over.any():
            w = np.flatnonzero(over)
            at[w] += ends if np.isscalar(ends) else ends[w]
            k[w] = spec.first
            stay = at < end
            if stay.all():
                base[w] = order[at[w]] * 64
            else:
                p, at, end, k = p[stay], at[stay], end[stay], k[stay]
                base = order[at] * 64


def _decode_ac_refine(bits: _Bits, p, at, n, order, spec: Spec, code: Code, flat) -> None:
    end = at + n
    on = np.flatnonzero(n > 0)
    p, at, end = p[on], at[on], end[on]
    k, base = np.full(len(p), spec.first), order[at] * 64
    ask = np.ones(len(p), bool)  # needs a symbol
    run, value, band = (np.zeros(len(p), np.int64) for _ in range(3))  # zeros to pass, what to put then, blocks to end
    one = 1 << spec.low
    while len(p):
        if ask.any():
            w = np.flatnonzero(ask)
            x = bits.at(p[w])
            found = code.table[x >> 24]
            length, r, size = found >> 8, (found >> 4) & 15, found & 15
            finish = (size == 0) & (r < 15)
            more = np.where(finish, r, size)
            extra = (x >> (40 - length - more)) & ((1 << more) - 1)
            p[w] += length + more
            band[w] = np.where(finish, (1 << r) + extra, 0)
            run[w], value[w] = r, np.where(size > 0, np.where(extra > 0, one, -one), 0)
            ask[w] = False
        c = flat[base + k]
        was = c != 0
        w = np.flatnonzero(was)
        if len(w):
            bit = (bits.at(p[w]) >> 39) & 1
            p[w] += 1
            old = c[w]
            flat[base[w] + k[w]] = np.where((bit == 1) & ((np.abs(old) & one) == 0), old + np.sign(old) * one, old)
        w = np.flatnonzero(~was & (band == 0))
        if len(w):
            reached = run[w] == 0
            put = w[reached]
            flat[base[put] + k[put]] = value[put]
            ask[put] = True
            run[w] -= 1
        k += 1
        over = k > spec.last
        if over.any():
            w = np.flatnonzero(over)
            at[w] += 1
            k[w] = spec.first
            band[w] = np.maximum(band[w] - 1, 0)
            ask[w] = band[w] == 0
            stay = at < end
            if not stay.all():
                p, at, end, k, base, ask, run, value, band = (y[stay] for y in (p, at, end, k, base, ask, run, value, band))
            base = order[at] * 64


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Headers, and the coefficients of all images' blocks (zigzag order) accumulated from all scans."""
    images, total = [parse(f) for f in files], 0
    for image in images:
        for down, across in image.shape:
            image.base.append(total)
            total += down * across
    coefficients = np.zeros((total, 64), np.int16)
    for number in range(max((len(i.scans) for i in images), default=0)):
        groups: dict = {}
        for i, image in enumerate(images):
            if number < len(image.scans):
                groups.setdefault(image.scans[number][:2], []).append(i)
        for (spec, tables), members in groups.items():
            parts = [_scan_order(images[i], spec) for i in members]
            scans = [images[i].scans[number] for i in members]
            units = [s[2] * x[2] if s[2] else len(x[0]) for s, x in zip(scans, parts)]
            data, first_byte, first, blocks = _lanes([files[i][s[3] : s[4]] for i, s in zip(members, scans)], [len(x[0]) for x in parts], units)
            order, component = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            bits, codes = _Bits(data), [_code_of(t) if t else None for t in tables]
            for a in range(0, len(first), LANES):
                lanes = (first_byte[a : a + LANES] * 8, first[a : a + LANES].copy(), blocks[a : a + LANES])
                if spec.last == 0:
                    _decode_dc(bits, *lanes, order, component, spec, codes, coefficients)
                else:
                    (_decode_ac_refine if spec.high else _decode_ac_first)(bits, *lanes, order, spec, codes[0], coefficients.reshape(-1))
    return images, coefficients


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Zigzag coefficients to samples."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(one, one)[ZIGZAG].astype(np.float32)


def tensor(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Height x width x 3 of RGB, or of equal values for one component."""
    h_max, v_max = (max(s[i] for s in image.sampling) for i in (0, 1))
    planes = []
    for (down, across), base, quant, (h, v) in zip(image.shape, image.base, image.quant, image.sampling):
        samples = (coefficients[base : base + down * across] * quant) @ _basis()
        plane = samples.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        if v < v_max:
            plane = np.repeat(plane, v_max // v, axis=0)
        if h < h_max:
            plane = np.repeat(plane, h_max // h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    for i, c in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(c), 0, 255)
    return out


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The payload of a file from :func:`encode`."""
    n = int(next(c for c in image.comments if c.startswith(b"blocks "))[7:])
    (down, across), blocks = image.shape[1], []
    for i, (h, v) in enumerate(image.sampling):
        of = coefficients[image.base[i] : image.base[i] + down * across * h * v]
        blocks.append(of.reshape(down, v, across, h, 64).transpose(0, 2, 1, 3, 4).reshape(down * across, h * v, 64))
    return (np.concatenate(blocks, axis=1).reshape(-1, 64)[:n] + ZERO).astype(np.uint8).tobytes()


# --- columns ---


def padded(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (of the text) and ``media``, the file."""

    def run(batch):
        values = texts(batch)
        sizes = [len((t or "").encode()) for t in values]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, type=pa.int64()), pa.array(encode([padded(t) for t in values]), type=pa.binary())], names=["doc_id", "n_bytes", "media"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = chosen.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("media")).schema
    return map_slices(chosen, run, schema, limit=SLICE)


def decode_column(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with ``height``, ``width`` and ``rgb``, the full-resolution tensor's bytes in row order, all null where there is no file.
    Columns that have one of these names are replaced."""
    new = ("height", "width", "rgb")
    kept = [c for c in media.columns if c.lower() not in new or c == media_col]
    if media_col.lower() in new:
        raise ValueError(f"the column of files can't be called {media_col}")

    def run(batch):
        files = batch[media_col].to_pylist()
        there = [f for f in files if f is not None]
        images, coefficients = read(there) if there else ([], None)
        found = iter([(i.height, i.width, tensor(i, coefficients).tobytes()) for i in images])
        rows = [(None, None, None) if f is None else next(found) for f in files]
        added = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *added], names=[*kept, *new])

    types = ("int", "int", "binary")
    schema = media.select(*kept, *(F.lit(None).cast(t).alias(c) for c, t in zip(new, types))).schema
    return map_slices(media.select(*kept), run, schema, media_col, limit=SLICE)


def feature(rgb: np.ndarray) -> str:
    """Size, channel means and deviations."""
    flat = rgb.reshape(-1, 3)
    mean = flat.sum(axis=0, dtype=np.int64) / len(flat)
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64) / len(flat)
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(f"{x:.3f}" for x in [*mean, *deviation])


def digest(media: DataFrame) -> DataFrame:
    """From :func:`encode_column`'s rows, what their files hold when read back."""

    def run(batch):
        files = batch["media"].to_pylist()
        images, coefficients = read(files)
        payloads = [payload_of(i, coefficients) for i in images]
        columns = [
            pa.array([len(p) for p in payloads], type=pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-64:]) for p in payloads], type=pa.int64()),
            pa.array([len(f) for f in files], type=pa.int64()),
            pa.array([hashlib.sha256(f).hexdigest() for f in files]),
            pa.array([feature(tensor(i, coefficients)) for i in images]),
        ]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    long, text = F.lit(0).cast("long"), F.lit("")
    schema = media.select("doc_id", "n_bytes", long.alias("payload_bytes"), text.alias("payload_sha256"), long.alias("tail_crc32"), long.alias("media_bytes"), text.alias("media_sha256"), text.alias("feature")).schema
    return map_slices(media, run, schema, "media", limit=SLICE)
