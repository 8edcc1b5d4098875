"""Operator 4, media columns: lossless WebP.

``decode`` reads any VP8L stream in its RIFF container: simple and normal prefix codes, several code groups, colour
cache, back-references with the plane distance codes, and the inverse predictor, cross-colour, subtract-green and
palette transforms; it returns an array of pixels (height, width, 4) in RGBA order.

``encode`` stores bytes as RGB pixels, 192 a row, as an encoder of the format does. By the entropies of their histograms each
picture takes the cheapest of: pixels as they are, less green, predicted, predicted less green, or a palette. Predicted
pictures get a mode and cross-colour factors for each tile. Equal runs of three pixels or more are back-references; what is
left are literals or hits in a colour cache, where the cache pays; five prefix codes are made from the picture's own
symbols, in one group. All choices go by whole numbers of the picture alone, so equal bytes have equal files, and a worker
can treat many pictures together. Pictures have 16384 rows at most; longer payloads are several files one after the other.

The query's defined results: null text is empty; an empty text is one row of bytes 255. Repeated rows are stored each.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, slices, spans, store, task, utf8

WIDTH, ROWS = 192, 16384
UNIT = 3 * WIDTH

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PLANE = (
    "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 "
    "2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 "
    "2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 "
    "7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
)
PLANE_CODES = tuple(tuple(map(int, p.split(","))) for p in PLANE.split())
CACHE_MULTIPLIER = 0x1E35A7BD
DEEPEST = 15


def _windows(raw: np.ndarray) -> np.ndarray:
    """60 bits from each byte on, for all but the last seven."""
    wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").reshape(-1)
    return (wide & np.uint64((1 << 60) - 1)).astype(np.int64)


class Bits:
    """Reads a byte string from its lowest bits on, 53 at most at once."""

    def __init__(self, data: bytes, at: int = 0):
        self.at = at
        raw = np.frombuffer(data + b"\0" * 16, np.uint8)
        self.windows = _windows(raw).tolist()

    def peek(self, n: int) -> int:
        return self.windows[self.at >> 3] >> (self.at & 7) & (1 << n) - 1

    def read(self, n: int) -> int:
        x = self.windows[self.at >> 3] >> (self.at & 7) & (1 << n) - 1
        self.at += n
        return x


class Code:
    """A canonical prefix code: for each window as long as its longest word, the symbol and its length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only, self.depth = None, 0
        if len(used) <= 1:
            self.only = int(used[0]) if len(used) else 0
            self.symbol, self.length = np.array([self.only]), np.zeros(1, np.int64)
            return
        own = lengths[used].astype(np.int64)
        rank = np.argsort(own, kind="stable")
        used, own = used[rank], own[rank]
        self.depth = int(own[-1])
        spans = 1 << (self.depth - own)
        if spans.sum() != 1 << self.depth:
            raise ValueError("incomplete or oversubscribed prefix code")
        back = _reversed()[: 1 << DEEPEST : 1 << (DEEPEST - self.depth)]
        self.symbol, self.length = np.empty(len(back), np.int64), np.empty(len(back), np.int64)
        self.symbol[back], self.length[back] = np.repeat(used, spans), np.repeat(own, spans)

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        w = bits.peek(self.depth)
        bits.at += int(self.length[w])
        return int(self.symbol[w])

    def table(self, shift: int) -> np.ndarray:
        """For each window the symbol from bit 6 + shift on, and the length below."""
        return self.symbol << (6 + shift) | self.length


@lru_cache(1)
def _reversed() -> np.ndarray:
    """All 15-bit windows in the order of their codes, whose first bit is a window's lowest."""
    x, out = np.arange(1 << DEEPEST), np.zeros(1 << DEEPEST, np.int64)
    for _ in range(DEEPEST):
        out, x = out << 1 | x & 1, x >> 1
    return out


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(max(size, 256), np.uint8)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    inner = np.zeros(19, np.uint8)
    for k in range(bits.read(4) + 4):
        inner[LENGTH_ORDER[k]] = bits.read(3)
    code = _small(inner.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table, mask, windows, pos = code.table(0).tolist(), (1 << code.depth) - 1, bits.windows, bits.at
    got: list[int] = []
    last = 8
    while len(got) < size and left > 0:
        left -= 1
        w = windows[pos >> 3] >> (pos & 7)
        x = table[w & mask]
        w >>= x & 63
        pos += x & 63
        x >>= 6
        if x < 16:
            got.append(x)
            last = x or last
        elif x == 16:
            got += [last] * (3 + (w & 3))
            pos += 2
        elif x == 17:
            got += [0] * (3 + (w & 7))
            pos += 3
        else:
            got += [0] * (11 + (w & 127))
            pos += 7
    if len(got) > size:
        raise ValueError("code lengths run over")
    bits.at = pos
    lengths[: len(got)] = got
    return Code(lengths)


@lru_cache(256)
def _small(lengths: bytes) -> Code:
    """The code of code lengths; few differ."""
    return Code(np.frombuffer(lengths, np.uint8))


class Picture:
    """What precedes the pixels of a picture, main or inner: transforms, cache, code groups; then its pixels."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.bits, self.width, self.height = bits, width, height
        self.transforms: list[tuple] = []
        while main and bits.read(1):
            kind = bits.read(2)
            if kind in (0, 1):
                size = bits.read(3) + 2
                self.transforms.append((kind, self.width, size, inner(bits, _tiles(self.width, size), _tiles(height, size))))
            elif kind == 2:
                self.transforms.append((kind, self.width))
            else:
                n = bits.read(8) + 1
                table = inner(bits, n, 1).reshape(n)
                channels = table.view(np.uint8).reshape(n, 4).cumsum(0, dtype=np.uint8)
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((kind, self.width, pack, np.ascontiguousarray(channels).view(np.uint32).reshape(n)))
                self.width = _tiles(self.width, pack)
        self.cache = bits.read(4) if bits.read(1) else 0
        if self.cache > 11:
            raise ValueError("colour cache over 11 bits")
        self.tile, self.groups_at, n = 0, None, 1
        if main and bits.read(1):
            self.tile = bits.read(3) + 2
            self.groups_at = (inner(bits, _tiles(self.width, self.tile), _tiles(height, self.tile)) >> 8 & 0xFFFF).astype(np.int64)
            n = int(self.groups_at.max()) + 1
        sizes = (256 + 24 + ((1 << self.cache) if self.cache else 0), 256, 256, 256, 40)
        self.groups = [[read_code(bits, s) for s in sizes] for _ in range(n)]

    @property
    def simple(self) -> bool:
        """Whether there is one group, and one alpha."""
        return self.groups_at is None and self.groups[0][3].only is not None

    def pixels(self) -> np.ndarray:
        """(height, width) of 0xAARRGGBB, before the transforms are undone."""
        if self.simple:
            return self.opaque()
        bits, width, total = self.bits, self.width, self.width * self.height
        out = [0] * total
        cache, shift = ([0] * (1 << self.cache), 32 - self.cache) if self.cache else (None, 0)
        at = noted = 0
        while at < total:
            group = self.groups[0] if self.groups_at is None else self.groups[self.groups_at[at // width >> self.tile, at % width >> self.tile]]
            s = group[0].read(bits)
            if s < 256:
                red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
                out[at] = alpha << 24 | red << 16 | s << 8 | blue
                at += 1
            elif s < 280:
                n = _prefixed(bits, s - 256)
                d = _prefixed(bits, group[4].read(bits))
                if d > 120:
                    d -= 120
                else:
                    x, y = PLANE_CODES[d - 1]
                    d = max(1, x + y * width)
                if d > at or at + n > total:
                    raise ValueError("back-reference out of the picture")
                for _ in range(n):
                    out[at] = out[at - d]
                    at += 1
            else:
                while noted < at:
                    cache[out[noted] * CACHE_MULTIPLIER >> shift & (1 << self.cache) - 1] = out[noted]
                    noted += 1
                out[at] = cache[s - 280]
                at += 1
        return np.array(out, np.uint32).reshape(self.height, width)

    def opaque(self) -> np.ndarray:
        """As pixels, for one group whose alpha is the same everywhere: a literal is three lookups in one window."""
        bits, width, total = self.bits, self.width, self.width * self.height
        at, windows = bits.at, bits.windows
        codes = self.groups[0]
        alpha = codes[3].only << 24
        greens, reds, blues = codes[0].table(8).tolist(), codes[1].table(16).tolist(), (codes[2].table(0) + (alpha << 6)).tolist()
        green, red, blue = len(greens) - 1, len(reds) - 1, len(blues) - 1
        far, literal, held, shift = codes[4], 256 << 14, 280 << 14, 32 - self.cache
        cache = [0] * (1 << self.cache) if self.cache else None
        out: list[int] = []
        add = out.append
        while len(out) < total:
            for _ in range(total - len(out)):
                w = windows[at >> 3] >> (at & 7)
                x = greens[w & green]
                if x < literal:
                    w >>= x & 63
                    r = reds[w & red]
                    x += r + blues[w >> (r & 63) & blue]
                    at += x & 63
                    x >>= 6
                    add(x)
                    if cache:
                        cache[(x * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = x
                elif x >= held:
                    at += x & 63
                    add(cache[(x >> 14) - 280])
                else:
                    break
            else:
                break
            bits.at = at + (x & 63)
            n = _prefixed(bits, (x >> 14) - 256)
            d = _prefixed(bits, far.read(bits))
            at, done = bits.at, len(out)
            if d > 120:
                d -= 120
            else:
                x, y = PLANE_CODES[d - 1]
                d = max(1, x + y * width)
            if d > done or done + n > total:
                raise ValueError("back-reference out of the picture")
            new = out[done - d : done - d + n] if d >= n else (out[-d:] * (n // d + 1))[:n]
            out += new
            if cache:
                for x in new:
                    cache[(x * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = x
        bits.at = at
        return np.array(out, np.uint32).reshape(self.height, width)


def _tables(lengths: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code.table of each row of code lengths, one after the other: entries, where each row's begin, and its windows' mask."""
    used = (lengths > 0).sum(1)
    depth = np.where(used > 1, lengths.max(1), 0).astype(np.int64)
    begin = np.cumsum(1 << depth) - (1 << depth)
    out = np.zeros(int((1 << depth).sum()), np.int32)
    alone = np.flatnonzero(used == 1)
    out[begin[alone]] = np.argmax(lengths[alone] > 0, 1) << (6 + shift)
    row, symbol = np.nonzero(lengths * (used > 1)[:, None])
    n = lengths[row, symbol].astype(np.int64)
    order = np.argsort(row << 4 | n, kind="stable")
    row, symbol, n = row[order], symbol[order], n[order]
    span = 1 << (depth[row] - n)
    if (np.bincount(row, weights=span, minlength=len(lengths)) != np.where(used > 1, 1 << depth, 0)).any():
        raise ValueError("incomplete or oversubscribed prefix code")
    entry, own = np.repeat(symbol << (6 + shift) | n, span), np.repeat(row, span)
    first = np.cumsum(np.where(used > 1, 1 << depth, 0)) - np.where(used > 1, 1 << depth, 0)
    nth = np.arange(len(entry)) - first[own]
    out[begin[own] + _reversed()[nth << (DEEPEST - depth[own])]] = entry
    return out, begin, (1 << depth) - 1


def _code_lengths_at(window: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """read_code for many streams at once: their code lengths, for alphabets of these sizes; moves at."""

    def read(rows: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        x = window[at[rows] >> 3] >> (at[rows] & 7) & (1 << n) - 1
        at[rows] += n
        return x

    every = np.arange(len(at))
    lengths = np.zeros((len(at), max(256, int(size.max()))), np.uint8)
    simple = read(every, 1) == 1
    a, b = every[simple], every[~simple]
    two = read(a, 1) == 1
    wide = read(a, 1) == 1
    lengths[a, read(a, np.where(wide, 8, 1))] = 1
    lengths[a[two], read(a[two], 8)] = 1
    if not len(b):
        return lengths
    stated = read(b, 4) + 4
    inner = np.zeros((len(b), 19), np.uint8)
    for k, x in enumerate(LENGTH_ORDER):
        more = stated > k
        inner[more, x] = read(b[more], 3)
    table, begin, mask = _tables(inner, 0)
    left = np.full(len(b), 1 << 30)
    bound = np.flatnonzero(read(b, 1))
    left[bound] = 2 + read(b[bound], 2 + 2 * read(b[bound], 3))
    k, put, last = np.arange(len(b)), np.zeros(len(b), np.int64), np.full(len(b), 8)
    place, limit = at[b], size[b]
    while len(k):
        p = place[k]
        w = window[p >> 3] >> (p & 7)
        x = table[begin[k] + (w & mask[k])].astype(np.int64)
        w >>= x & 63
        p += x & 63
        x >>= 6
        here = put[k]
        run = x >= 16
        plain = ~run
        r, v = k[plain], x[plain]
        lengths[b[r], here[plain]] = v
        last[r] = np.where(v > 0, v, last[r])
        count = np.ones(len(k), np.int64)
        if run.any():
            extra = np.where(x == 16, 2, np.where(x == 17, 3, 7))
            count = np.where(run, np.where(x == 18, 11, 3) + (w & (1 << extra) - 1), 1)
            p += np.where(run, extra, 0)
            if (here + count > limit[k]).any():
                raise ValueError("code lengths run over")
            same = np.flatnonzero(x == 16)
            for j in range(6 if len(same) else 0):
                m = same[count[same] > j]
                lengths[b[k[m]], here[m] + j] = last[k[m]]
        place[k] = p
        put[k] += count
        left[k] -= 1
        k = k[(put[k] < limit[k]) & (left[k] > 0)]
    at[b] = place
    return lengths


#: Pictures of a batch that are decoded one by one: those of the most pixels, for which the others would wait.
ALONE = 40
#: Bytes of files that are decoded together.
DECODED_BYTES = 6_000_000


def together(streams: list[tuple[int, int, bytes]]) -> list[np.ndarray | None]:
    """Pixels of streams (width, height, data) without transforms, of one group and one alpha; None for others and for the
    largest. All take a step for a code's length, and then for a pixel, at once."""
    found: list[np.ndarray | None] = [None] * len(streams)
    ranked = sorted(range(len(streams)), key=lambda k: -streams[k][0] * streams[k][1])[ALONE:]
    ranked = [k for k in ranked if not streams[k][2][0] & 1]
    if not ranked:
        return found
    begin = np.cumsum([0, *(len(streams[k][2]) + 16 for k in ranked[:-1])])
    window = _windows(np.frombuffer(b"".join(streams[k][2] + b"\0" * 16 for k in ranked), np.uint8))
    first = np.array([streams[k][2][0] for k in ranked]) >> 1
    bits = np.where(first & 1, first >> 1 & 15, 0)
    if (bits > 11).any():
        raise ValueError("colour cache over 11 bits")
    place = 8 * begin + np.where(first & 1, 6, 2)
    one = (window[place >> 3] >> (place & 7) & 1) == 0
    place, bits, ranked = place[one] + 1, bits[one], [k for k, x in zip(ranked, one.tolist(), strict=True) if x]
    if not ranked:
        return found
    lengths = [_code_lengths_at(window, place, np.full(len(place), x) if x else 280 + np.where(bits > 0, 1 << bits, 0)) for x in (0, 256, 256, 256, 40)]
    one = (lengths[3] > 0).sum(1) <= 1
    place, bits, ranked = place[one], bits[one], [k for k, x in zip(ranked, one.tolist(), strict=True) if x]
    if not ranked:
        return found
    (green, g0, g1), (red, r0, r1), (blue, b0, b1), (far, f0, f1) = (_tables(lengths[c][one], k) for c, k in ((0, 8), (1, 16), (2, 0), (4, 0)))
    b_alpha = np.argmax(lengths[3][one] > 0, 1) << 24
    total, width = np.array([streams[k][0] * streams[k][1] for k in ranked]), np.array([streams[k][0] for k in ranked])
    size = 1 << bits
    shift, c0 = 32 - bits, np.cumsum(size) - size
    cache = np.zeros(int(size.sum()), np.int64)
    o0 = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint32)
    left, back = np.zeros(len(total), np.int64), np.zeros(len(total), np.int64)
    plane = np.array(PLANE_CODES)
    copying = False

    def prefixed(at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        more = window[at >> 3] >> (at & 7) & (1 << extra) - 1
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + more + 1), at + extra

    for t, n in zip(range(int(total[0])), np.searchsorted(-total, -np.arange(total[0]), "left").tolist(), strict=True):
        at = place[:n]
        w = window[at >> 3] >> (at & 7)
        x = green[g0[:n] + (w & g1[:n])].astype(np.int64)
        w >>= x & 63
        r = red[r0[:n] + (w & r1[:n])]
        w >>= r & 63
        v = x + r + blue[b0[:n] + (w & b1[:n])]
        step = v & 63
        v >>= 6
        v += b_alpha[:n]
        other = x >= 256 << 14
        if copying:
            other |= left[:n] > 0
        k = np.flatnonzero(other)
        if len(k):
            symbol, move = x[k] >> 14, x[k] & 63
            fresh = left[k] == 0
            hit = fresh & (symbol >= 280)
            h = k[hit]
            v[h] = cache[c0[h] + symbol[hit] - 280]
            move[~fresh] = 0
            begun = fresh & ~hit
            j = k[begun]
            if len(j):
                many, to = prefixed(at[j] + move[begun], symbol[begun] - 256)
                f = far[f0[j] + (window[to >> 3] >> (to & 7) & f1[j])].astype(np.int64)
                d, to = prefixed(to + (f & 63), f >> 6)
                near = plane[np.minimum(d, len(plane)) - 1]
                d = np.where(d > len(plane), d - len(plane), np.maximum(1, near[:, 0] + near[:, 1] * width[j]))
                if (d > t).any() or (t + many > total[j]).any():
                    raise ValueError("back-reference out of the picture")
                left[j], back[j], move[begun] = many, d, to - at[j]
            c = k[~hit]
            v[c] = out[o0[c] + t - back[c]]
            left[c] -= 1
            copying = bool(left[k].any())
            step[k] = move
        at += step
        out[o0[:n] + t] = v
        cache[c0[:n] + ((v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift[:n])] = v
    for k, a, b in zip(ranked, o0.tolist(), total.tolist(), strict=True):
        found[k] = out[a : a + b].reshape(streams[k][1], streams[k][0])
    return found


def _tiles(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def inner(bits: Bits, width: int, height: int) -> np.ndarray:
    return Picture(bits, width, height, False).pixels()


def _prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _bytes(p: np.ndarray) -> np.ndarray:
    """(…,) of 0xAARRGGBB as (…, 4) in the order blue, green, red, alpha."""
    return np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4)


def undo_predictor(p: np.ndarray, size: int, modes: np.ndarray) -> np.ndarray:
    height, width = p.shape
    v = _bytes(p).astype(int).tolist()
    mode = (modes >> 8 & 15).tolist()

    def mean(a, b):
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    def clamp(x):
        return 0 if x < 0 else 255 if x > 255 else x

    def select(left, top, corner):
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top

    for y in range(height):
        row, above = v[y], v[y - 1]
        for x in range(width):
            if y == 0:
                guess = row[x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = above[0]
            else:
                left, top, corner = row[x - 1], above[x], above[x - 1]
                ahead = above[x + 1] if x + 1 < width else row[0]
                m = mode[y >> size][x >> size]
                if m == 0 or m > 13:
                    guess = [0, 0, 0, 255]
                elif m < 5:
                    guess = (left, top, ahead, corner)[m - 1]
                elif m == 5:
                    guess = mean(mean(left, ahead), top)
                elif m < 10:
                    guess = mean(*((left, corner), (left, top), (corner, top), (top, ahead))[m - 6])
                elif m == 10:
                    guess = mean(mean(left, corner), mean(top, ahead))
                elif m == 11:
                    guess = select(left, top, corner)
                elif m == 12:
                    guess = [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
                else:
                    guess = [clamp(a + int((a - c) / 2)) for a, c in zip(mean(left, top), corner, strict=True)]
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess, strict=True)]
    return np.array(v, np.uint8).view(np.uint32).reshape(height, width)


def undo_cross_colour(p: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    height, width = p.shape
    f = _bytes(np.repeat(np.repeat(factors, 1 << size, 0)[:height], 1 << size, 1)[:, :width]).view(np.int8).astype(np.int32)
    v = _bytes(p).copy()
    green = v[..., 1].view(np.int8).astype(np.int32)
    red = v[..., 2] + (f[..., 0] * green >> 5)
    blue = v[..., 0] + (f[..., 1] * green >> 5)
    red = red.astype(np.uint8)
    blue = blue + (f[..., 2] * red.view(np.int8).astype(np.int32) >> 5)
    v[..., 2], v[..., 0] = red, blue.astype(np.uint8)
    return v.view(np.uint32).reshape(height, width)


def undo(picture: Picture, p: np.ndarray) -> np.ndarray:
    for kind, width, *rest in reversed(picture.transforms):
        if kind == 0:
            p = undo_predictor(p, *rest)
        elif kind == 1:
            p = undo_cross_colour(p, *rest)
        elif kind == 2:
            v = _bytes(p).copy()
            v[..., 0] += v[..., 1]
            v[..., 2] += v[..., 1]
            p = v.view(np.uint32).reshape(p.shape)
        else:
            pack, table = rest
            index = p >> 8 & 255
            if pack:
                step = 8 >> pack
                parts = index[:, :, None] >> (np.arange(1 << pack, dtype=np.uint32) * step) & ((1 << step) - 1)
                index = parts.reshape(len(p), -1)[:, :width]
            wide = np.zeros(256, np.uint32)
            wide[: len(table)] = table
            p = wide[index]
    return p


def _chunk(blob: bytes, at: int = 0) -> tuple[int, int, int]:
    """Begin and end of the VP8L data of the file at this place, and the file's end."""
    riff, size, webp, kind, length = struct.unpack_from("<4sI4s4sI", blob, at)
    if (riff, webp, kind) != (b"RIFF", b"WEBP", b"VP8L"):
        raise ValueError("no lossless WebP file")
    return at + 20, at + 20 + length, at + 8 + size


def _size(blob: bytes, at: int) -> tuple[int, int]:
    if blob[at] != 0x2F:
        raise ValueError("no lossless WebP data")
    x = int.from_bytes(blob[at + 1 : at + 5], "little")
    if x >> 29:
        raise ValueError("unknown version")
    return (x & 0x3FFF) + 1, (x >> 14 & 0x3FFF) + 1


def _stream(blob: bytes, at: int = 0) -> tuple[tuple[int, int, bytes], int]:
    """Width, height and the data after them of the file at this place, and the file's end."""
    begin, end, after = _chunk(blob, at)
    return (*_size(blob, begin), blob[begin + 5 : end]), after


def _read(width: int, height: int, data: bytes) -> np.ndarray:
    picture = Picture(Bits(data), width, height, True)
    return undo(picture, picture.pixels())


def decode(blob: bytes) -> np.ndarray:
    """Pixels (height, width, 4) in RGBA order of a file."""
    return _bytes(_read(*_stream(blob)[0]))[..., [2, 1, 0, 3]]


def huffman(weights: dict[int, int], deepest: int) -> dict[int, int]:
    """Code length of each symbol, for two symbols or more. Where a code gets too deep, small weights are raised."""
    ranked = sorted((w, s) for s, w in weights.items())
    n, floor = len(ranked), 1
    while True:
        w = [max(x, floor) for x, _ in ranked]
        up, leaf, node = [0] * (2 * n - 1), 0, n
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= k or w[leaf] <= w[node]):
                    least, leaf = leaf, leaf + 1
                else:
                    least, node = node, node + 1
                total += w[least]
                up[least] = k
            w.append(total)
        deep = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            deep[k] = deep[up[k]] + 1
        if max(deep[:n]) <= deepest:
            return {s: d for (_, s), d in zip(ranked, deep, strict=False)}
        floor *= 2


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Code words with their first bit lowest."""
    back, at, words = _mirror(), 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        words[s] = back[at]
        at += 1 << (DEEPEST - n)
    return words


@lru_cache(1)
def _mirror() -> list[int]:
    return _reversed().tolist()


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as symbols of the code-length alphabet: (symbol, extra bits, their value)."""
    out = []
    for x, same in groupby(lengths):
        left = len(list(same))
        if x:
            out.append((x, 0, 0))
            left -= 1
        while left >= 3:
            take = min(left, 6 if x else 138)
            out.append((16, 2, take - 3) if x else (17, 3, take - 3) if take < 11 else (18, 7, take - 11))
            left -= take
        if left:
            out += [(x, 0, 0)] * left
    return out


class Writer:
    """Writes bits, lowest first."""

    def __init__(self):
        self.value = self.at = 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.at
        self.at += n

    def code(self, counts: dict[int, int], size: int) -> dict[int, int]:
        """A prefix code for the counted symbols; returns their lengths."""
        used = sorted(counts)
        if len(used) <= 2 and (not used or used[-1] < 256):
            used = used or [0]
            self.put(1 | (len(used) - 1) << 1 | 4 | used[0] << 3, 11)
            if len(used) == 2:
                self.put(used[1], 8)
            return dict.fromkeys(used, len(used) - 1)
        if len(used) == 1:
            counts = {0: 1, **counts}
        lengths = huffman(counts, DEEPEST)
        row = [0] * size
        for x, n in lengths.items():
            row[x] = n
        runs = _runs(row)
        weights = [0] * 19
        for x, *_ in runs:
            weights[x] += 1
        weights = {x: n for x, n in enumerate(weights) if n}
        if len(weights) == 1:
            weights[17 if 17 not in weights else 18] = 1
        own = huffman(weights, 7)
        words = canonical(own)
        value, at = 15 << 1, 5
        for x in LENGTH_ORDER:
            if x in own:
                value |= own[x] << at
            at += 3
        at += 1
        for x, n, rest in runs:
            m = own[x]
            value |= (words[x] | rest << m) << at
            at += m + n
        self.put(value, at)
        return lengths

    def inner(self, p: np.ndarray) -> None:
        """A small inner picture, of literals."""
        self.put(0, 1)
        rows = _bytes(p).reshape(-1, 4)[:, [1, 2, 0, 3]].tolist()
        tables = []
        for channel, size in zip(zip(*rows, strict=True), (280, 256, 256, 256), strict=True):
            counts: dict[int, int] = {}
            for x in channel:
                counts[x] = counts.get(x, 0) + 1
            lengths = self.code(counts, size)
            words = canonical(lengths) if max(lengths.values()) else dict.fromkeys(lengths, 0)
            tables.append({s: (words[s], lengths[s]) for s in lengths})
        self.code({}, 40)
        for row in rows:
            for table, x in zip(tables, row, strict=True):
                self.put(*table[x])


#: Bits of a tile's side, of the colour cache; costs count in 1/1024 bits, and so many bits for each symbol of a code.
TILE, CACHE, UNIT_BITS, SYMBOL_BITS = 4, 8, 1024, 4
MIN_RUN, MAX_RUN, FARTHEST = 3, 4096, (1 << 20) - 120
#: Payload bytes that are encoded together.
ENCODED_BYTES = 1_000_000


def _entropy(counts: np.ndarray) -> np.ndarray:
    """What the symbols counted along the last axis and their code's description cost."""
    c = counts.astype(np.float64)
    n = c.sum(-1)
    each = np.rint(UNIT_BITS * c * np.log2(np.maximum(c, 1))).astype(np.int64).sum(-1)
    return np.rint(UNIT_BITS * n * np.log2(np.maximum(n, 1))).astype(np.int64) - each + SYMBOL_BITS * UNIT_BITS * (counts > 0).sum(-1)


def _counted(pic: np.ndarray, values: np.ndarray, n: int, size: int) -> np.ndarray:
    return np.bincount(pic * size + values, minlength=n * size).reshape(n, size)


def plans(p: np.ndarray, pic: np.ndarray, n: int) -> np.ndarray:
    """For each picture the cheapest of 0: pixels as they are, 1: less green, 2: predicted, 3: predicted less green, 4: palette."""
    v = p.view(np.uint8).reshape(-1, 4)
    d = v.copy()
    same = pic[1:] == pic[:-1]
    d[1:] -= v[:-1] * same[:, None]

    def cost(x: np.ndarray) -> np.ndarray:
        return _entropy(_counted(pic, x, n, 256))

    plain, step = cost(v[:, 1]), cost(d[:, 1])
    costs = [plain, plain.copy(), step, step.copy()]
    for k in (0, 2):
        costs[0] += cost(v[:, k])
        costs[1] += cost(v[:, k] - v[:, 1])
        costs[2] += cost(d[:, k])
        costs[3] += cost(d[:, k] - d[:, 1])
    key = np.sort(pic << 24 | (p & 0xFFFFFF).astype(np.int64))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    c = np.diff(first, append=len(key)).astype(np.float64)
    owner = key[first] >> 24
    begin = np.searchsorted(owner, np.arange(n))
    sizes = np.diff(begin, append=len(owner))
    total = np.add.reduceat(c, begin)
    each = np.add.reduceat(np.rint(UNIT_BITS * c * np.log2(c)).astype(np.int64), begin)
    # A colour of the palette costs a description and three bytes; indexes have an own code.
    palette = np.rint(UNIT_BITS * total * np.log2(total)).astype(np.int64) - each + sizes * UNIT_BITS * (SYMBOL_BITS + 24)
    return np.argmin(np.stack([*costs, np.where(sizes <= 256, palette, np.iinfo(np.int64).max)]), 0)


def predictions(p: np.ndarray) -> list[np.ndarray]:
    """What each of the 14 modes makes of a picture's pixels, (height, width, 4); the borders have fixed modes."""
    v = _bytes(p).astype(np.int16)
    left, top, corner, ahead = (np.zeros_like(v) for _ in range(4))
    left[:, 1:], top[1:], corner[1:, 1:], ahead[1:, :-1] = v[:, :-1], v[:-1], v[:-1, :-1], v[:-1, 1:]
    ahead[1:, -1] = v[1:, 0]
    black = np.broadcast_to(np.array([0, 0, 0, 255], np.int16), v.shape)

    def mean(a, b):
        return (a + b) >> 1

    nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
    half = mean(left, top)
    over = half - corner
    modes = [
        black, left, top, ahead, corner, mean(mean(left, ahead), top), mean(left, corner), half, mean(corner, top), mean(top, ahead),
        mean(mean(left, corner), mean(top, ahead)), np.where(nearer, left, top), np.clip(left + top - corner, 0, 255), np.clip(half + (np.abs(over) >> 1) * np.sign(over), 0, 255),
    ]
    out = []
    for m in modes:
        m = m.copy()
        m[0], m[:, 0] = left[0], top[:, 0]
        m[0, 0] = black[0, 0]
        out.append(m)
    return out


def _by_tile(x: np.ndarray) -> np.ndarray:
    """Sums over tiles of (height, width)."""
    rows, cols = (np.arange(0, k, 1 << TILE) for k in x.shape)
    return np.add.reduceat(np.add.reduceat(x, rows, 0), cols, 1)


def _spread(tiles: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.repeat(np.repeat(tiles, 1 << TILE, 0)[: shape[0]], 1 << TILE, 1)[:, : shape[1]]


def _far(x: np.ndarray) -> np.ndarray:
    """How far bytes are from 0, either way."""
    return np.abs(x.astype(np.uint8).view(np.int8).astype(np.int64))


def predicted(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of a picture, and its tiles' modes: those of the least residuals."""
    v, guesses = _bytes(p).astype(np.int16), predictions(p)
    best = np.argmin(np.stack([_by_tile(_far(v - g).sum(-1)) for g in guesses]), 0)
    at = _spread(best, p.shape)
    r = np.empty(v.shape, np.uint8)
    for m, g in enumerate(guesses):
        r[at == m] = (v - g)[at == m].astype(np.uint8)
    return r.view(np.uint32).reshape(p.shape), (best.astype(np.uint32) << 8) | 0xFF000000


def cross_coloured(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A picture less what its green tells of red, and green and red of blue, and its tiles' factors."""
    v = _bytes(p).copy()
    blue, green, red = (v[..., k].view(np.int8).astype(np.int64) for k in (0, 1, 2))
    tries = sorted(range(-64, 65, 8), key=abs)

    def least(x: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = [x - (f * by >> 5) for f in tries]
        f = np.array(tries)[np.argmin(np.stack([_by_tile(_far(r)) for r in rest]), 0)]
        return f, x - (_spread(f, p.shape) * by >> 5)

    to_red, new_red = least(red, green)
    to_blue, rest = least(blue, green)
    red_blue, rest = least(rest, red)
    v[..., 2], v[..., 0] = new_red.astype(np.uint8), rest.astype(np.uint8)
    factors = np.stack([to_red, to_blue, red_blue], -1).astype(np.int8).view(np.uint8).astype(np.uint32)
    return v.view(np.uint32).reshape(p.shape), factors[..., 0] | factors[..., 1] << 8 | factors[..., 2] << 16 | 0xFF000000


def transformed(p: np.ndarray, plan: int, out: Writer) -> np.ndarray:
    """Writes a picture's transforms and returns its pixels after them."""
    if plan == 4:
        table, index = np.unique(p, return_inverse=True)
        n = len(table)
        pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        out.put(1 | 3 << 1 | (n - 1) << 3, 11)
        steps = np.diff(_bytes(table), axis=0, prepend=np.zeros((1, 4), np.uint8))
        out.inner(np.ascontiguousarray(steps).view(np.uint32).reshape(1, n))
        height, width = p.shape
        wide = np.zeros((height, _tiles(width, pack) << pack), np.uint32)
        wide[:, :width] = index.reshape(p.shape)
        parts = wide.reshape(height, -1, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * (8 >> pack))
        p = parts.sum(-1, dtype=np.uint32) << 8 | 0xFF000000
    if plan in (1, 3):
        out.put(1 | 2 << 1, 3)
        v = _bytes(p).copy()
        v[..., 0] -= v[..., 1]
        v[..., 2] -= v[..., 1]
        p = v.view(np.uint32).reshape(p.shape)
    if plan in (2, 3):
        for kind, f in enumerate((predicted, cross_coloured)):
            p, tiles = f(p)
            out.put(1 | kind << 1 | (TILE - 2) << 3, 6)
            out.inner(np.ascontiguousarray(tiles, np.uint32))
    out.put(0, 1)
    return p.astype(np.uint32)


def runs_before(p: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and distance of runs of MIN_RUN pixels or more that equal earlier ones at their latest place; left
    counts the pixels from each to its picture's end, and grows where a picture begins."""
    at = np.flatnonzero(left >= MIN_RUN)
    x = p.astype(np.uint64)
    key = x[at] * np.uint64(0x9E3779B97F4A7C15) ^ x[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[at + 2] * np.uint64(0x165667B19E3779F9)
    end = at + left[at]
    key = key >> np.uint64(24) | end.astype(np.uint64) << np.uint64(40)
    order = np.argsort(key, kind="stable")
    now, before = order[1:], order[:-1]
    ok = key[now] == key[before]
    now, before = at[now[ok]], at[before[ok]]
    ok = now - before <= FARTHEST
    for k in range(MIN_RUN):
        ok &= p[now + k] == p[before + k]
    now, before = now[ok], before[ok]
    order = np.argsort(now)
    now, far = now[order], (now - before)[order]
    first = np.flatnonzero((np.diff(now, prepend=-2) != 1) | (np.diff(far, prepend=0) != 0))
    return now[first], np.diff(first, append=len(now)) + MIN_RUN - 1, far[first]


@lru_cache(64)
def _near(width: int) -> dict[int, int]:
    """Distances that have a plane code, the smallest for each."""
    near: dict[int, int] = {}
    for k, (x, y) in enumerate(PLANE_CODES):
        near.setdefault(max(1, x + y * width), k + 1)
    return near


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol of a length or distance, number of extra bits and their value."""
    d = v - 1
    high = np.maximum(np.frexp(d.astype(np.float64))[1].astype(np.int64) - 1, 1)
    extra = np.where(d < 4, 0, high - 1)
    return np.where(d < 4, d, 2 * high + (d >> (high - 1) & 1)), extra, d & ((1 << extra) - 1)


def _hits(p: np.ndarray, pic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the colour cache, and whether the cache then holds it."""
    slot = (p * np.uint32(CACHE_MULTIPLIER) >> np.uint32(32 - CACHE)).astype(np.int64)
    key = pic << CACHE | slot
    order = np.argsort(key, kind="stable")
    hit = np.zeros(len(p), bool)
    now, before = order[1:], order[:-1]
    hit[now] = (key[now] == key[before]) & (p[now] == p[before])
    return slot, hit


GREENS = 280 + (1 << CACHE)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A file, or several one after the other, for each payload; lengths are positive multiples of 576."""
    cut = [(k, p[a : a + UNIT * ROWS]) for k, p in enumerate(payloads) for a in range(0, len(p), UNIT * ROWS)]
    n = len(cut)
    raw = np.frombuffer(b"".join(p for _, p in cut), np.uint8).reshape(-1, 3)
    argb = np.full((len(raw), 4), 255, np.uint8)
    argb[:, :3] = raw[:, ::-1]
    p = argb.view(np.uint32).reshape(-1)
    sizes = np.array([len(x) // 3 for _, x in cut])
    edge = np.cumsum(sizes)
    heads = [Writer() for _ in cut]
    parts, widths = [], []
    for head, plan, a, b in zip(heads, plans(p, np.repeat(np.arange(n), sizes), n).tolist(), (edge - sizes).tolist(), edge.tolist(), strict=True):
        if plan:
            own = transformed(p[a:b].reshape(-1, WIDTH), plan, head)
            widths.append(own.shape[1])
            parts.append(own.reshape(-1))
        else:
            head.put(0, 1)
            widths.append(WIDTH)
            parts.append(p[a:b])
    p = np.concatenate(parts)
    sizes = np.array([len(x) for x in parts])
    edge = np.cumsum(sizes)
    pic = np.repeat(np.arange(n), sizes)

    # Back-references: from left to right, each run from where the last one ends.
    begins, lengths, codes, at = [], [], [], 0
    for begin, length, far in zip(*(x.tolist() for x in runs_before(p, np.repeat(edge, sizes) - np.arange(len(p)))), strict=True):
        end = begin + length
        at = max(at, begin)
        while end - at >= MIN_RUN:
            take = min(end - at, MAX_RUN)
            begins.append(at)
            lengths.append(take)
            codes.append(far)
            at += take
    begins, lengths, codes = (np.array(x, np.int64) for x in (begins, lengths, codes))
    codes = np.array([_near(widths[k]).get(d, d + 120) for k, d in zip(pic[begins].tolist(), codes.tolist(), strict=True)], np.int64)
    change = np.zeros(len(p) + 1, np.int64)
    change[begins] += 1
    change[begins + lengths] -= 1
    token = np.cumsum(change[:-1]) == 0
    token[begins] = True
    where = np.flatnonzero(token)
    back = np.zeros(len(p), bool)
    back[begins] = True
    back = back[where]
    owner, v = pic[where], _bytes(p)[where]
    green, red, blue = v[:, 1].astype(np.int64), v[:, 2].astype(np.int64), v[:, 0].astype(np.int64)
    length_symbol, length_bits, length_rest = _prefix(lengths)
    far_symbol, far_bits, far_rest = _prefix(codes)
    green[back] = 256 + length_symbol

    # The cache, where literals and hits together cost less.
    slot, hit = (x[where] for x in _hits(p, pic))
    hit &= ~back
    cached = np.where(hit, 280 + slot, green)
    single = ~back
    plain = _entropy(_counted(owner, green, n, GREENS)) + sum(_entropy(_counted(owner[single], x[single], n, 256)) for x in (red, blue))
    single &= ~hit
    less = _entropy(_counted(owner, cached, n, GREENS)) + sum(_entropy(_counted(owner[single], x[single], n, 256)) for x in (red, blue))
    use = less < plain
    hit &= use[owner]
    green = np.where(hit, cached, green)
    single = ~back & ~hit

    # Prefix codes of each picture's own symbols.
    symbols = {0: (owner, green, GREENS), 1: (owner[single], red[single], 256), 2: (owner[single], blue[single], 256), 4: (owner[back], far_symbol, 40)}
    sections = [_pieces(k, head.value, head.at) for k, head in enumerate(heads)]
    sections = [tuple(np.concatenate(x) for x in zip(*sections, strict=True))]
    every = np.arange(n)
    sections.append((every, np.where(use, 1 | CACHE << 1, 0).astype(np.uint64), np.where(use, 6, 2)))
    tables = {}
    for c in (0, 1, 2, 3, 4):
        if c == 3:
            sections.append((every, (5 | (p[edge - sizes] >> 24).astype(np.uint64) << np.uint64(3)), np.full(n, 11)))
            continue
        own_lengths, parts = described(_counted(*symbols[c][:2], n, symbols[c][2]), np.where(use, GREENS, 280) if c == 0 else np.full(n, symbols[c][2]))
        sections.append(parts)
        tables[c] = words_of(own_lengths).reshape(-1), own_lengths.reshape(-1)

    # A literal is three words, a hit one, a back-reference two with their extra bits.
    pieces = np.where(single, 3, np.where(back, 4, 1))
    first = np.cumsum(pieces) - pieces
    value, bits = np.zeros(int(pieces.sum()), np.uint64), np.zeros(int(pieces.sum()), np.int64)

    def place(at: np.ndarray, c: int, own: np.ndarray, symbol: np.ndarray) -> None:
        words, long = tables[c]
        index = own * symbols[c][2] + symbol
        value[at], bits[at] = words[index], long[index]

    place(first, 0, owner, green)
    place(first[single] + 1, 1, *symbols[1][:2])
    place(first[single] + 2, 2, *symbols[2][:2])
    place(first[back] + 2, 4, *symbols[4][:2])
    value[first[back] + 1], bits[first[back] + 1] = length_rest, length_bits
    value[first[back] + 3], bits[first[back] + 3] = far_rest, far_bits

    sections.append((np.repeat(owner, pieces), value, bits))
    owner, value, bits = (np.concatenate(x) for x in zip(*sections, strict=True))
    order = np.argsort(owner.astype(np.uint16) if n < 1 << 16 else owner, kind="stable")
    owner, value, bits = owner[order], value[order], bits[order]
    ends = np.cumsum(bits)
    last = np.cumsum(np.bincount(owner, minlength=n))
    total = np.diff(ends[last - 1], prepend=0)
    room = (total + 71) // 64 * 8
    base = np.cumsum(room) - room
    at = ends - bits + (8 * base - ends[last - 1] + total)[owner]
    word, off = at >> 6, (at & 63).astype(np.uint64)
    flat = np.zeros(int(room.sum()) // 8 + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    flat[word[first]] += np.add.reduceat(value << off, first)
    over = np.flatnonzero(off.astype(np.int64) + bits > 64)
    flat[word[over] + 1] += value[over] >> (np.uint64(64) - off[over])
    flat = flat.astype("<u8").tobytes()
    files: list[list[bytes]] = [[] for _ in payloads]
    for (k, x), a, t in zip(cut, base.tolist(), total.tolist(), strict=True):
        data = b"\x2f" + (WIDTH - 1 | (len(x) // UNIT - 1) << 14).to_bytes(4, "little") + flat[a : a + (t + 7) // 8]
        pad = len(data) & 1
        files[k].append(struct.pack("<4sI4s4sI", b"RIFF", 12 + len(data) + pad, b"WEBP", b"VP8L", len(data)) + data + b"\0" * pad)
    return [b"".join(f) for f in files]


def _pieces(k: int, value: int, bits: int) -> tuple[list[int], np.ndarray, list[int]]:
    """Written bits as (owner, value, bits) of 32 bits at most."""
    left = range(0, bits, 32)
    return [k] * len(left), np.array([value >> a & 0xFFFFFFFF for a in left], np.uint64), [min(32, bits - a) for a in left]


def code_lengths(counts: np.ndarray, deepest: int) -> np.ndarray:
    """Huffman's code lengths for each row of counts, of two symbols or more. Where a code gets too deep, small counts are raised."""
    n = len(counts)
    used = (counts > 0).sum(1)
    most = int(used.max())
    order = np.argsort(np.where(counts > 0, counts, 1 << 40), axis=1, kind="stable")[:, :most]
    row = np.arange(n)
    # Leaves, a bar that is never taken, and inner nodes as they are made.
    w = np.full((n, 2 * most), 1 << 61)
    w[:, :most] = np.take_along_axis(counts, order, 1)
    w[:, :most][w[:, :most] == 0] = 1 << 40
    w[:, most] = 1 << 62
    stride = 2 * most
    w, up, base = w.reshape(-1), np.zeros(n * stride, np.int64), row * stride
    leaf, node = base.copy(), base + most + 1
    for k in range(most + 1, 2 * most):
        total = np.zeros(n, np.int64)
        for _ in (0, 1):
            a, b = w[leaf], w[node]
            from_leaf = a <= b
            up[np.where(from_leaf, leaf, node)] = k
            total += np.minimum(a, b)
            leaf += from_leaf
            node += ~from_leaf
        w[base + k] = total
    up = up.reshape(n, stride)
    deep = np.zeros((n, stride), np.int64)
    for k in range(2 * most - 2, most, -1):
        deep[:, k] = deep[row, up[:, k]] + 1
    leaves = np.take_along_axis(deep, up[:, :most], 1) + 1 - deep[row, most + used - 1][:, None]  # a row of fewer symbols has its root lower
    lengths = np.zeros_like(counts)
    np.put_along_axis(lengths, order, np.where(np.arange(most) < used[:, None], leaves, 0), 1)
    over = np.flatnonzero(lengths.max(1) > deepest)
    if len(over):
        c = counts[over]
        floors = np.where(c > 0, c, 1 << 40).min(1)[:, None]
        lengths[over] = code_lengths(np.where(c > 0, np.maximum(c, 2 * floors), 0), deepest)
    return lengths


def described(counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code lengths for rows of counts, and each row's description, (row, value, bits) in its order; size: the row's alphabet."""
    used = (counts > 0).sum(1)
    last = counts.shape[1] - 1 - np.argmax(counts[:, ::-1] > 0, 1)
    plain = (used <= 2) & ((used == 0) | (last < 256))
    lengths = np.zeros_like(counts)
    a = np.flatnonzero(plain)
    two, first, second = used[a] == 2, np.where(used[a] > 0, np.argmax(counts[a] > 0, 1), 0), last[a]
    lengths[a[two], first[two]] = lengths[a[two], second[two]] = 1
    simple = (a, (5 | two << 1 | first << 3 | np.where(two, second << 11, 0)).astype(np.uint64), np.where(two, 19, 11))
    b = np.flatnonzero(~plain)
    if not len(b):
        return lengths, simple
    lengths[b] = code_lengths(counts[b], DEEPEST)
    # Each used symbol stands after a gap of zeros, and a row ends with one.
    row, symbol = np.nonzero(lengths[b])
    row, symbol = np.concatenate([row, np.arange(len(b))]), np.concatenate([symbol, size[b]])
    order = np.argsort(row, kind="stable")
    row, symbol = row[order], symbol[order]
    gap = symbol - np.where(np.diff(row, prepend=-1) != 0, -1, np.concatenate([[0], symbol[:-1]])) - 1
    ends = symbol == size[b][row]
    full, rest = gap // 138, gap % 138
    zeros = full + np.where(rest < 3, rest, 1)
    count = zeros + ~ends
    event = np.repeat(np.arange(len(row)), count)
    nth = np.arange(len(event)) - np.repeat(np.cumsum(count) - count, count)
    own, short = row[event], rest[event]
    wide = nth < full[event]
    zero = ~wide & (nth < zeros[event])
    told = np.where(wide, 18, np.where(zero, np.where(short < 3, 0, np.where(short < 11, 17, 18)), lengths[b][own, np.minimum(symbol[event], counts.shape[1] - 1)]))
    bits = np.where(told == 17, 3, np.where(told == 18, 7, 0))
    value = np.where(wide, 127, np.where(told == 17, short - 3, np.where(told == 18, short - 11, 0)))
    hist = _counted(own, told, len(b), 19)
    alone = np.flatnonzero((hist > 0).sum(1) == 1)
    hist[alone, np.where(hist[alone, 17] > 0, 18, 17)] = 1
    inner_lengths = code_lengths(hist, 7)
    words = words_of(inner_lengths)
    head = np.full(len(b), 15 << 1, np.uint64)
    for k, x in enumerate(LENGTH_ORDER):
        head |= inner_lengths[:, x].astype(np.uint64) << np.uint64(5 + 3 * k)
    long = inner_lengths[own, told]
    told = words[own, told] | value.astype(np.uint64) << long.astype(np.uint64)
    owner = np.concatenate([a, b, b[own]])
    order = np.argsort(owner, kind="stable")
    return lengths, tuple(np.concatenate(x)[order] for x in zip((owner[: len(a)], *simple[1:]), (b, head, np.full(len(b), 63)), (b[own], told, long + bits), strict=True))


def words_of(lengths: np.ndarray) -> np.ndarray:
    """Code words, first bit lowest, for each row of code lengths; 0 where there is none."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    order = np.lexsort((symbol, n, row))
    row, symbol, n = row[order], symbol[order], n[order]
    span = 1 << (DEEPEST - n)
    at = np.cumsum(span) - span
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    at -= np.repeat(at[begin], np.diff(begin, append=len(row)))
    words = np.zeros(lengths.shape, np.uint64)
    words[row, symbol] = _reversed()[at]
    return words


def payloads(blobs: list[bytes]) -> list[bytes]:
    """The RGB samples of each value's files as bytes; files are decoded together."""
    streams, count = [], []
    for blob in blobs:
        at, n = 0, len(streams)
        while at < len(blob):
            stream, at = _stream(blob, at)
            streams.append(stream)
        count.append(len(streams) - n)
    found = (_bytes(_read(*x) if p is None else p)[..., 2::-1].tobytes() for x, p in zip(streams, together(streams), strict=True))
    return [b"".join(islice(found, n)) for n in count]


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def feature(payload: bytes) -> str:
    """Rows, the sums of the three channels, and the sum of horizontal steps between pixels."""
    p = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    sums = p.sum((0, 1), dtype=np.int64)
    steps = int(np.abs(np.diff(p.astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{len(p)}:{sums[0]}:{sums[1]}:{sums[2]}:{steps}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the files) of each document."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            texts = utf8(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for a, b in spans([max(UNIT, len(t)) for t in texts], ENCODED_BYTES):
                media = encode([padded(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Decodes the stored files and describes them."""

    @task(__name__)
    def run(rows):
        for batch in batches(rows):
            blobs = batch.column("media").to_pylist()
            for a, b in slices(blobs, DECODED_BYTES):
                got = payloads(blobs[a:b])
                cols = (
                    batch.column("doc_id").slice(a, b - a),
                    batch.column("n_bytes").slice(a, b - a),
                    pa.array([len(p) for p in got], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in got], pa.string()),
                    pa.array([zlib.crc32(p[-32:]) for p in got], pa.int64()),
                    pa.array([len(m) for m in blobs[a:b]], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in blobs[a:b]], pa.string()),
                    pa.array([feature(p) for p in got], pa.string()),
                )
                yield pa.RecordBatch.from_arrays(list(cols), names=[f.split()[0] for f in OUT.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, OUT)


def media(spark: SparkSession, docs: DataFrame, scope: str = "op") -> DataFrame:
    """Stores every text as lossless WebP in the shared folder, reads it back and returns its digest and features."""
    return features(store(spark, stored(docs), "media", scope))
