import random

import numpy as np
import pytest

from adjudica.llm import webp


class Out:
    """Writes VP8L bits; picks its prefix codes from the symbols it is given."""

    def __init__(self):
        self.bits = []

    def put(self, x, n):
        self.bits.extend(x >> i & 1 for i in range(n))

    def code(self, counts, size):
        used = sorted(counts)
        if len(used) <= 2 and all(s < 256 for s in used):
            used = used or [0]
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(1, 1)
            self.put(used[0], 8)
            if len(used) == 2:
                self.put(used[1], 8)
            return {s: (k, 1 if len(used) == 2 else 0) for k, s in enumerate(used)}
        if len(used) == 1:
            used = [*used, 0]
        lengths = webp.huffman({s: counts.get(s, 1) for s in used}, 15)
        words = webp.canonical(lengths)
        runs = webp._runs([lengths.get(s, 0) for s in range(size)])
        weights = {}
        for s, *_ in runs:
            weights[s] = weights.get(s, 0) + 1
        if len(weights) == 1:
            weights[19 - 1 if 18 not in weights else 17] = 1
        inner = webp.huffman(weights, 7)
        inner_words = webp.canonical(inner)
        self.put(0, 1)
        self.put(15, 4)
        for s in webp.LENGTH_ORDER:
            self.put(inner.get(s, 0), 3)
        self.put(0, 1)
        for s, n, x in runs:
            self.put(inner_words[s], inner[s])
            self.put(x, n)
        return {s: (words[s], lengths[s]) for s in lengths}

    @staticmethod
    def prefix(v):
        """Symbol, extra bits and value of a length or distance code."""
        if v <= 4:
            return v - 1, 0, 0
        d = v - 1
        high = d.bit_length() - 1
        second = d >> (high - 1) & 1
        return 2 * high + second, high - 1, d & ((1 << (high - 1)) - 1)

    def pixels(self, tokens, cache, groups=1, group_of=None):
        """tokens: ('l', argb), ('b', length, distance code) or ('c', index); group_of gives a token's group."""
        counts = [[{} for _ in range(5)] for _ in range(groups)]
        steps = []
        for k, t in enumerate(tokens):
            g = group_of[k] if group_of else 0
            if t[0] == "l":
                a = t[1]
                parts = [(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)]
                steps.append((g, [(c, s, 0, 0) for c, s in parts]))
            elif t[0] == "b":
                n, d = self.prefix(t[1]), self.prefix(t[2])
                steps.append((g, [(0, 256 + n[0], n[1], n[2]), (4, *d)]))
            else:
                steps.append((g, [(0, 280 + t[1], 0, 0)]))
        for g, parts in steps:
            for c, s, *_ in parts:
                counts[g][c][s] = counts[g][c].get(s, 0) + 1
        sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
        codes = [[self.code(counts[g][c], sizes[c]) for c in range(5)] for g in range(groups)]
        for g, parts in steps:
            for c, s, n, x in parts:
                self.put(*codes[g][c][s])
                self.put(x, n)

    def plain(self, p, main=False):
        """A whole inner picture as literals."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        self.pixels([("l", int(x)) for x in p.reshape(-1)], 0)

    def file(self, width, height):
        body = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        data = b"\x2f" + (width - 1 | (height - 1) << 14).to_bytes(4, "little") + body
        pad = len(data) & 1
        import struct

        return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(data) + pad, b"WEBP", b"VP8L", len(data)) + data + b"\0" * pad


def rgba(p):
    return np.stack([p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24], -1).astype(np.uint8)


def picture(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 32, (h, w), dtype=np.uint32)


def test_literals_and_groups():
    p = picture(9, 13)
    out = Out()
    out.put(0, 1)
    out.plain(p, main=True)
    assert (webp.decode(out.file(13, 9)) == rgba(p)).all()
    out = Out()
    for x in (0, 0, 1):  # no transform, no cache, several groups
        out.put(x, 1)
    out.put(0, 3)
    tiles = np.array([[0, 1 << 8, 2 << 8, 1 << 8]] * 3, np.uint32)
    out.plain(tiles)
    groups = [int(tiles[y >> 2, x >> 2] >> 8) for y in range(9) for x in range(13)]
    out.pixels([("l", int(v)) for v in p.reshape(-1)], 0, 3, groups)
    assert (webp.decode(out.file(13, 9)) == rgba(p)).all()


def test_cache_and_back_references():
    rnd = random.Random(4)
    w, h, bits = 16, 20, 5
    plane = {c: i + 1 for i, c in enumerate(webp.PLANE_CODES)}
    p, tokens, cache = [], [], {}

    def note(v):
        cache[v * webp.CACHE_MULTIPLIER >> (32 - bits) & 31] = v

    while len(p) < w * h:
        kind = rnd.random()
        if kind < 0.3 and len(p) > 2 * w + 8:
            n = min(rnd.randint(1, 30), w * h - len(p))
            if rnd.random() < 0.5:
                code = rnd.choice([c for c in plane if 1 <= c[0] + c[1] * w <= len(p)])
                d, value = code[0] + code[1] * w, plane[code]
            else:
                d = rnd.randint(1, len(p))
                value = d + 120
            for _ in range(n):
                p.append(p[-d])
                note(p[-1])
            tokens.append(("b", n, value))
        elif kind < 0.5 and cache:
            k = rnd.choice(list(cache))
            tokens.append(("c", k))
            p.append(cache[k])
            note(p[-1])
        else:
            p.append(rnd.randrange(1 << 32) if rnd.random() < 0.5 or not p else p[rnd.randrange(len(p))])
            tokens.append(("l", p[-1]))
            note(p[-1])
    out = Out()
    out.put(0, 1)
    out.put(1, 1)
    out.put(bits, 4)
    out.put(0, 1)
    out.pixels(tokens, bits)
    assert (webp.decode(out.file(w, h)) == rgba(np.array(p, np.uint32).reshape(h, w))).all()


def residuals(p, modes, bits):
    """Forward prediction, on the original pixels, by channel."""
    h, w = p.shape
    v = p.view(np.uint8).reshape(h, w, 4).astype(int)
    out = np.zeros_like(v)
    avg = lambda a, b: (a + b) // 2
    for y in range(h):
        for x in range(w):
            if x == 0 and y == 0:
                g = np.array([0, 0, 0, 255])
            elif y == 0:
                g = v[y, x - 1]
            elif x == 0:
                g = v[y - 1, x]
            else:
                left, top, tl = v[y, x - 1], v[y - 1, x], v[y - 1, x - 1]
                tr = v[y - 1, x + 1] if x + 1 < w else v[y, 0]
                m = int(modes[y >> bits, x >> bits] >> 8 & 15)
                half = avg(left, top)
                g = [
                    lambda: np.array([0, 0, 0, 255]), lambda: left, lambda: top, lambda: tr, lambda: tl, lambda: avg(avg(left, tr), top), lambda: avg(left, tl), lambda: avg(left, top), lambda: avg(tl, top), lambda: avg(top, tr),
                    lambda: avg(avg(left, tl), avg(top, tr)), lambda: left if np.abs(top - tl).sum() < np.abs(left - tl).sum() else top, lambda: np.clip(left + top - tl, 0, 255), lambda: np.clip(half + np.trunc((half - tl) / 2).astype(int), 0, 255),
                ][m]()
            out[y, x] = (v[y, x] - g) & 255
    return out.astype(np.uint8).view(np.uint32).reshape(h, w)


def test_predictor_cross_colour_and_green():
    h, w, bits = 16, 28, 2
    p = picture(h, w, 3)
    modes = (np.arange(28, dtype=np.uint32).reshape(4, 7) % 14) << 8
    r = residuals(p, modes, bits)
    factors = picture(4, 7, 5)
    f = np.repeat(np.repeat(factors, 4, 0), 4, 1)[:h, :w].view(np.uint8).reshape(h, w, 4).view(np.int8).astype(int)
    v = r.view(np.uint8).reshape(h, w, 4).astype(int)
    s8 = lambda x: (x + 128) % 256 - 128
    c = v.copy()
    c[..., 2] = v[..., 2] - (f[..., 0] * s8(v[..., 1]) >> 5)
    c[..., 0] = v[..., 0] - (f[..., 1] * s8(v[..., 1]) >> 5) - (f[..., 2] * s8(v[..., 2]) >> 5)
    g = c & 255
    g[..., 0] = g[..., 0] - g[..., 1] & 255
    g[..., 2] = g[..., 2] - g[..., 1] & 255
    coded = g.astype(np.uint8).view(np.uint32).reshape(h, w)
    out = Out()
    for kind, table in ((0, modes), (1, factors), (2, None)):
        out.put(1, 1)
        out.put(kind, 2)
        if table is not None:
            out.put(bits - 2, 3)
            out.plain(table)
    out.put(0, 1)
    out.plain(coded, main=True)
    assert (webp.decode(out.file(w, h)) == rgba(p)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette(n):
    h, w = 7, 19
    table = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    index = np.random.default_rng(n + 1).integers(0, n, (h, w))
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    cols = -(-w >> pack) if False else (w + (1 << pack) - 1) >> pack
    packed = np.zeros((h, cols), np.uint32)
    for x in range(w):
        packed[:, x >> pack] |= (index[:, x] << ((x & ((1 << pack) - 1)) * (8 >> pack))).astype(np.uint32)
    delta = np.diff(table.view(np.uint8).reshape(n, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    out = Out()
    out.put(1, 1)
    out.put(3, 2)
    out.put(n - 1, 8)
    out.plain(np.ascontiguousarray(delta).view(np.uint32).reshape(1, n))
    out.put(0, 1)
    out.plain(packed << 8 | 0xFF000000, main=True)
    assert (webp.decode(out.file(w, h)) == rgba(table[index])).all()


def test_payloads_round_trip():
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"x" * 576, bytes(rng.integers(0, 256, 5000, dtype=np.uint8)), "é日本 text\n".encode() * 300]
    data = [webp.padded(t) for t in texts]
    files = webp.encode(data)
    assert webp.payloads(files) == data
    assert webp.encode([data[1], data[1]])[0] == files[1]
    assert webp.decode(files[3])[..., :3].tobytes() == data[3]


def test_several_files_for_a_long_payload(monkeypatch):
    monkeypatch.setattr(webp, "ROWS", 4)
    data = bytes(range(256)) * 9 * 5
    data = webp.padded(data)
    (blob,) = webp.encode([data])
    assert blob.count(b"WEBP") == -(-len(data) // (576 * 4)) and webp.payloads([blob]) == [data]


def test_damaged_files_are_refused():
    with pytest.raises(ValueError):
        webp.decode(b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0")


def kinds(blob):
    """Transforms of a file, in order, and whether it has a colour cache and back-references."""
    (width, height, data), _ = webp._stream(blob)
    got = webp.Picture(webp.Bits(data), width, height, True)
    return [t[0] for t in got.transforms], got.cache > 0, int(got.groups[0][0].symbol.max()) >= 256


def test_encode_takes_each_step_of_the_method():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:64, 0:192]
    green = (x * 2 + y * 3 + rng.integers(0, 2, x.shape)) % 256
    smooth = np.stack([green // 2 + 30, green, 200 - green // 2], -1).astype(np.uint8).tobytes()
    noise = rng.integers(0, 256, (20, 192), dtype=np.uint8)
    grey = np.stack([noise, noise, noise], -1).tobytes()
    few = bytes(rng.integers(0, 256, (9, 3), dtype=np.uint8)[rng.integers(0, 9, 40 * 192)].reshape(-1))
    words = rng.integers(97, 123, (150, 3), dtype=np.uint8)
    drawn = bytes(words[rng.integers(0, 150, 3000)].reshape(-1)) + bytes(rng.integers(97, 123, 6000, dtype=np.uint8))
    page = bytes(rng.integers(32, 127, 3000, dtype=np.uint8))
    data = [webp.padded(t) for t in (smooth, grey, few, drawn, page * 3, b"", page)]
    files = webp.encode(data)
    assert webp.payloads(files) == data
    assert kinds(files[0])[0][-2:] == [0, 1]
    assert kinds(files[1])[0] == [2]
    assert kinds(files[2])[0] == [3]
    assert kinds(files[3])[1]
    assert kinds(files[4])[2] and len(files[4]) < 1.2 * len(files[6])
    assert webp.encode(data[4:5]) == files[4:5]


def test_pictures_decoded_together_are_those_decoded_alone():
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu,.E", k=rng.randrange(1, 9))) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(200, 900))).encode() for _ in range(webp.ALONE + 60)]
    texts += [b"", bytes(range(256)) * 9, b"ab" * 4000]
    data = [webp.padded(t) for t in texts]
    files = webp.encode(data)
    streams = [webp._stream(f)[0] for f in files]
    assert sum(p is not None for p in webp.together(streams)) > 40
    assert webp.payloads(files) == data == [webp.decode(f)[..., :3].tobytes() for f in files]
