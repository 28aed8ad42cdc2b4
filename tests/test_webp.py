"""Lossless WEBP pictures written here bit by bit, and read back."""

import numpy as np
import pytest

from mediasift.functions.imagehash import hash_pixels
from mediasift.sources.frames_source import read_frames
from mediasift.sources.webp import LENGTH_ORDER, NEAR, Picture


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def data(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8), bitorder="little").tobytes()


class Code:
    """A code whose words are all of one length."""

    def __init__(self, used, size):
        used = sorted(set(used)) or [0]
        self.n = max(1, (len(used) - 1).bit_length())
        spare = (s for s in range(size) if s not in used)
        self.symbols = sorted(used + ([next(spare) for _ in range((1 << self.n) - len(used))] if len(used) > 1 else []))
        self.single, self.size = len(used) == 1, size

    def write(self, w):
        w.put(0, 1)
        w.put(15, 4)
        for s in LENGTH_ORDER:
            w.put(4 if s < 16 else 0, 3)
        w.put(0, 1)
        for s in range(self.size):
            self.word(w, self.n if s in self.symbols else 0, 4)

    @staticmethod
    def word(w, code, n):
        w.put(int(f"{code:0{n}b}"[::-1], 2), n)

    def emit(self, w, symbol):
        if not self.single:
            self.word(w, self.symbols.index(symbol), self.n)


def prefixed(v):
    """(symbol, further bits, how many) of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    n = (v - 1).bit_length() - 1
    return 2 * n + ((v - 1) >> (n - 1) & 1), (v - 1) & ((1 << (n - 1)) - 1), n - 1


def symbols(t, cache):
    if t[0] == "lit":
        return [(0, t[1] >> 8 & 255), (1, t[1] >> 16 & 255), (2, t[1] & 255), (3, t[1] >> 24)]
    if t[0] == "copy":
        return [(0, 256 + prefixed(t[1])[0]), (4, prefixed(t[2])[0])]
    return [(0, 280 + t[1])]


def put_pixels(w, tokens, whole, cache_bits=0, groups=None):
    """tokens: ("lit", argb), ("copy", length, distance code), ("cache", slot); groups: (bits, image tokens, group of each token)."""
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    of = [0] * len(tokens)
    if whole:
        w.put(groups is not None, 1)
        if groups:
            w.put(groups[0] - 2, 3)
            put_pixels(w, groups[1], False)
            of = groups[2]
    codes = {}
    for g in sorted(set(of)):
        found = [x for t, k in zip(tokens, of, strict=True) if k == g for x in symbols(t, cache_bits)]
        codes[g] = [Code([s for kind, s in found if kind == k], n) for k, n in enumerate((280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))]
        for c in codes[g]:
            c.write(w)
    for t, g in zip(tokens, of, strict=True):
        code = codes[g]
        if t[0] == "copy":
            for k, v in ((0, t[1]), (4, t[2])):
                s, more, n = prefixed(v)
                code[k].emit(w, s + 256 if k == 0 else s)
                w.put(more, n)
        else:
            for k, s in symbols(t, cache_bits):
                code[k].emit(w, s)


def literals(argb):
    return [("lit", int(p)) for p in np.asarray(argb).reshape(-1)]


def picture(width, height, *steps, last):
    """A file; steps and last write transforms and pixels."""
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    for step in steps:
        w.put(1, 1)
        step(w)
    w.put(0, 1)
    last(w)
    data = w.data()
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def random_argb(seed, h=9, w=13, values=256):
    rng = np.random.default_rng(seed)
    return sum(rng.integers(0, values, (h, w)).astype(np.uint32) << k for k in (0, 8, 16, 24)).astype(np.uint32)


def rgb(argb):
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], 2).astype(np.uint8)


def same(content, argb):
    found = Picture(content)
    assert (found.height, found.width) == argb.shape and len(found) == 1
    return (found.frame(0) == rgb(argb)).all()


def test_literals():
    for seed, shape in enumerate([(1, 1), (9, 13), (3, 40)]):
        argb = random_argb(seed, *shape)
        assert same(picture(shape[1], shape[0], last=lambda w, p=argb: put_pixels(w, literals(p), True)), argb)


def test_copies_of_near_and_far_pixels():
    argb = random_argb(1, 8, 20, 4)
    argb[1] = argb[0]
    argb[4, :10] = argb[2, 3:13]
    argb[5] = argb[5, 0]
    flat = literals(argb)
    up = NEAR.index((0, 1)) + 1
    tokens = [*flat[:20], ("copy", 20, up), *flat[40:80], ("copy", 10, 80 - 43 + 120), *flat[90:101], ("copy", 19, 2), *flat[120:]]
    assert same(picture(20, 8, last=lambda w: put_pixels(w, tokens, True)), argb)
    slanted = random_argb(2, 8, 20, 4)
    at, far = 7 * 20 + 3, NEAR.index((-4, 3)) + 1
    slanted.reshape(-1)[at : at + 5] = slanted.reshape(-1)[at - 3 * 20 + 4 : at - 3 * 20 + 9]
    flat = literals(slanted)
    assert same(picture(20, 8, last=lambda w: put_pixels(w, [*flat[:at], ("copy", 5, far), *flat[at + 5 :]], True)), slanted)


def test_recent_colours():
    argb = random_argb(3, 6, 10, 2)
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 27
    cache, tokens = {}, []
    for p in argb.reshape(-1).tolist():
        tokens.append(("cache", slot(p)) if cache.get(slot(p)) == p else ("lit", p))
        cache[slot(p)] = p
    assert sum(t[0] == "cache" for t in tokens) > 10
    assert same(picture(10, 6, last=lambda w: put_pixels(w, tokens, True, 5)), argb)


def test_groups_of_codes():
    argb = random_argb(4, 8, 12)
    kinds = np.array([[0, 1, 0], [1, 1, 0]])
    of = np.repeat(np.repeat(kinds, 4, 0), 4, 1).reshape(-1).tolist()
    assert same(picture(12, 8, last=lambda w: put_pixels(w, literals(argb), True, 0, (2, literals(kinds << 8), of))), argb)


def channels(argb):
    return np.stack([argb >> k & 255 for k in (24, 16, 8, 0)], 2).astype(np.int64)


def joined(c):
    return sum((c[..., i].astype(np.uint32) & 255) << k for i, k in enumerate((24, 16, 8, 0))).astype(np.uint32)


def guess(mode, left, top, right, corner):
    """Predictions as the format defines them, by channel."""
    mean = lambda a, b: (a + b) // 2
    if mode == 11:
        p = left + top - corner
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 13:
        a = mean(left, top)
        return np.clip(a + np.fix((a - corner) / 2).astype(np.int64), 0, 255)
    black = np.array([255, 0, 0, 0])
    return [black, left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)), None, np.clip(left + top - corner, 0, 255)][mode]


def residuals(argb, modes, bits):
    c = channels(argb)
    out = c.copy()
    h, w = argb.shape
    for y in range(h):
        for x in range(w):
            if y == 0:
                g = c[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                g = c[y - 1, 0]
            else:
                g = guess(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], c[y - 1, x + 1] if x + 1 < w else c[y, 0], c[y - 1, x - 1])
            out[y, x] -= g
    return joined(out & 255)


def transform(kind, bits, data):
    def write(w):
        w.put(kind, 2)
        w.put(bits - 2, 3)
        put_pixels(w, literals(data), False)

    return write


@pytest.mark.parametrize("seed", range(3))
def test_predictions(seed):
    argb = random_argb(seed + 10, 17, 18)
    modes = np.random.default_rng(seed).permutation(25).reshape(5, 5) % 14
    content = picture(18, 17, transform(0, 2, modes.astype(np.uint32) << 8), last=lambda w: put_pixels(w, literals(residuals(argb, modes, 2)), True))
    assert same(content, argb)


def test_green_and_prediction_together():
    argb = random_argb(20, 6, 7)
    c = channels(argb)
    c[..., 1] -= c[..., 2]
    c[..., 3] -= c[..., 2]
    lowered = joined(c & 255)
    modes = np.full((2, 2), 12)
    content = picture(7, 6, lambda w: w.put(2, 2), transform(0, 2, modes.astype(np.uint32) << 8), last=lambda w: put_pixels(w, literals(residuals(lowered, modes, 2)), True))
    assert same(content, argb)


def test_decorrelated_colours():
    argb, factors = random_argb(21, 8, 8), random_argb(22, 2, 2)
    signed = lambda v: int(v) - 256 if v > 127 else int(v)
    delta = lambda f, v: signed(f) * signed(v) >> 5
    c, f = channels(argb), channels(factors)
    for y in range(8):
        for x in range(8):
            _, red, green, _ = c[y, x]
            _, red_to_blue, green_to_blue, green_to_red = f[y // 4, x // 4]
            c[y, x, 3] -= delta(green_to_blue, green) + delta(red_to_blue, red)
            c[y, x, 1] -= delta(green_to_red, green)
    assert same(picture(8, 8, transform(1, 2, factors), last=lambda w: put_pixels(w, literals(joined(c & 255)), True)), argb)


@pytest.mark.parametrize(("n", "share"), [(2, 3), (4, 2), (11, 1), (60, 0)])
def test_palettes(n, share):
    rng = np.random.default_rng(n)
    colours = random_argb(30, 1, n)[0]
    index = rng.integers(0, n, (5, 13))
    each, per = 8 >> share, 1 << share
    padded = np.pad(index, ((0, 0), (0, -13 % per)))
    packed = sum(padded[:, i::per] << i * each for i in range(per))
    steps = np.diff(channels(colours[None])[0], axis=0, prepend=0) & 255

    def palette(w):
        w.put(3, 2)
        w.put(n - 1, 8)
        put_pixels(w, literals(joined(steps)), False)

    assert same(picture(13, 5, palette, last=lambda w: put_pixels(w, literals(packed.astype(np.uint32) << 8), True)), colours[index])


def test_what_cannot_be_read():
    good = picture(13, 9, last=lambda w: put_pixels(w, literals(random_argb(1)), True))
    for bad in (b"GIF89a", good[:-60], good.replace(b"VP8L", b"VP8 "), good.replace(b"VP8L", b"ANIM"), good[:20] + b"\x00" + good[21:], good[:12]):
        with pytest.raises((ValueError, IndexError)):
            Picture(bad).frame(0)


def test_pictures_are_rows(spark, tmp_path):
    argb = random_argb(40, 40, 40)
    (tmp_path / "a.webp").write_bytes(picture(40, 40, last=lambda w: put_pixels(w, literals(argb), True)))
    (tmp_path / "lossy.webp").write_bytes(b"RIFF\x10\0\0\0WEBPVP8 \x04\0\0\0abcd")
    got = {r["media_id"].rsplit("/", 1)[-1]: r for r in read_frames(spark, str(tmp_path)).collect()}
    assert (got["a.webp"]["hash_hex"], got["a.webp"]["n_frames"], got["a.webp"]["load_error"]) == (hash_pixels(rgb(argb)), 1, None)
    assert got["lossy.webp"]["load_error"] == "ValueError: lossy"
