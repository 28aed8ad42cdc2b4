"""Lossless WEBP pictures as RGB pixels; lossy and animated ones have no decoder and raise ValueError.

The bit stream holds transforms, then pixels in prefix codes: literals, copies of earlier pixels, and picks from a cache
of recent colours. The transforms are undone in reverse: prediction from neighbours, decorrelated colours, green
taken off red and blue, and palettes whose indices share a byte.
"""

from __future__ import annotations

import numpy as np

#: The order in which lengths of the code for code lengths are written; sizes of the alphabets before the cache.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREEN, CHANNEL, DISTANCE, LENGTHS = 256, 256, 40, 24
CACHE_FACTOR, BLACK = 0x1E35A7BD, 0xFF000000
#: Offsets (left, up) of near pixels by distance code: from the nearest on, straight up before sideways, left before right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class _Bits:
    """Bits of the stream, lowest first; beyond its end a ValueError."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("cut off")

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.skip(n)
        return value


class _Code:
    """A prefix code, looked up by as many bits as its longest word has."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        if not used:
            raise ValueError("a code without symbols")
        if self.only is not None:
            return
        if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise ValueError("a code that is not complete")
        self.bits = max(n for n, _ in used)
        self.table: list[tuple[int, int]] = [(0, 0)] * (1 << self.bits)
        code, before = 0, 0
        for n, s in sorted(used):
            code <<= n - before
            before = n
            word = int(f"{code:0{n}b}"[::-1], 2)  # words are written highest bit first
            for i in range(word, 1 << self.bits, 1 << n):
                self.table[i] = (s, n)
            code += 1

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.table[bits.peek() & ((1 << self.bits) - 1)]
        bits.skip(n)
        return symbol


def _read_code(bits: _Bits, size: int) -> _Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise ValueError("unknown symbol")
        for s in symbols:
            lengths[s] = 1
        return _Code(lengths)
    of_lengths = [0] * len(LENGTH_ORDER)
    for s in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[s] = bits.read(3)
    code = _Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            last, at = n or last, at + 1
            continue
        value, times = (last, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if at + times > size:
            raise ValueError("too many lengths")
        lengths[at : at + times] = [value] * times
        at += times
    return _Code(lengths)


def _number(bits: _Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and further bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _up(a: int, bits: int) -> int:
    return (a + (1 << bits) - 1) >> bits


def _read_pixels(bits: _Bits, width: int, height: int, whole: bool) -> np.ndarray:
    """ARGB values of an image of the stream; only the whole picture's may use several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("cache too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    block, groups_of, across, groups = 0, None, 0, 1
    if whole and bits.read(1):
        block = bits.read(3) + 2
        across = _up(width, block)
        groups_of = (_read_pixels(bits, across, _up(height, block), False) >> 8 & 0xFFFF).reshape(-1).tolist()
        groups = max(groups_of) + 1
    codes = [[_read_code(bits, n) for n in (GREEN + LENGTHS + len(cache), CHANNEL, CHANNEL, CHANNEL, DISTANCE)] for _ in range(groups)]
    out, n, total = [0] * (width * height), 0, width * height
    while n < total:
        y, x = divmod(n, width)
        green, red, blue, alpha, distance = codes[groups_of[(y >> block) * across + (x >> block)] if groups_of else 0]
        g = green.read(bits)
        if g < GREEN:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            found = [a << 24 | r << 16 | g << 8 | b]
        elif g < GREEN + LENGTHS:
            length, far = _number(bits, g - GREEN), _number(bits, distance.read(bits))
            if far <= len(NEAR):
                left, above = NEAR[far - 1]
                far = max(1, left + above * width)
            else:
                far -= len(NEAR)
            if far > n or n + length > total:
                raise ValueError("a copy from outside the picture")
            found = out[n - far : n - far + length] if far >= length else [out[n - far + i % far] for i in range(length)]
        elif g - GREEN - LENGTHS < len(cache):
            found = [cache[g - GREEN - LENGTHS]]
        else:
            raise ValueError("unknown symbol")
        out[n : n + len(found)] = found
        n += len(found)
        if cache_bits:
            for p in found:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32).reshape(height, width)


def _bytes(argb: np.ndarray) -> np.ndarray:
    """Blue, green, red and alpha of each pixel."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _spread(small: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(small, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def _average(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _half(x: int) -> int:
    return int(x / 2)  # towards zero


def _select(left: tuple, top: tuple, corner: tuple) -> tuple:
    to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
    to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
    return left if to_left < to_top else top


#: Predictions from the pixels to the left, above, above to the right and above to the left, by mode.
PREDICTORS = (
    lambda l, t, r, c: (0, 0, 0, 255),
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _average(_average(l, r), t),
    lambda l, t, r, c: _average(l, c),
    lambda l, t, r, c: _average(l, t),
    lambda l, t, r, c: _average(c, t),
    lambda l, t, r, c: _average(t, r),
    lambda l, t, r, c: _average(_average(l, c), _average(t, r)),
    lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: tuple(_clamp(a + b - x) for a, b, x in zip(l, t, c, strict=True)),
    lambda l, t, r, c: tuple(_clamp(m + _half(m - x)) for m, x in zip(_average(l, t), c, strict=True)),
)


def _unpredict(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    kind = (_spread(modes, bits, height, width) >> 8 & 0xF).reshape(-1).tolist()
    rest = [tuple(p) for p in _bytes(argb).reshape(-1, 4).tolist()]
    out: list[tuple] = []
    for n, p in enumerate(rest):
        if n < width:
            guess = out[-1] if n else (0, 0, 0, 255)
        elif n % width == 0:
            guess = out[n - width]
        else:
            if kind[n] >= len(PREDICTORS):
                raise ValueError("unknown prediction")
            guess = PREDICTORS[kind[n]](out[n - 1], out[n - width], out[n - width + 1], out[n - width - 1])
        out.append(tuple((a + b) & 255 for a, b in zip(p, guess, strict=True)))
    return np.array(out, np.uint8).reshape(height, width, 4).view("<u4").reshape(height, width)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int32)


def _recolour(argb: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    out = _bytes(argb).astype(np.int32)
    green_to_red, green_to_blue, red_to_blue = (_bytes(_spread(factors, bits, *argb.shape))[..., i] for i in range(3))
    delta = lambda factor, value: _signed(factor) * _signed(value) >> 5
    red = out[..., 2] + delta(green_to_red, out[..., 1]) & 255
    out[..., 0] += delta(green_to_blue, out[..., 1]) + delta(red_to_blue, red)
    out[..., 2] = red
    return (out & 255).astype(np.uint8).view("<u4").reshape(argb.shape)


def _add_green(argb: np.ndarray) -> np.ndarray:
    out = _bytes(argb).copy()
    out[..., 0] += out[..., 1]
    out[..., 2] += out[..., 1]
    return out.view("<u4").reshape(argb.shape)


def _from_palette(argb: np.ndarray, colours: np.ndarray, bits: int, width: int) -> np.ndarray:
    packed, each = argb >> 8 & 0xFF, 8 >> bits
    index = np.stack([packed >> i * each & ((1 << each) - 1) for i in range(1 << bits)], 2).reshape(len(argb), -1)[:, :width]
    return np.append(colours, np.zeros(256, np.uint32))[index].astype(np.uint32)


def _decode(bits: _Bits, width: int, height: int) -> np.ndarray:
    undo, used, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in used:
            raise ValueError("a transform twice")
        used.add(kind)
        if kind < 2:
            size = bits.read(3) + 2
            data = _read_pixels(bits, _up(now, size), _up(height, size), False)
            undo.append(lambda p, data=data, size=size, f=(_unpredict, _recolour)[kind]: f(p, data, size))
        elif kind == 2:
            undo.append(_add_green)
        else:
            n = bits.read(8) + 1
            steps = _bytes(_read_pixels(bits, n, 1, False))
            colours = np.cumsum(steps, axis=1, dtype=np.uint8).view("<u4").reshape(-1)
            share = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda p, colours=colours, share=share, was=now: _from_palette(p, colours, share, was))
            now = _up(now, share)
    pixels = _read_pixels(bits, now, height, True)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


class Picture:
    """A lossless WEBP file: one frame, decoded when it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            raise ValueError("not a WEBP")
        at, self.decoded = 12, 0
        while at + 8 <= len(data):
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"VP8L":
                break
            if name in (b"VP8 ", b"ANIM", b"ANMF"):
                raise ValueError("lossy" if name == b"VP8 " else "animated")
            at += 8 + size + size % 2
        else:
            raise ValueError("no picture")
        self.bits = _Bits(data[at + 8 : at + 8 + size])
        if self.bits.read(8) != 0x2F:
            raise ValueError("not a lossless picture")
        self.width, self.height = self.bits.read(14) + 1, self.bits.read(14) + 1
        self.bits.read(1)  # whether there is transparency: pixels are shown without it
        if self.bits.read(3):
            raise ValueError("unknown version")
        self._start = self.bits.at

    def __len__(self) -> int:
        return 1

    def frame(self, i: int) -> np.ndarray:
        self.bits.at = self._start
        self.decoded += 1
        return _bytes(_decode(self.bits, self.width, self.height))[..., 2::-1].copy()
