"""Frames of GIF animations as RGB pixels: Spark's image source reads only the first one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def _unpack(packed: bytes, start_bits: int, wanted: int) -> bytearray:
    """Variable-width LZW codes, lowest bit first."""
    clear, end = 1 << start_bits, (1 << start_bits) + 1
    table: list[bytes] = []
    width, held, have, last = start_bits + 1, 0, 0, b""
    out = bytearray()
    for byte in packed:
        held |= byte << have
        have += 8
        while have >= width and len(out) < wanted:
            code = held & ((1 << width) - 1)
            held >>= width
            have -= width
            if code == clear:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, last = start_bits + 1, b""
                continue
            if code == end:
                return out
            if not table:
                raise ValueError("codes before the first clear code")
            if code > len(table) or (code == len(table) and not last):
                raise ValueError("unknown code")
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return out


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def _row_order(height: int, interlaced: bool) -> list[int]:
    if not interlaced:
        return list(range(height))
    return [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]


@dataclass
class Placed:
    """One frame as the file describes it: where it is drawn, with which colours, and what happens to it afterwards."""

    x: int
    y: int
    w: int
    h: int
    interlaced: bool
    colours: np.ndarray | None
    bits: int
    packed: int
    dispose: int
    clear: int | None


class Animation:
    """A GIF whose frames are found without decoding any; `frame` decodes what its picture depends on and no more.

    A frame's picture depends on those before it back to the last one that starts afresh (drawn over everything, or after
    everything was cleared), but for frames that are taken back or cleared after they were shown. `decoded` counts
    the frames decoded so far. A frame that can't be decoded raises ValueError; later ones are drawn as if it weren't there.
    """

    def __init__(self, data: bytes):
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        if len(data) < 13:
            raise ValueError("cut off")
        self.data, self.decoded = data, 0
        self.width, self.height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
        self.frames: list[Placed] = []
        try:
            self._find()
        except (IndexError, ValueError):
            pass  # cut off: the frames so far count
        self._next, self._canvas = 0, self._empty()

    def __len__(self) -> int:
        return len(self.frames)

    def _empty(self) -> np.ndarray:
        return np.zeros((self.height, self.width, 3), np.uint8)

    def _find(self) -> None:
        data = self.data
        shared, at = _palette(data, 13, data[10])
        dispose, clear = 0, None
        while data[at] != 0x3B:
            if data[at] == 0x21:
                block, after = _blocks(data, at + 2)
                if data[at + 1] == 0xF9:
                    dispose, clear = block[0] >> 2 & 7, block[3] if block[0] & 1 else None
                at = after
                continue
            if data[at] != 0x2C:
                return
            x, y, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
            flags = data[at + 9]
            own, at = _palette(data, at + 10, flags)
            bits, begin = data[at], at + 1
            at = begin
            while data[at]:
                at += 1 + data[at]
            at += 1
            self.frames.append(Placed(x, y, w, h, bool(flags & 0x40), own if own is not None else shared, bits, begin, dispose, clear))
            dispose, clear = 0, None

    def _whole(self, f: Placed) -> bool:
        return f.x == f.y == 0 and f.w >= self.width and f.h >= self.height

    def _afresh(self, i: int) -> bool:
        """Whether the frame's picture depends on no frame before it."""
        f = self.frames[i]
        return i == 0 or (self._whole(f) and f.clear is None) or (self.frames[i - 1].dispose == 2 and self._whole(self.frames[i - 1]))

    def _draw(self, canvas: np.ndarray, f: Placed) -> None:
        self.decoded += 1
        packed, _ = _blocks(self.data, f.packed)
        indices = np.frombuffer(bytes(_unpack(packed, f.bits, f.w * f.h)), np.uint8)
        if f.colours is None or len(indices) < f.w * f.h:
            raise ValueError("pixels or colours are missing")
        rows = np.empty((f.h, f.w), np.uint8)
        rows[_row_order(f.h, f.interlaced)] = indices[: f.w * f.h].reshape(f.h, f.w)
        area = canvas[f.y : f.y + f.h, f.x : f.x + f.w]
        rows = rows[: area.shape[0], : area.shape[1]]
        drawn = np.ones(rows.shape, bool) if f.clear is None else rows != f.clear
        area[drawn] = f.colours[np.minimum(rows, len(f.colours) - 1)][drawn]

    def frame(self, i: int) -> np.ndarray:
        """RGB pixels of frame i. Asking for frames in ascending order decodes each at most once."""
        start = next(k for k in range(i, -1, -1) if self._afresh(k))
        if not start <= self._next <= i:
            self._next, self._canvas = start, self._empty()
        while self._next < i:
            f = self.frames[self._next]
            if f.dispose == 2:
                self._canvas[f.y : f.y + f.h, f.x : f.x + f.w] = 0
            elif f.dispose != 3:
                try:
                    self._draw(self._canvas, f)
                except ValueError:
                    pass
            self._next += 1
        f = self.frames[i]
        shown = self._canvas.copy()
        self._draw(shown, f)
        if f.dispose not in (2, 3):
            self._canvas, self._next = shown.copy(), i + 1
        return shown


def gif_frames(data: bytes) -> Iterator[np.ndarray]:
    """RGB arrays of the frames, without those that can't be decoded."""
    animation = Animation(data)
    for i in range(len(animation)):
        try:
            yield animation.frame(i)
        except ValueError:
            continue
