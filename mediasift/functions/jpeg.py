"""Baseline JPEG payloads of RGB pixels, as remote engines take them.

Every channel is kept at full resolution. A block of 8 x 8 samples goes through the cosine transform and is divided by
the quantisation table, and the run lengths of what is left are written in Huffman codes that are made for the image.
All steps but the codes' making work on all blocks of an image at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

QUALITY = 90
#: The quantisation tables that the standard suggests for brightness and colour, by rows.
BRIGHTNESS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: Brightness and colour differences of red, green and blue.
CHANNELS = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
#: Places of a block along its diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
COSINES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
LONGEST_CODE, WHOLE_RUN, END = 16, 0xF0, 0x00


def quantisation(table: tuple[int, ...], quality: int) -> np.ndarray:
    """table for a quality of 1 to 100, by rows."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of the shortest prefix codes of at most LONGEST_CODE bits, none of them all ones.

    Symbols are merged in pairs as many times as a code may have bits (package-merge); one more symbol, which never
    occurs, takes the code of all ones.
    """
    single = [(n, (s,)) for s, n in [(-1, 0), *counts.items()]]
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(LONGEST_CODE):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(packages[::2], packages[1::2], strict=False)]
        packages = sorted(single + pairs)
    found = Counter(s for _, symbols in packages[: 2 * len(single) - 2] for s in symbols)
    return {s: n for s, n in found.items() if s >= 0}


def _codes(counts: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(the table as a file has it, code and length by symbol)."""
    lengths = code_lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, value, width = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        value[s], width[s] = code, size
        code += 1
    per_size = [sum(n == k for n in lengths.values()) for k in range(1, LONGEST_CODE + 1)]
    return bytes(per_size) + bytes(order), value, width


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of each value's magnitude."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _blocks(rgb: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Quantised coefficients (places of the image, 3 channels, 64 in zigzag order)."""
    h, w, _ = rgb.shape
    padded = np.pad(rgb, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    samples = padded @ CHANNELS.T - np.array([128.0, 0.0, 0.0])
    tiles = samples.reshape(samples.shape[0] // 8, 8, samples.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3)
    turned = (COSINES @ tiles @ COSINES.T).reshape(-1, 3, 64)
    return np.rint(turned / np.stack(tables)).astype(np.int64)[:, :, ZIGZAG]


def encode_jpeg(rgb: np.ndarray, quality: int = QUALITY) -> bytes:
    """A JFIF file of rgb (height x width x 3, uint8; one channel counts as grey)."""
    if rgb.ndim == 2 or rgb.shape[2] == 1:
        rgb = np.repeat(rgb.reshape(*rgb.shape[:2], 1), 3, axis=2)
    h, w = rgb.shape[:2]
    if not (0 < h < 1 << 16 and 0 < w < 1 << 16):
        raise ValueError("a JPEG image has 1 to 65535 rows and columns")
    brightness, colour = quantisation(BRIGHTNESS, quality), quantisation(COLOUR, quality)
    found = _blocks(rgb, [brightness, colour, colour])
    flat = found.reshape(-1, 64)  # channel by channel at each place
    kind = np.tile([0, 1, 1], len(found))  # brightness and colour have codes of their own
    steps = np.diff(found[:, :, 0], axis=0, prepend=0).reshape(-1)
    block, place = np.nonzero(flat[:, 1:])
    place += 1
    before = np.where(np.diff(block, prepend=-1) > 0, 0, np.concatenate([[0], place[:-1]]))
    run = place - before - 1
    value = flat[block, place]
    last = np.zeros(len(flat), np.int64)
    np.maximum.at(last, block, place)
    whole = np.repeat(np.arange(len(block)), run // 16)  # runs of sixteen zeros that come before a value
    ended = np.flatnonzero(last < 63)
    n = len(flat)
    # (order, table, symbol, further bits, how many): what is written, block by block
    order = np.concatenate([np.arange(n) * 4096, block[whole] * 4096 + place[whole] * 32, block * 4096 + place * 32 + 1, ended * 4096 + 4095])
    table = np.concatenate([kind, 2 + kind[block[whole]], 2 + kind[block], 2 + kind[ended]])
    symbol = np.concatenate([_sizes(steps), np.full(len(whole), WHOLE_RUN), (run % 16) * 16 + _sizes(value), np.full(len(ended), END)])
    signed = np.concatenate([steps, np.zeros(len(whole), np.int64), value, np.zeros(len(ended), np.int64)])
    at = np.argsort(order, kind="stable")
    table, symbol, signed = table[at], symbol[at], signed[at]
    more = _sizes(signed)
    further = np.where(signed < 0, signed + (1 << more) - 1, signed)
    out, code, width = [], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for t, name in enumerate((0x00, 0x01, 0x10, 0x11)):
        own = table == t
        body, codes, widths = _codes(dict(Counter(symbol[own].tolist())) or {0: 1})
        out.append(_segment(0xC4, bytes([name]) + body))
        code[own], width[own] = codes[symbol[own]], widths[symbol[own]]
    code, width = code << more | further, width + more
    ends = np.cumsum(width)
    shift = np.repeat(ends, width) - 1 - np.arange(int(ends[-1]))
    bits = (np.repeat(code, width) >> shift & 1).astype(np.uint8)
    packed = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    tables = b"".join(_segment(0xDB, bytes([i]) + q[ZIGZAG].astype(np.uint8).tobytes()) for i, q in enumerate((brightness, colour)))
    frame = _segment(0xC0, b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03\x01\x11\x00\x02\x11\x01\x03\x11\x01")
    scan = _segment(0xDA, b"\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00")
    return b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + tables + frame + b"".join(out) + scan + packed + b"\xff\xd9"


def with_jpeg(frames: DataFrame, quality: int = QUALITY, out: str = "jpeg") -> DataFrame:
    """frames (width, height, pixels: rows of RGB) with the JPEG payload of each; null where there are no pixels."""
    kept = [f for f in frames.schema.fields if f.name != out]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("width", "height", "pixels")}
            found = [encode_jpeg(np.frombuffer(p, np.uint8).reshape(h, w, 3), quality) if p else None for w, h, p in zip(*column.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), pa.array(found, pa.binary())], [*(f.name for f in kept), out])

    return frames.mapInArrow(encode, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` binary"]))
