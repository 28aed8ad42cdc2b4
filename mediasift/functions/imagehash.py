"""Perceptual hashes of pixel rows: grey, 32×32 Lanczos, cosine transform, 8×8 low frequencies against their median."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH, FACTOR, SUPPORT = 8, 4, 3.0


@lru_cache(maxsize=8)
def cosine_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II of n points, single precision."""
    frequency = np.arange(n)
    angle = np.outer(frequency, frequency + 0.5) * (np.pi / n)
    norm = np.sqrt(np.where(frequency > 0, 2.0, 1.0) / n)
    return np.einsum("k,kx->kx", norm, np.cos(angle)).astype(np.float32)


@lru_cache(maxsize=256)
def resize_matrix(source: int, target: int) -> np.ndarray:
    """Rows of Lanczos weights that take `source` samples to `target`, widened when shrinking."""
    scale = source / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    low = np.maximum((centre - SUPPORT * wide + 0.5).astype(int), 0)
    high = np.minimum((centre + SUPPORT * wide + 0.5).astype(int), source)
    at = np.arange(source)
    t = (at + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(t) < SUPPORT, np.sinc(t) * np.sinc(t / SUPPORT), 0)
    w[(at < low[:, None]) | (at >= high[:, None])] = 0
    return w / w.sum(axis=1, keepdims=True)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of (height, width, channels) in RGB order, as whole numbers."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    r, g, b = (pixels[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def shrink(image: np.ndarray, size: int) -> np.ndarray:
    """Two passes, rounded to bytes after each."""
    step = np.clip(np.rint(image.astype(np.float64) @ resize_matrix(image.shape[1], size).T), 0, 255)
    return np.clip(np.rint(resize_matrix(image.shape[0], size) @ step), 0, 255).astype(np.float32)


def hash_pixels(pixels: np.ndarray) -> str:
    """16 hex digits of an RGB image; the median leaves out the first row of frequencies."""
    c = cosine_matrix(HASH * FACTOR)
    low = (c @ shrink(grey(pixels), HASH * FACTOR) @ c.T)[:HASH, :HASH]
    bits = (low > np.float32(np.median(low[1:]))).reshape(-1)
    return np.packbits(bits).tobytes().hex()


@F.pandas_udf(T.StringType())
def hash_of_image(image: pd.DataFrame) -> pd.Series:
    """Hash of Spark's image struct (rows of BGR bytes); null where the image could not be decoded."""
    out = []
    for height, width, channels, data in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
        if height is None or height <= 0 or not data:
            out.append(None)
            continue
        rows = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        out.append(hash_pixels(rows[:, :, 2::-1] if channels >= 3 else rows))
    return pd.Series(out)
