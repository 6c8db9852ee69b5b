"""The PDQ perceptual hash of an image, with its quality: luma, two passes of box filters, 64 x 64 samples, 16 x 16 cosine coefficients, one bit for each above the median. All arithmetic is in 32-bit floats and in a fixed order of sums, vectorised over the other axis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Luma weights, window divisor, passes.
RED, GREEN, BLUE = np.float32(0.299), np.float32(0.587), np.float32(0.114)
WINDOW_DIVISOR = 128
PASSES = 2
SIDE, KEPT = 64, 16


def _basis() -> np.ndarray:
    i, j = np.arange(KEPT)[:, None], np.arange(SIDE)[None, :]
    return (np.float32(np.sqrt(2.0 / SIDE)) * np.cos((np.pi / 2 / SIDE) * (i + 1) * (2 * j + 1))).astype(np.float32)


BASIS = _basis()


def luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.float32) for k in range(3))
    return RED * r + GREEN * g + BLUE * b


def box_filtered(a: np.ndarray, window: int) -> np.ndarray:
    """Means over a centred window along the first axis, smaller at the ends; the running sum adds the entering and then takes the leaving row."""
    n = len(a)
    window = min(window, n)
    half = (window + 2) // 2
    out, total, size = np.empty_like(a), np.zeros(a.shape[1:], np.float32), 0
    left = right = at = 0
    for _ in range(half - 1):
        total = total + a[right]
        size, right = size + 1, right + 1
    for _ in range(window - half + 1):
        total = total + a[right]
        size, right = size + 1, right + 1
        out[at] = total / np.float32(size)
        at += 1
    for _ in range(n - window):
        total = total + a[right]
        total = total - a[left]
        out[at] = total / np.float32(size)
        left, right, at = left + 1, right + 1, at + 1
    for _ in range(half - 1):
        total = total - a[left]
        size -= 1
        out[at] = total / np.float32(size)
        left, at = left + 1, at + 1
    return out


def blurred(a: np.ndarray) -> np.ndarray:
    rows, cols = a.shape
    along_rows, along_cols = -(-cols // WINDOW_DIVISOR), -(-rows // WINDOW_DIVISOR)
    for _ in range(PASSES):
        a = np.ascontiguousarray(box_filtered(np.ascontiguousarray(a.T), along_rows).T)
        a = box_filtered(a, along_cols)
    return a


def sampled(a: np.ndarray) -> np.ndarray:
    at = lambda n: ((np.arange(SIDE) + 0.5) * n / SIDE).astype(np.int64)
    return a[np.ix_(at(a.shape[0]), at(a.shape[1]))]


def quality(a: np.ndarray) -> int:
    """Sum of the gradients, in steps of 1/100 of the range, scaled to at most 100."""
    steps = lambda d: int(np.abs(np.trunc(d * np.float32(100) / np.float32(255)).astype(np.int64)).sum())
    return min(100, (steps(a[:-1] - a[1:]) + steps(a[:, :-1] - a[:, 1:])) // 90)


def coefficients(a: np.ndarray) -> np.ndarray:
    half = np.zeros((KEPT, SIDE), np.float32)
    for k in range(SIDE):
        half += BASIS[:, k : k + 1] * a[k : k + 1, :]
    out = np.zeros((KEPT, KEPT), np.float32)
    for k in range(SIDE):
        out += half[:, k : k + 1] * BASIS[:, k].reshape(1, KEPT)
    return out


def bits(c: np.ndarray) -> str:
    """64 digits; the last row and column come first."""
    flat = c.reshape(-1)
    above = flat > np.partition(flat, 127)[127]
    return np.packbits(above[::-1]).tobytes().hex()


def pdq(rgb: np.ndarray) -> tuple[str, int]:
    """Hash and quality of an image of shape (rows, columns, 3 or 4), 8 bits each."""
    a = sampled(blurred(luma(rgb)))
    return bits(coefficients(a)), quality(a)


def dihedral(rgb: np.ndarray) -> dict[str, str]:
    """The hashes of the image's eight turns and flips, from one set of coefficients."""
    c = coefficients(sampled(blurred(luma(rgb))))
    # Coefficients begin at frequency 1: those of odd frequency (even index) change sign under reflection.
    sign = np.where(np.arange(KEPT) % 2 == 0, -1, 1).astype(np.float32)
    upright = {"original": c, "flip_columns": c * sign[None, :], "flip_rows": c * sign[:, None], "rotate_180": c * sign[None, :] * sign[:, None]}
    turned = {"transpose": c.T, "rotate_90": c.T * sign[:, None], "rotate_270": c.T * sign[None, :], "anti_transpose": c.T * sign[None, :] * sign[:, None]}
    return {k: bits(np.ascontiguousarray(v)) for k, v in (upright | turned).items()}


def hashed(images: DataFrame, key: str = "content_id") -> DataFrame:
    """(key, hash, quality) of the rows (key, height, width, channels, data), as Spark's image source gives them: rows of blue, green, red (and alpha), or of grey."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, h, w, n, data in zip(pdf[key], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = np.repeat(a, 3, axis=2) if n == 1 else a[..., 2::-1]
                out.append((k, *pdq(rgb)))
            yield pd.DataFrame(out, columns=[key, "hash", "quality"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", F.col("nChannels").alias("channels") if "nChannels" in images.columns else F.col("channels"), "data").mapInPandas(run, f"{key} {kind}, hash string, quality int")
