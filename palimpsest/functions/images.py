"""Perceptual hashes and differences of grey pictures as Arrow functions.

A picture is a binary column of height x width bytes. Decoding files is up to the plug-in that reads them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import C, _col


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """A picture shrunk or stretched by linear interpolation between pixel middles, averaged first where it shrinks much."""
    x = x.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = x.shape[axis]
        if n >= 2 * size:
            edges = np.linspace(0, n, size + 1)
            total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)], axis=axis)
            at = np.floor(edges).astype(int)
            part = np.expand_dims(edges - at, 1 - axis)
            whole = np.take(total, at, axis) + part * (np.take(total, np.minimum(at + 1, n), axis) - np.take(total, at, axis))
            x = np.diff(whole, axis=axis) / (n / size)
        else:
            pos = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
            lo = np.floor(pos).astype(int)
            part = np.expand_dims(pos - lo, 1 - axis)
            x = np.take(x, lo, axis) * (1 - part) + np.take(x, np.minimum(lo + 1, n - 1), axis) * part
    return x


def _hex(bits: np.ndarray) -> str:
    return f"{sum(int(b) << i for i, b in enumerate(bits.ravel())):016x}"


def dhash(x: np.ndarray) -> str:
    """64 bits: whether each pixel of a 9 x 8 version is darker than the one to its right."""
    s = resized(x, 8, 9)
    return _hex(s[:, :-1] < s[:, 1:])


def phash(x: np.ndarray) -> str:
    """64 bits: whether each low frequency of a 32 x 32 version's cosine transform exceeds their median."""
    s = resized(x, 32, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ s @ basis.T)[:8, :8]
    return _hex(low > np.median(low))


def _hashed(fn):
    @F.pandas_udf(T.StringType())
    def run(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        def one(c, h, w):
            if c is None or h != h or w != w or h * w == 0 or len(c) != int(h) * int(w):
                return None
            return fn(np.frombuffer(c, np.uint8).reshape(int(h), int(w)))

        return pd.Series([one(*x) for x in zip(content, height, width, strict=True)], dtype="object")

    return run


_dhash, _phash = _hashed(dhash), _hashed(phash)


def picture_hashes(content: C, height: C, width: C) -> Column:
    """struct(phash, dhash); null where the picture is missing or of another size."""
    return F.struct(_phash(_col(content), _col(height), _col(width)).alias("phash"), _dhash(_col(content), _col(height), _col(width)).alias("dhash"))


_HEAT = T.StructType([T.StructField("changed_share", T.DoubleType()), T.StructField("mask", T.BinaryType())])


@F.pandas_udf(_HEAT)
def _heat(a: pd.Series, b: pd.Series, height: pd.Series, width: pd.Series, threshold: pd.Series) -> pd.DataFrame:
    def grown(m: np.ndarray) -> np.ndarray:
        p = np.pad(m, 1)
        return np.maximum.reduce([p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)])

    def one(x, y, h, w, t):
        if x is None or y is None or len(x) != len(y) or len(x) != h * w:
            return 1.0 if (x is None) != (y is None) else 0.0, None
        m = np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8)).reshape(h, w) > t
        m = ~grown(~grown(m))  # close small holes
        m = grown(~grown(~m))  # and drop specks
        return float(m.mean()), np.packbits(m).tobytes()

    return pd.DataFrame([one(*r) for r in zip(a, b, height, width, threshold, strict=True)], columns=["changed_share", "mask"])


def heat_map(a: C, b: C, height: C, width: C, threshold: int = 30) -> Column:
    """struct(changed_share, mask): where two pictures of one size differ by more than the threshold, a bit a pixel."""
    return _heat(_col(a), _col(b), _col(height).cast("int"), _col(width).cast("int"), F.lit(threshold))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _ink(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    def one(c, h, w):
        ink = np.argwhere(np.frombuffer(c, np.uint8).reshape(h, w) < 200) if c is not None and len(c) == h * w else ()
        return None if not len(ink) else [float(v) for v in (ink[:, 1].min(), ink[:, 0].min(), ink[:, 1].max() + 1, ink[:, 0].max() + 1)]

    return pd.Series([one(*x) for x in zip(content, height, width, strict=True)], dtype="object")


def ink_box(content: C, height: C, width: C) -> Column:
    """[x0, y0, x1, y1] of the pixels darker than 200; null without any."""
    return _ink(_col(content), _col(height).cast("int"), _col(width).cast("int"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _rules(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    def count(dark: np.ndarray) -> int:
        on = dark.mean(axis=1) > 0.5
        return int(np.sum(on & ~np.append(False, on[:-1])))

    def one(c, h, w):
        if c is None or len(c) != h * w:
            return [0, 0]
        dark = np.frombuffer(c, np.uint8).reshape(h, w) < 128
        return [count(dark), count(dark.T)]

    return pd.Series([one(*x) for x in zip(content, height, width, strict=True)], dtype="object")


def border_changed(a: C, b: C, height: C, width: C) -> Column:
    """struct(changed, lines_a, lines_b): a table's ruled lines, across and down, changed if a count differs by more than 1."""
    x, y = (_rules(_col(c), _col(height).cast("int"), _col(width).cast("int")) for c in (a, b))
    return F.struct(F.exists(F.zip_with(x, y, lambda p, q: F.abs(p - q) > 1), lambda d: d).alias("changed"), x.alias("lines_a"), y.alias("lines_b"))
