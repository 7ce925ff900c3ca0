"""Array transforms of blocks. The DCT is a matrix product over Arrow batches; everything else is built of SQL expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bandloom.functions.dims import Bands, basis, zigzag


def _kernel(h: int, w: int, inverse: bool):
    """A pandas function that multiplies whole batches of h x w blocks with the separable basis."""
    rows, cols = basis(h), basis(w)
    whole = np.kron(rows, cols)  # row-major: coefficient (u, v) of pixel (y, x)
    matrix = whole if inverse else whole.T

    def run(blocks: pd.Series) -> pd.Series:
        present = [b for b in blocks if b is not None]
        if not present:
            return pd.Series([None] * len(blocks), dtype=object)
        done = iter(np.stack([np.asarray(b, dtype=np.float64) for b in present]) @ matrix)
        return pd.Series([None if b is None else next(done) for b in blocks], dtype=object)

    return run


def dct2(block: Column | str, h: int = 8, w: int = 8) -> Column:
    """Orthonormal 2-D DCT of a row-major block; null stays null."""
    return F.pandas_udf(_kernel(h, w, False), "array<double>")(block)


def idct2(coefficients: Column | str, h: int = 8, w: int = 8) -> Column:
    return F.pandas_udf(_kernel(h, w, True), "array<double>")(coefficients)


def _gather(values: Column, order: Sequence[int]) -> Column:
    return F.array(*(F.get(values, F.lit(int(i))) for i in order))


def to_zigzag(c: Column, h: int = 8, w: int = 8) -> Column:
    return _gather(c, zigzag(h, w))


def from_zigzag(z: Column, h: int = 8, w: int = 8) -> Column:
    """Natural order again; positions that z does not reach become zero."""
    back = np.argsort(zigzag(h, w))
    return F.array(*(F.coalesce(F.get(z, F.lit(int(i))), F.lit(0.0)) for i in back))


def band_slice(z: Column, bands: Bands, b: int) -> Column:
    lo, hi = bands.edges[b]
    return F.slice(z, lo + 1, hi - lo)


def keep_prefix(z: Column, kept: Column) -> Column:
    """z with zeros from position `kept` on."""
    return F.transform(z, lambda v, i: F.when(i < kept, v).otherwise(0.0))


def positions_of(bands: Bands, k: Column) -> Column:
    """Zig-zag positions of the first k bands."""
    ends = F.array(*(F.lit(bands.width(i)) for i in range(bands.count + 1)))
    return F.get(ends, F.least(F.greatest(k, F.lit(0)), F.lit(bands.count)).cast("int"))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean_abs(values: Column) -> Column:
    return array_sum(F.transform(values, F.abs)) / F.size(values)


def squared_error(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def quantise(value: Column, scale: Column, limit: int) -> Column:
    """Nearest step, half to even, clipped to [-limit - 1, limit]; a whole number."""
    return F.greatest(F.lit(float(-limit - 1)), F.least(F.lit(float(limit)), F.rint(value / scale))).cast("int")


def wrap16(value: Column) -> Column:
    """Two's complement of 16 bits, as integer arithmetic on short arrays gives it."""
    return (F.pmod(value + 32768, F.lit(65536)) - 32768).cast("int")


def to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """JFIF luminance and chrominance of channels in 0..255."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y, -0.168736 * r - 0.331264 * g + 0.5 * b + 128.0, 0.5 * r - 0.418688 * g - 0.081312 * b + 128.0


def from_ycbcr(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Channels in 0..1, clamped."""
    channels = y + 1.402 * (cr - 128.0), y - 0.344136 * (cb - 128.0) - 0.714136 * (cr - 128.0), y + 1.772 * (cb - 128.0)
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / 255.0)) for c in channels)


def pad_index(at: Column, size: Column) -> Column:
    """Replicate padding: the place to read instead of one beyond the edge."""
    return F.greatest(F.lit(0), F.least(at, size - 1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for a row, also where body uses it in a lambda of its own."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def denormalise(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def resize_weights(n_in: int, n_out: int, antialias: bool) -> np.ndarray:
    """(n_out, n_in) weights of a bilinear resize with pixel centres at half; with antialias the filter widens when shrinking."""
    scale = n_in / n_out
    centre = (np.arange(n_out) + 0.5) * scale - 0.5
    if not antialias or scale <= 1:
        centre = np.clip(centre, 0, n_in - 1)
        support = 1.0
    else:
        support = scale
    weights = np.maximum(0, 1 - np.abs(np.arange(n_in)[None, :] - centre[:, None]) / support)
    return weights / weights.sum(axis=1, keepdims=True)


def view_size(height: Column, width: Column, shorter: int | None = None, most: int | None = None) -> tuple[Column, Column]:
    """(height, width) of a view: the shorter side becomes `shorter`, or a longer side above `most` becomes `most`."""
    side = F.least(height, width) if shorter is not None else F.greatest(height, width)
    goal = F.lit(shorter) if shorter is not None else F.least(F.lit(most), side)
    scaled = lambda n: F.when(n == side, goal).otherwise(F.greatest(F.lit(1), F.floor(n * goal / side + 0.5))).cast("int")
    return scaled(height), scaled(width)


def resize_any(pixels: Column | str, h: Column | str, w: Column | str, out_h: Column, out_w: Column, antialias: bool = True) -> Column:
    """Separable bilinear resize of row-major planes of any size, one after the other, over Arrow batches."""

    def run(images: pd.Series, h: pd.Series, w: pd.Series, oh: pd.Series, ow: pd.Series) -> pd.Series:
        weights = lru_cache(256)(resize_weights)
        out = []
        for x, a, b, c, d in zip(images, h, w, oh, ow, strict=True):
            if x is None:
                out.append(None)
                continue
            planes = np.asarray(x, dtype=np.float64).reshape(-1, a, b)
            out.append((weights(a, c, antialias) @ planes @ weights(b, d, antialias).T).ravel())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(pixels, h, w, out_h, out_w)


def resize(block: Column | str, h: int, w: int, out_h: int, out_w: int, antialias: bool = True) -> Column:
    """Separable bilinear resize of a row-major image of fixed size, over Arrow batches."""
    matrix = np.kron(resize_weights(h, out_h, antialias), resize_weights(w, out_w, antialias)).T

    def run(images: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([np.asarray(x, dtype=np.float64) for x in images]) @ matrix)) if len(images) else pd.Series([], dtype=object)

    return F.pandas_udf(run, "array<double>")(block)
