"""Images to blocks and back, and what a block table can tell: signals, truncations and residuals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions.batches import IMAGE_BATCH_BYTES, bounded_batches
from bandloom.functions.dims import Bands, zigzag
from bandloom.functions.transforms import array_sum, dct2, from_zigzag, idct2, keep_prefix, mean_abs, positions_of, squared_error, to_zigzag

PADDING = ("drop", "replicate", "zero")


def _splitter(block: int, padding: str):
    """Images of any shape to their blocks, channel by channel and row by row."""

    def run(pixels: pd.Series, height: pd.Series, width: pd.Series, nph: pd.Series, npw: pd.Series) -> pd.Series:
        out = []
        for p, h, w, rows, cols in zip(pixels, height, width, nph, npw, strict=True):
            a = np.asarray(p, dtype=np.float64).reshape(-1, h, w)
            tall, wide = rows * block, cols * block
            if padding == "zero":
                canvas = np.zeros((len(a), tall, wide))
                canvas[:, : min(h, tall), : min(w, wide)] = a[:, :tall, :wide]
                a = canvas
            else:
                a = a[:, np.minimum(np.arange(tall), h - 1)][:, :, np.minimum(np.arange(wide), w - 1)]
            cut = a.reshape(len(a), rows, block, cols, block).transpose(0, 1, 3, 2, 4)
            out.append(list(cut.reshape(-1, block * block)))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<array<double>>")


def split_blocks(images: DataFrame, block: int = 8, padding: str = "drop", canvas: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows (image_id, channel, patch, nph, npw, pixels) of images (image_id, height, width, pixels in channel, row, column
    order). Remainders are dropped, replicated from the edge or filled with zeros; a canvas (nph, npw) may be larger.

    An image is cut once, in an Arrow batch, and only its blocks are exploded: no row carries the image beside a block.
    """
    if padding not in PADDING:
        raise ValueError(f"unknown padding {padding!r}")
    bounded_batches(images.sparkSession, IMAGE_BATCH_BYTES)
    h, w = F.col("height"), F.col("width")
    rows, cols = canvas or tuple((F.floor(s / block) if padding == "drop" else F.ceil(s / float(block))).cast("int") for s in (h, w))
    df = images.select("image_id", "height", "width", "pixels", rows.alias("nph"), cols.alias("npw")).where((F.col("nph") > 0) & (F.col("npw") > 0))
    cut = df.select("image_id", "nph", "npw", _splitter(block, padding)("pixels", "height", "width", "nph", "npw").alias("blocks"))
    each = cut.select("image_id", "nph", "npw", F.posexplode("blocks").alias("at", "pixels"))
    patches = F.col("nph") * F.col("npw")
    return each.select("image_id", F.floor(F.col("at") / patches).cast("int").alias("channel"), (F.col("at") % patches).cast("int").alias("patch"), "nph", "npw", "pixels")


def _merger(block: int):
    def run(blocks: pd.Series, nph: pd.Series, npw: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for cells, rows, cols, h, w in zip(blocks, nph, npw, height, width, strict=True):
            plane = np.zeros((rows * cols, block * block))
            for c in cells:
                plane[c["patch"]] = c["pixels"]
            whole = plane.reshape(rows, cols, block, block).transpose(0, 2, 1, 3).reshape(rows * block, cols * block)
            out.append(whole[:h, :w].ravel())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")


def merge_blocks(blocks: DataFrame, block: int = 8, height: Column | None = None, width: Column | None = None) -> DataFrame:
    """Rows (image_id, channel, height, width, pixels): one plane for each image and channel, cut to height x width if given;
    blocks that are missing are zeros."""
    bounded_batches(blocks.sparkSession, IMAGE_BATCH_BYTES)
    h, w = (F.max(c) if c is not None else F.max(F.col(n) * block) for c, n in ((height, "nph"), (width, "npw")))
    plane = blocks.groupBy("image_id", "channel", "nph", "npw").agg(F.collect_list(F.struct("patch", "pixels")).alias("b"), h.cast("int").alias("height"), w.cast("int").alias("width"))
    return plane.select("image_id", "channel", "height", "width", _merger(block)("b", "nph", "npw", "height", "width").alias("pixels"))


def transformed(blocks: DataFrame) -> DataFrame:
    """blocks with z: the block's DCT coefficients in zig-zag order, instead of its pixels."""
    bounded_batches(blocks.sparkSession, IMAGE_BATCH_BYTES)
    return blocks.withColumn("z", to_zigzag(dct2("pixels"))).drop("pixels")


def restored(blocks: DataFrame, z: str = "z", out: str = "pixels") -> DataFrame:
    bounded_batches(blocks.sparkSession, IMAGE_BATCH_BYTES)
    return blocks.withColumn(out, idct2(from_zigzag(F.col(z)))).drop(z)


def patch_signal(coefficients: DataFrame) -> DataFrame:
    """Rows (image_id, patch, signal): mean |coefficient| over channels and frequencies."""
    return coefficients.groupBy("image_id", "patch").agg(F.avg(mean_abs(F.col("z"))).alias("signal"))


def truncated(coefficients: DataFrame, bands: Bands, k: Column) -> DataFrame:
    """coefficients with zeros beyond the first k bands of each block."""
    return coefficients.withColumn("z", keep_prefix(F.col("z"), positions_of(bands, k)))


def residual_energy(coefficients: DataFrame, bands: Bands, k: int) -> DataFrame:
    """Rows (patch, energy): mean over images of what the first k bands leave out of a patch (by Parseval, in coefficients)."""
    lost = array_sum(F.transform(F.col("z"), lambda v, i: F.when(i >= bands.width(k), v * v).otherwise(0.0)))
    return coefficients.groupBy("image_id", "patch").agg(F.sum(lost).alias("e")).groupBy("patch").agg(F.avg("e").alias("energy"))


def serve_kq(coefficients: DataFrame, bands: Bands, k: int, q: int, patches: int, patch_weights: DataFrame | None = None) -> DataFrame:
    """coefficients of a low-pass base of k bands with the q most important patches in full.

    Importance is the weight (patch, weight) if given, else the residual energy. With all bands or all patches nothing is cut.
    """
    if k >= bands.count or q >= patches:
        return coefficients
    worth = patch_weights.select("patch", "weight") if patch_weights is not None else residual_energy(coefficients, bands, k).select("patch", F.col("energy").alias("weight"))
    top = worth.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("weight", 12)), "patch"))).where(F.col("place") <= q)
    full = coefficients.join(F.broadcast(top.select("patch", F.lit(True).alias("full"))), "patch", "left")  # at most q patches
    return truncated(full, bands, F.when(F.col("full"), bands.count).otherwise(k)).drop("full").select(*coefficients.columns)


def serve(coefficients: DataFrame, alloc: DataFrame, bands: Bands) -> DataFrame:
    """coefficients of the allocated patches (image_id, patch, k), each cut to its first k bands."""
    return truncated(coefficients.join(alloc, ["image_id", "patch"]), bands, F.col("k"))


def serve_error(coefficients: DataFrame, alloc: DataFrame, bands: Bands, by: list[str]) -> DataFrame:
    """Rows (by, sq_error, values) of serving an allocation (image_id, patch, k): the transform is orthonormal, so the squared
    error of the pixels is that of the coefficients that are left out, and nothing is transformed back."""
    kept = positions_of(bands, F.col("k"))
    lost = array_sum(F.transform("z", lambda v, i: F.when(i >= kept, v * v).otherwise(0.0)))
    return coefficients.join(alloc, ["image_id", "patch"]).groupBy(*by).agg(F.sum(lost).alias("sq_error"), F.sum(F.size("z")).alias("values"))


def served_quality(coefficients: DataFrame, served: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, sq_error, values): squared pixel error of what was served, after both sides' inverse transforms."""
    keys = ["image_id", "channel", "patch"] if "channel" in coefficients.columns else ["image_id", "patch"]
    a = restored(coefficients.select(*keys, "z"), out="full")
    b = restored(served.select(*keys, "z"), out="cut")
    both = a.join(b, keys)
    return both.groupBy(*by).agg(F.sum(squared_error(F.col("full"), F.col("cut"))).alias("sq_error"), F.sum(F.size("full")).alias("values"))


def row_major_cut(coefficients: DataFrame, band_size: int, k: Column) -> DataFrame:
    """coefficients with zeros at all but the first k * band_size places in row-major order, instead of zig-zag order."""
    order = F.array(*(F.lit(int(i)) for i in zigzag(8, 8)))
    return coefficients.withColumn("z", F.transform("z", lambda v, i: F.when(F.get(order, i) < k * band_size, v).otherwise(0.0)))
