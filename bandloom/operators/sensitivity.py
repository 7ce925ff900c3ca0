"""Gradient sensitivity: what a small linear model says about bands and patches, and the cut-offs that follow from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions.dims import Bands
from bandloom.operators.blocks import restored

#: Keeps a sum of nothing from dividing by zero; it also keeps shares just below one.
TINY = 1e-8


def softmax_gradients(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """points (id, label, x) with grad: d loss / d x of a softmax over x . w, from centroids (label, w).

    The transform is orthonormal, so with x in coefficients this is the gradient of the coefficients. The centroids, one row
    for each class, go to the tasks; whole Arrow batches are two matrix products.
    """
    rows = sorted(((r["label"], r["w"]) for r in centroids.collect()), key=lambda r: r[0])
    classes, w = np.array([c for c, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)

    def run(x: pd.Series, label: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        z = np.stack([np.asarray(v, dtype=np.float64) for v in x]) @ w.T
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True) - (classes[None, :] == label.to_numpy()[:, None])
        return pd.Series(list(d @ w))

    return points.withColumn("grad", F.pandas_udf(run, "array<double>")("x", "label"))


def residual_gradients(points: DataFrame, centroids: DataFrame, bands: Bands, k: int) -> DataFrame:
    """points (image_id, patch, label, z) with grad: d loss / d r, as pixels, of the residual r that the first k bands leave out.

    The model sees the served base, the first k bands, and the residual on it; r has no part in these bands, so the gradient
    with respect to it is that of the other coefficients, put back into pixels.
    """
    kept = bands.width(k)
    base = points.withColumn("x", F.transform("z", lambda v, i: F.when(i < kept, v).otherwise(0.0)))
    whole = base.withColumn("x", F.zip_with("x", F.transform("z", lambda v, i: F.when(i >= kept, v).otherwise(0.0)), lambda a, b: a + b))
    g = softmax_gradients(whole, centroids).drop("x")
    return restored(g.withColumn("z", F.transform("grad", lambda v, i: F.when(i >= kept, v).otherwise(0.0))).drop("grad"), out="grad")


def residual_sensitivity(points: DataFrame, centroids: DataFrame, bands: Bands, k: int, by: list[str], step: str = "image_id") -> DataFrame:
    """Rows (by, patch, value): each patch's share of the mean absolute gradient, summed over its pixels, of the residual above k
    bands; steps weigh the same however many rows they have."""
    size = F.aggregate("grad", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("value")
    steps = residual_gradients(points, centroids, bands, k).select(*by, step, "patch", size)
    steps = steps.groupBy(*by, step, "patch").agg(F.avg("value").alias("value"))
    return normalised(step_means(steps, [*by, "patch"], "value", step), by, "value")


def normalised(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each group's values as shares of its sum."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return values.withColumn(value, F.col(value) / (F.sum(value).over(whole) + TINY))


def step_means(values: DataFrame, by: list[str], value: str, step: str = "step") -> DataFrame:
    """The mean over steps of each step's mean: steps weigh the same however many rows they have."""
    return values.groupBy(step, *by).agg(F.avg(value).alias(value)).groupBy(*by).agg(F.avg(value).alias(value))


def band_cutoff(sensitivity: DataFrame, bands: int, share: float) -> DataFrame:
    """Rows (epoch, k): the fewest first bands whose shares reach `share`."""
    upto = F.sum("value").over(Window.partitionBy("epoch").orderBy("idx"))
    below = sensitivity.withColumn("below", F.round(upto, 12) < share)
    return below.groupBy("epoch").agg(F.least(F.count_if("below") + 1, F.lit(bands)).cast("int").alias("k"))


def patch_quota(sensitivity: DataFrame, patches: int, share: float) -> DataFrame:
    """Rows (epoch, q): the fewest patches, most sensitive first, whose shares reach `share`."""
    upto = F.sum("value").over(Window.partitionBy("epoch").orderBy(F.desc(F.round("value", 12)), "idx"))
    below = sensitivity.withColumn("below", F.round(upto, 12) < share)
    return below.groupBy("epoch").agg(F.least(F.count_if("below") + 1, F.lit(patches)).cast("int").alias("q"))


def bucket_stats(gradients: DataFrame) -> DataFrame:
    """Rows (bucket_id, kind, idx, value): shares of mean |gradient| by band over all buckets (bucket_id null), and by patch in
    each bucket. gradients: rows (bucket_id, band_id, patch, g)."""
    bands = gradients.groupBy(F.lit(None).cast("int").alias("bucket_id"), F.lit("band").alias("kind"), F.col("band_id").cast("int").alias("idx")).agg(F.avg(F.abs("g")).alias("value"))
    patches = gradients.groupBy("bucket_id", F.lit("patch").alias("kind"), F.col("patch").cast("int").alias("idx")).agg(F.avg(F.abs("g")).alias("value"))
    return normalised(bands.unionAll(patches), ["bucket_id", "kind"], "value")
