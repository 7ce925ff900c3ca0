"""Synthetic images by formula, the same on every run: rows (image_id, label, height, width, pixels RGB in 0..1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Height, width, label and phase of three smooth images.
SMOOTH = ((96, 128, 3, 0.1), (111, 143, 5, 0.4), (160, 112, 7, 0.7))


def smooth_images(spark: SparkSession, rows: tuple[tuple[int, int, int, float], ...] = SMOOTH) -> DataFrame:
    """Slow ramps and waves in each channel, clamped to 0..1."""
    base = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "image_id long, height int, width int, label int, phase double")
    n = F.col("height") * F.col("width")

    def pixel(i: Column) -> Column:
        at = i % n
        y, x = F.floor(at / F.col("width")) / (F.col("height") - 1), (at % F.col("width")) / (F.col("width") - 1)
        p, c = F.col("phase"), F.floor(i / n)
        red = 0.65 * x + 0.25 * y + 0.1 * F.sin(8 * (x + p))
        green = 0.35 * x + 0.55 * y + 0.1 * F.cos(7 * (y + p))
        blue = 0.45 * (1 - x) + 0.35 * y + 0.08 * F.sin(10 * (x + y))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c == 0, red).when(c == 1, green).otherwise(blue))).cast("float")

    return base.select("image_id", "label", "height", "width", F.transform(F.sequence(F.lit(0), 3 * n - 1), pixel).alias("pixels"))


def noise_images(spark: SparkSession, count: int, seed: int = 42, base: tuple[int, int] = (72, 64), steps: tuple[int, int] = (8, 16)) -> DataFrame:
    """Uniform noise by hash, in sizes that vary with the id."""
    ids = spark.range(count).select(F.col("id").alias("image_id"), (F.col("id") % 10).cast("int").alias("label"), (base[0] + F.col("id") % 5 * steps[0]).cast("int").alias("height"), (base[1] + F.col("id") % 3 * steps[1]).cast("int").alias("width"))
    value = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("image_id"), i), F.lit(256)) / 255.0).cast("float")
    return ids.withColumn("pixels", F.transform(F.sequence(F.lit(0), 3 * F.col("height") * F.col("width") - 1), value))
