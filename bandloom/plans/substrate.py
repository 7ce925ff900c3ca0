"""The driver's tables as images: an embedding of 64 numbers is an 8 x 8 block, 20 of them in a row are an image of 5 x 4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions.dims import Bands
from bandloom.operators.blocks import transformed

PATCHES, NPH, NPW = 20, 5, 4
BANDS = Bands.even(64, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    image, patch = F.floor(F.col("vec_id") / PATCHES).cast("long"), (F.col("vec_id") % PATCHES).cast("int")
    return e.select(image.alias("image_id"), patch.alias("patch"), "label", F.col("embedding").cast("array<double>").alias("pixels"))


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(blocks(spark, sf_dir))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image shapes from documents: (image_id, height, width)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("image_id"), (64 + F.col("n_chars") % 193).cast("int").alias("height"), (64 + F.col("doc_id") * 37 % 193).cast("int").alias("width"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop for each shape, some beyond the border."""
    s = shapes(spark, sf_dir)
    top, left = F.col("image_id") * 13 % F.col("height"), F.col("image_id") * 29 % F.col("width")
    return s.select("*", top.cast("int").alias("top"), left.cast("int").alias("left"), (8 + F.col("image_id") * 7 % 120).cast("int").alias("crop_h"), (8 + F.col("image_id") * 11 % 120).cast("int").alias("crop_w"))


def band_weights(spark: SparkSession) -> DataFrame:
    return spark.range(BANDS.count).select(F.col("id").cast("int").alias("band_id"), (1.0 / (1.0 + F.col("id"))).alias("weight"))


def patch_weights(spark: SparkSession) -> DataFrame:
    return spark.range(PATCHES).select(F.col("id").cast("int").alias("patch"), ((1.0 + F.col("id") % 5) / 60.0).alias("weight"))


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)
