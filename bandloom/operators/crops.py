"""Crops, tiles and shape buckets as column expressions and equi-joins; a crop is (top, left, crop_h, crop_w)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(size: Column, block: int) -> Column:
    return F.ceil(size / F.lit(float(block))).cast("int")


def block_rect(df: DataFrame, block: int = 8, at_least_one: bool = False) -> DataFrame:
    """df (nph, npw and a crop) with row0, row1, col0, col1: the half-open range of blocks that the crop touches."""
    row0, col0 = (F.greatest(F.lit(0), F.floor(F.col(c) / block)).cast("int") for c in ("top", "left"))
    row1 = F.least(F.col("nph"), F.ceil((F.col("top") + F.col("crop_h")) / float(block)).cast("int"))
    col1 = F.least(F.col("npw"), F.ceil((F.col("left") + F.col("crop_w")) / float(block)).cast("int"))
    if at_least_one:
        row1, col1 = F.greatest(row1, F.least(F.col("nph"), row0 + 1)), F.greatest(col1, F.least(F.col("npw"), col0 + 1))
    return df.withColumns({"row0": row0, "row1": row1, "col0": col0, "col1": col1})


def visible(patch: Column, npw: Column) -> Column:
    """Whether a patch lies in the range of block_rect()."""
    row, col = F.floor(patch / npw), patch % npw
    return (row >= F.col("row0")) & (row < F.col("row1")) & (col >= F.col("col0")) & (col < F.col("col1"))


def overlapping_tiles(df: DataFrame, tile_blocks: int = 4) -> DataFrame:
    """df (with block_rect()) once for each tile_id that the crop touches: a sequence to explode instead of a range join."""
    t = F.lit(float(tile_blocks))
    rows = F.sequence(F.floor(F.col("row0") / t).cast("int"), F.ceil(F.col("row1") / t).cast("int") - 1)
    cols = F.sequence(F.floor(F.col("col0") / t).cast("int"), F.ceil(F.col("col1") / t).cast("int") - 1)
    wide = F.ceil(F.col("npw") / t).cast("int")
    some = df.where((F.col("row1") > F.col("row0")) & (F.col("col1") > F.col("col0")))
    return some.withColumn("tr", F.explode(rows)).withColumn("tc", F.explode(cols)).withColumn("tile_id", F.col("tr") * wide + F.col("tc")).drop("tr", "tc")


def centre_crop(df: DataFrame, output: int | None = None, most: int | None = None, block: int | None = None) -> DataFrame:
    """df (height, width) with a deterministic crop in the middle: of `output`, of at most `most`, or the largest square."""
    if output is not None or most is not None:
        size = F.lit(output if output is not None else most)
        ch, cw = F.least(F.col("height"), size), F.least(F.col("width"), size)
    else:
        ch = cw = F.least("height", "width")
    top, left = ((F.col(side) - c) / 2 for side, c in (("height", ch), ("width", cw)))
    top, left = (F.greatest(F.lit(0), F.floor(x)).cast("int") for x in (top, left))
    if block:
        top, left = ((F.floor(x / block) * block).cast("int") for x in (top, left))
    return df.withColumns({"top": top, "left": left, "crop_h": ch.cast("int"), "crop_w": cw.cast("int")})


def draw_key(*parts: Column) -> Column:
    """A random string that depends on the parts alone, by a hash that every engine has, so that draws can be told anywhere."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.conv(F.substring(draw_key(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def positions(rows: DataFrame, group: str, key: str, span: int = 1 << 16) -> DataFrame:
    """rows with `at`, their place in the group by key from 0, and `members` of the group. Keys are whole numbers without large
    gaps: ranges of them are numbered on their own and moved by what is before, so no task has more than `span` rows."""
    rows = rows.withColumn("_part", F.floor(F.col(key) / span))
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy(group)).alias("members"))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key)) - 1
    out = rows.withColumn("_own", own).join(counts, [group, "_part"])
    return out.withColumn("at", F.col("_own") + F.col("_ahead")).select(*rows.drop("_part").columns, "at", "members")


def random_crop(df: DataFrame, seed: int, scale: tuple[float, float] = (0.08, 1.0), ratio: tuple[float, float] = (0.75, 4 / 3), tries: int = 10) -> DataFrame:
    """df (image_id, height, width) with a random crop of random area and aspect, the same on every run for a seed.

    The first of `tries` draws that fits is taken, else the middle square.
    """
    h, w = F.col("height"), F.col("width")

    def draw(t: Column) -> Column:
        u = [uniform(F.lit(seed), F.col("image_id"), t, F.lit(i)) for i in range(4)]
        area = h * w * (scale[0] + (scale[1] - scale[0]) * u[0])
        aspect = F.exp(math.log(ratio[0]) + (math.log(ratio[1]) - math.log(ratio[0])) * u[1])
        cw, ch = F.bround(F.sqrt(area * aspect)).cast("int"), F.bround(F.sqrt(area / aspect)).cast("int")
        top, left = F.floor(u[2] * (h - ch + 1)).cast("int"), F.floor(u[3] * (w - cw + 1)).cast("int")
        return F.struct(top.alias("top"), left.alias("left"), ch.alias("crop_h"), cw.alias("crop_w"))

    draws = F.transform(F.sequence(F.lit(1), F.lit(tries)), draw)
    fit = F.get(F.filter(draws, lambda d: (d["crop_h"] > 0) & (d["crop_h"] <= h) & (d["crop_w"] > 0) & (d["crop_w"] <= w)), F.lit(0))
    side = F.least(h, w)
    middle = F.struct(F.floor((h - side) / 2).cast("int").alias("top"), F.floor((w - side) / 2).cast("int").alias("left"), side.cast("int").alias("crop_h"), side.cast("int").alias("crop_w"))
    return df.withColumn("crop", F.coalesce(fit, middle)).select(*df.columns, "crop.*")


def band_groups(bands: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, first, last, n): runs of consecutive bands (gaps and islands); each is one read."""
    run = F.col("band_id") - F.row_number().over(Window.partitionBy(*by).orderBy("band_id"))
    return bands.withColumn("run", run).groupBy(*by, "run").agg(F.min("band_id").alias("first"), F.max("band_id").alias("last"), F.count("*").alias("n")).drop("run")


def exact_buckets(shapes: DataFrame, block: int = 8) -> DataFrame:
    """shapes (image_id, height, width) with nph, npw, bucket_id (by sorted distinct grid) and bucket_pos (by image_id).

    Grids are few, so they are numbered apart and joined back: no window spans all images.
    """
    rows = shapes.withColumn("nph", grid(F.col("height"), block)).withColumn("npw", grid(F.col("width"), block))
    ids = rows.select("nph", "npw").distinct().withColumn("bucket_id", F.row_number().over(Window.orderBy("nph", "npw")) - 1)
    placed = positions(rows.join(ids, ["nph", "npw"]), "bucket_id", "image_id")
    return placed.withColumn("bucket_pos", F.col("at").cast("int")).drop("at", "members")


def bucket_factors(count: int) -> tuple[int, int]:
    """(area bins, ratio bins) of a power of two."""
    if count <= 0 or count & (count - 1):
        raise ValueError(f"{count} buckets; a power of two is needed")
    ratio = min(8, max(2, 2 ** int(math.log2(math.sqrt(count)))))
    return count // ratio, ratio


def coarse_buckets(shapes: DataFrame, count: int = 16, block: int = 8) -> DataFrame:
    """shapes with bucket_id: quantile bins of log2 area and log2 aspect of the grids, numbered without gaps; and the largest
    grid of the bucket (bucket_nph, bucket_npw)."""
    areas, ratios = bucket_factors(count)
    rows = shapes.withColumn("nph", grid(F.col("height"), block)).withColumn("npw", grid(F.col("width"), block))
    rows = rows.withColumn("area", F.round(F.log2((F.col("nph") * F.col("npw")).cast("double")), 12)).withColumn("aspect", F.round(F.log2(F.col("nph") / F.col("npw")), 12))
    cuts = [F.percentile(c, F.array(*(F.lit(i / n) for i in range(1, n)))).alias(f"{c}_edges") for c, n in (("area", areas), ("aspect", ratios))]
    rows = rows.crossJoin(F.broadcast(rows.agg(*cuts)))  # one row of edges

    def bin_of(c: str) -> Column:
        return F.size(F.filter(f"{c}_edges", lambda e: F.round(e, 12) <= F.col(c)))

    rows = rows.withColumn("raw", bin_of("area") * ratios + bin_of("aspect"))
    known = rows.groupBy("raw").agg(F.max("nph").alias("bucket_nph"), F.max("npw").alias("bucket_npw"))
    known = known.withColumn("bucket_id", F.row_number().over(Window.orderBy("raw")) - 1)
    return rows.join(F.broadcast(known), "raw").select(*shapes.columns, "nph", "npw", "bucket_id", "bucket_nph", "bucket_npw")  # at most `count` buckets


def one_bucket(requests: DataFrame, places: DataFrame, batch: str = "batch_no") -> DataFrame:
    """requests (batch, image_id) with their bucket_id; a batch whose images lie in several buckets, or in none, fails the query,
    as its rows could not be stacked."""
    rows = requests.join(places.select("image_id", "bucket_id"), "image_id", "left")
    kinds = rows.groupBy(batch).agg(F.min("bucket_id").alias("lo"), F.max("bucket_id").alias("hi"), F.count_if(F.col("bucket_id").isNull()).alias("lost"))
    bad = (F.col("lo") != F.col("hi")) | (F.col("lost") > 0)
    only = F.when(bad, F.raise_error(F.concat(F.lit("images of one bucket are needed in batch "), F.col(batch).cast("string")))).otherwise(F.col("lo"))
    return rows.drop("bucket_id").join(kinds.select(batch, only.cast("int").alias("bucket_id")), batch)


def storage_forecast(bucketed: DataFrame, block: int = 8, channels: int = 3) -> DataFrame:
    """Rows (bucket_id, nph, npw, images, patches, blocks, raw_bytes) of one byte for each coefficient."""
    out = bucketed.groupBy("bucket_id").agg(F.max("nph").alias("nph"), F.max("npw").alias("npw"), F.count("*").alias("images"))
    patches = F.col("nph") * F.col("npw")
    blocks = F.col("images") * patches
    return out.select("bucket_id", "nph", "npw", "images", patches.alias("patches"), blocks.alias("blocks"), (blocks * channels * block * block).alias("raw_bytes"))


def adaptive_chunk(base: int, most_bytes: int, height: Column, width: Column) -> Column:
    """Records of a chunk: fewer for large images, one at least."""
    return F.least(F.lit(base), F.greatest(F.lit(1), F.floor(most_bytes / (3.0 * height * width * 4 * 2)))).cast("int")


def sliced(images: DataFrame, pixels: str = "pixels") -> DataFrame:
    """images (height, width, a crop, pixels in planes) with the crop's pixels, clipped to the image."""
    h, w = F.least(F.col("crop_h"), F.col("height") - F.col("top")), F.least(F.col("crop_w"), F.col("width") - F.col("left"))
    rows = images.withColumn("crop_h", h).withColumn("crop_w", w)
    size, area = F.col("crop_h") * F.col("crop_w"), F.col("height") * F.col("width")

    def pixel(i: Column) -> Column:
        at = i % size
        return F.get(pixels, (F.floor(i / size) * area + (F.floor(at / F.col("crop_w")) + F.col("top")) * F.col("width") + at % F.col("crop_w") + F.col("left")).cast("int"))

    planes = (F.size(pixels) / area).cast("int")
    return rows.withColumn(pixels, F.transform(F.sequence(F.lit(0), planes * size - 1), pixel))


def bucket_histogram(bucketed: DataFrame, requested: int) -> DataFrame:
    """Rows (bucket_id, images, share, buckets, requested): how full each bucket is, and how many there are of those asked for."""
    counts = bucketed.groupBy("bucket_id").agg(F.count("*").alias("images"))
    whole = counts.agg(F.sum("images").alias("n"), F.count("*").cast("int").alias("buckets"))
    return counts.crossJoin(F.broadcast(whole)).select("bucket_id", "images", F.round(F.col("images") / F.col("n"), 9).alias("share"), "buckets", F.lit(requested).alias("requested"))


def padded(images: DataFrame, canvas_h: Column, canvas_w: Column, pixels: str = "pixels") -> DataFrame:
    """images (height, width, pixels in planes) on a canvas at least as large, such as their bucket's: the last row and column go
    on. canvas_h and canvas_w are added; height and width stay those of the image."""
    rows = images.withColumn("canvas_h", canvas_h.cast("int")).withColumn("canvas_w", canvas_w.cast("int"))
    size, area = F.col("canvas_h") * F.col("canvas_w"), F.col("height") * F.col("width")

    def pixel(i: Column) -> Column:
        at = i % size
        y, x = F.least(F.floor(at / F.col("canvas_w")), F.col("height") - 1), F.least(at % F.col("canvas_w"), F.col("width") - 1)
        return F.get(pixels, (F.floor(i / size) * area + y * F.col("width") + x).cast("int"))

    planes = (F.size(pixels) / area).cast("int")
    return rows.withColumn(pixels, F.transform(F.sequence(F.lit(0), planes * size - 1), pixel))
