"""Batches, replicas, subsets and augmentations. What is random depends on seeds and keys alone, so reruns agree."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions.dims import Bands
from bandloom.functions.transforms import array_sum, let
from bandloom.operators.crops import draw_key, positions, uniform

Row = TypeVar("Row")


def bucket_batches(rows: DataFrame, batch: int, seed: int | None = None, drop_last: bool = True, bucket: str = "bucket_id", key: str = "image_id") -> DataFrame:
    """rows with batch_no within their bucket and, with a seed, `place`: the order of the whole batches in an epoch.

    Rows of a bucket stay in key order, so a batch reads few chunks. Ranges of a bucket's keys are numbered on their own.
    """
    out = positions(rows, bucket, key).withColumn("batch_no", F.floor(F.col("at") / batch).cast("int"))
    if drop_last:
        out = out.where(F.col("at") < F.floor(F.col("members") / batch) * batch)
    if seed is not None:
        out = out.withColumn("place", draw_key(F.lit(seed), F.col(bucket), F.col("batch_no")))
    return out.drop("at", "members")


def shard_batches(rows: DataFrame, records_per_shard: int, batch: int, drop_last: bool = False, key: str = "image_id", total: int | None = None) -> DataFrame:
    """rows with shard_id and the number of their batch in the shard; ids are dense, so nothing is sorted.

    With drop_last the rest of each shard that fills no batch goes; total is the number of ids then (for the last shard).
    """
    shard = F.floor(F.col(key) / records_per_shard)
    inside = F.col(key) % records_per_shard
    out = rows.withColumn("shard_id", shard.cast("int")).withColumn("batch_no", F.floor(inside / batch).cast("int"))
    if drop_last:
        if total is None:
            raise ValueError("drop_last needs the total")
        size = F.least(F.lit(records_per_shard), total - shard * records_per_shard)
        out = out.where((F.col("batch_no") + 1) * batch <= size)
    return out


def equalised(batches: DataFrame, world: int, seed: int, epoch: int, shard: str = "shard_id") -> DataFrame:
    """batches (shard, batch_no) with the rank that reads each: a shuffled order of whole batches, dealt in turn, and the last ones
    that would give some ranks one more left out, so that all ranks take the same number of steps. Batches, not rows, are
    ordered; place is the step."""
    each = batches.select(shard, "batch_no").distinct().withColumn("draw", draw_key(F.lit(seed), F.lit(epoch), F.col(shard), F.col("batch_no")))
    # by the first two digits of the draw in parts, which are numbered on their own
    each = each.withColumn("part", F.substring("draw", 1, 2))
    counts = each.groupBy("part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # 256 parts
    counts = counts.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("draw", shard, "batch_no")) - 1
    at = each.withColumn("own", own).join(F.broadcast(counts), "part").withColumn("at", F.col("own") + F.col("ahead"))
    at = at.where(F.col("at") < F.floor(F.col("total") / world) * world)
    return at.select(shard, "batch_no", F.pmod("at", F.lit(world)).cast("int").alias("rank"), F.floor(F.col("at") / world).cast("int").alias("place"))


def rank_stride(rows: DataFrame, world: int, rank: int | None = None, key: str = "image_id") -> DataFrame:
    """rows with the rank that reads them, or only one rank's rows."""
    out = rows.withColumn("rank", (F.col(key) % world).cast("int"))
    return out if rank is None else out.where(F.col("rank") == rank)


def reservoir(rows: Iterable[Row], size: int, draw: np.random.Generator) -> Iterator[Row]:
    """rows in a random order that looks `size` of them ahead: each leaves when a later one takes its place, at random."""
    held: list[Row] = []
    for row in rows:
        if len(held) < size:
            held.append(row)
        else:
            k = int(draw.integers(size))
            yield held[k]
            held[k] = row
    draw.shuffle(held)
    yield from held


def buffer_shuffle(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """rows, each partition on its own in the order of a reservoir of `size` rows: one pass without a sort or a shuffle, in memory
    for `size` rows and a batch. The order depends on the seed, the partition's number and its rows' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        each = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
        out = reservoir(each, size, draw)
        while some := list(islice(out, 1024)):
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    return rows.mapInArrow(run, rows.schema)


def random_subset(rows: DataFrame, n: int, seed: int, key: str = "image_id") -> DataFrame:
    """n rows in a random order: a top-n by hash, taken in each partition first."""
    return rows.orderBy(draw_key(F.lit(seed), F.col(key)), key).limit(n)


def sample_rows(rows: DataFrame, n: int, seed: int | None = None, key: str = "image_id") -> DataFrame:
    """n rows, the first by key or, with a seed, random ones; a table without rows is an error."""
    out = rows.orderBy(key).limit(n) if seed is None else random_subset(rows, n, seed, key)
    if out.isEmpty():
        raise ValueError("no samples")
    return out


def flips(rows: DataFrame, seed: int, epoch: int, w: int = 8, pixels: str = "pixels", key: str = "image_id") -> DataFrame:
    """rows whose row-major images of width w are mirrored for half the keys."""

    def mirrored(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(p, (F.floor(i / w) * w + (w - 1) - i % w).cast("int")))

    draw = uniform(F.lit(seed), F.lit(epoch), F.col(key)) < 0.5
    return rows.withColumn(pixels, let(F.col(pixels), lambda p: F.when(draw, mirrored(p)).otherwise(p)))


def jitter(rows: DataFrame, seed: int, epoch: int, strength: float = 0.2, pixels: str = "pixels", key: str = "image_id") -> DataFrame:
    """rows with brightness and contrast changed by up to `strength`, clamped to 0..1."""
    b, c = (1 + strength * (2 * uniform(F.lit(seed), F.lit(epoch), F.col(key), F.lit(i)) - 1) for i in range(2))

    def changed(p: Column, s: Column) -> Column:
        return F.transform(p, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v * s["b"] - s["mean"] * s["b"]) * s["c"] + s["mean"] * s["b"])))

    mean = lambda p: array_sum(p) / F.size(p)
    return rows.withColumn(pixels, let(F.col(pixels), lambda p: let(F.struct(b.alias("b"), c.alias("c"), mean(p).alias("mean")), lambda s: changed(p, s))))


def saturation(rows: DataFrame, seed: int, epoch: int, strength: float = 0.2, pixels: str = "pixels", key: str = "image_id") -> DataFrame:
    """rows whose RGB planes, one after the other, move from or towards their grey by up to `strength`, clamped to 0..1."""
    draw = 1 + strength * (2 * uniform(F.lit(seed), F.lit(epoch), F.col(key), F.lit(4)) - 1)

    def changed(p: Column, s: Column) -> Column:
        n = (F.size(p) / 3).cast("int")

        def pixel(v: Column, i: Column) -> Column:
            at = i % n
            grey = 0.299 * F.get(p, at) + 0.587 * F.get(p, at + n) + 0.114 * F.get(p, at + 2 * n)
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), grey + (v - grey) * s))

        return F.transform(p, pixel)

    return rows.withColumn(pixels, let(F.col(pixels), lambda p: let(draw, lambda s: changed(p, s))))


def _cell(p: Column, y: Column, x: Column, h: int, w: int) -> Column:
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    return F.when(inside, F.get(p, F.greatest(F.lit(0), y * w + x).cast("int"))).otherwise(0.0)


def _moved(rows: DataFrame, dy: Column, dx: Column, h: int, w: int, pixels: str, pixel: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """rows with pixel(old pixels, y, x) at each place, which is moved by dy and dx."""

    def moved(p: Column, d: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: pixel(p, F.floor(i / w) + d["dy"], i % w + d["dx"]))

    return rows.withColumn(pixels, let(F.col(pixels), lambda p: let(F.struct(dy.alias("dy"), dx.alias("dx")), lambda d: moved(p, d))))


def affine(rows: DataFrame, seed: int, epoch: int, most: float, h: int = 8, w: int = 8, pixels: str = "pixels", key: str = "image_id") -> DataFrame:
    """rows moved by up to `most` pixels each way, parts of a pixel too: bilinear, zeros beyond the edge."""
    dy, dx = ((2 * uniform(F.lit(seed), F.lit(epoch), F.col(key), F.lit(i)) - 1) * most for i in (5, 6))

    def pixel(p: Column, y: Column, x: Column) -> Column:
        y0, x0 = F.floor(y), F.floor(x)
        fy, fx = y - y0, x - x0
        row = lambda at: (1 - fx) * _cell(p, at, x0, h, w) + fx * _cell(p, at, x0 + 1, h, w)
        return (1 - fy) * row(y0) + fy * row(y0 + 1)

    return _moved(rows, dy, dx, h, w, pixels, pixel)


def grid_crop(rows: DataFrame, seed: int, epoch: int, nph: int, npw: int, out_h: int, out_w: int, by: str = "patch", key: str = "image_id") -> DataFrame:
    """rows (image, patch) of the out_h x out_w patches of a random place of the grid, with their place in it as `cell`."""
    top, left = (F.floor(uniform(F.lit(seed), F.lit(epoch), F.col(key), F.lit(i)) * (n - out + 1)).cast("int") for i, n, out in ((7, nph, out_h), (8, npw, out_w)))
    y, x = F.floor(F.col(by) / npw).cast("int") - top, F.col(by) % npw - left
    return rows.withColumn("cell", (y * out_w + x).cast("int")).where((y >= 0) & (y < out_h) & (x >= 0) & (x < out_w))


def shifted(rows: DataFrame, seed: int, epoch: int, most: int, h: int = 8, w: int = 8, pixels: str = "pixels", key: str = "image_id") -> DataFrame:
    """rows moved by up to `most` pixels each way, zeros behind: the crop of a zero-padded image."""
    dy, dx = (F.floor(uniform(F.lit(seed), F.lit(epoch), F.col(key), F.lit(i)) * (2 * most + 1)).cast("int") - most for i in (2, 3))
    return _moved(rows, dy, dx, h, w, pixels, lambda p, y, x: _cell(p, y, x, h, w))


def _partners(rows: DataFrame, seed: int, batch: int, pixels: str, key: str) -> DataFrame:
    """rows beside another of their batch of keys: op and ol are its pixels and label."""
    own = Window.partitionBy("batch")
    base = rows.withColumn("batch", F.floor(F.col(key) / batch)).withColumn("at", F.row_number().over(own.orderBy(key)))
    other = base.withColumn("at", F.row_number().over(own.orderBy(draw_key(F.lit(seed), F.col(key)), key)))
    return base.join(other.select("batch", "at", F.col(pixels).alias("op"), F.col("label").alias("ol")), ["batch", "at"])


def _soft(classes: int, smoothing: float, weight: Column) -> Column:
    """The mixed soft labels of label and ol."""

    def one(label: Column, c: Column) -> Column:
        return F.when(label == c, 1 - smoothing).otherwise(0.0) + smoothing / classes

    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: weight * one(F.col("label"), c) + (1 - weight) * one(F.col("ol"), c))


def mixup(rows: DataFrame, classes: int, seed: int, smoothing: float = 0.0, weight: float = 0.7, batch: int = 64, pixels: str = "pixels", key: str = "image_id") -> DataFrame:
    """Rows (key, pixels, target): each image mixed with another of its batch of keys, soft labels mixed alike."""
    both = _partners(rows, seed, batch, pixels, key)
    return both.select(key, F.zip_with(pixels, "op", lambda a, b: weight * a + (1 - weight) * b).alias(pixels), _soft(classes, smoothing, F.lit(weight)).alias("target"))


def cutmix(rows: DataFrame, classes: int, seed: int, smoothing: float = 0.0, side: int = 4, batch: int = 64, h: int = 8, w: int = 8, pixels: str = "pixels", key: str = "image_id") -> DataFrame:
    """Rows (key, pixels, target): a square of another image of the batch at a random place, labels mixed by area."""
    both = _partners(rows, seed, batch, pixels, key)
    top, left = (F.floor(uniform(F.lit(seed), F.col(key), F.lit(i)) * (n - side + 1)).cast("int") for i, n in ((0, h), (1, w)))

    def pasted(s: Column) -> Column:
        def pixel(v: Column, i: Column) -> Column:
            y, x = F.floor(i / w), i % w
            inside = (y >= s["top"]) & (y < s["top"] + side) & (x >= s["left"]) & (x < s["left"] + side)
            return F.when(inside, F.get("op", i)).otherwise(v)

        return F.transform(pixels, pixel)

    mixed = let(F.struct(top.alias("top"), left.alias("left")), pasted)
    return both.select(key, mixed.alias(pixels), _soft(classes, smoothing, F.lit(1 - side * side / (h * w))).alias("target"))


def random_coefficients(rows: DataFrame, kept: int, size: int, seed: int) -> DataFrame:
    """rows (z) with the same `kept` positions of `size` left for all blocks, drawn by hash: the random baseline."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(draw_key(F.lit(seed), i).alias("h"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, kept), lambda x: x["i"])
    return rows.withColumn("z", let(chosen, lambda c: F.transform("z", lambda v, i: F.when(F.array_contains(c, i), v).otherwise(0.0))))


def random_patches(rows: DataFrame, bands: Bands, patches: int, k: Column, q: Column, seed: int) -> DataFrame:
    """rows (patch, z) with `chosen` and what a server of k bands and q patches leaves of z, the patches drawn by hash instead of
    by sensitivity: one order of patches for all images and epochs, whose first q keep all coefficients, the others k bands."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda p: F.struct(draw_key(F.lit(seed), p).alias("h"), p.alias("p"))))
    places = rows.sparkSession.range(1).select(F.posexplode(F.transform(order, lambda x: x["p"])).alias("drawn", "patch"))  # a row for each patch
    width = F.get(F.array(*(F.lit(bands.width(b)) for b in range(bands.count + 1))), k)
    out = rows.join(F.broadcast(places), "patch").withColumn("chosen", F.col("drawn") < q).withColumn("_kept", width)
    return out.withColumn("z", F.transform("z", lambda v, i: F.when(F.col("chosen") | (i < F.col("_kept")), v).otherwise(0.0))).drop("drawn", "_kept")
