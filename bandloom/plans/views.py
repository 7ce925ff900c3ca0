"""Named queries over views, served residuals, batches of replicas, reports, and what sources and stores give back."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions import jpeg
from bandloom.functions import transforms as tf
from bandloom.operators import blocks as bl
from bandloom.operators import crops as cr
from bandloom.operators import metrics, sampling, schedule, store
from bandloom.operators import sensitivity as se
from bandloom.plans.catalog import QUERIES, _gradients, _pixel_pairs, _places, _values, images, query, scratch
from bandloom.plans.substrate import BANDS, NPH, NPW, blocks, coefficients, r, shapes, table
from bandloom.sources import archives, reports
from bandloom.streaming.ingest import ingest_images

__all__ = ["QUERIES"]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an image of 8 x 8 in 0..1."""
    pixels = F.transform(F.col("embedding").cast("array<double>"), lambda v: (v + 1) / 2)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", pixels.alias("pixels"))


def _by_place(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", F.posexplode("pixels").alias("i", "v")).select("image_id", "i", r("v").alias("value"))


# --- views and augmentations ---


@query
def crop_resize(spark, sf_dir):
    """Crops of many sizes, each resized to 6 x 3."""
    rows = _vectors(spark, sf_dir).withColumns({"top": (F.col("image_id") % 3).cast("int"), "left": (F.col("image_id") % 2).cast("int"), "crop_h": (3 + F.col("image_id") % 3).cast("int"), "crop_w": (2 + F.col("image_id") % 5).cast("int"), "height": F.lit(8), "width": F.lit(8)})
    return _by_place(store.resized_crops(cr.sliced(rows), 6, 3))


@query
def view_sizes(spark, sf_dir):
    """The sizes of images whose shorter side becomes 128, and of images of at most 160."""
    s = shapes(spark, sf_dir)
    (ah, aw), (bh, bw) = tf.view_size(F.col("height"), F.col("width"), shorter=128), tf.view_size(F.col("height"), F.col("width"), most=160)
    return s.select("image_id", ah.alias("shorter_h"), aw.alias("shorter_w"), bh.alias("most_h"), bw.alias("most_w"))


@query
def grid_crops(spark, sf_dir):
    return sampling.grid_crop(blocks(spark, sf_dir).select("image_id", "patch"), 9, 2, NPH, NPW, 3, 2).select("image_id", "patch", "cell")


@query
def saturated(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.floor(F.col("image_id") / 3).cast("long").alias("image_id"), (F.col("image_id") % 3).alias("c"), "pixels")
    planes = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("c", "pixels"))).alias("p")).where(F.size("p") == 3)
    whole = planes.select("image_id", F.flatten(F.transform("p", lambda x: x["pixels"])).alias("pixels"))
    return _by_place(sampling.saturation(whole, 4, 1, 0.5))


@query
def affine_shifts(spark, sf_dir):
    return _by_place(sampling.affine(_vectors(spark, sf_dir).select("image_id", "pixels"), 6, 3, 1.5))


@query
def nested_masks(spark, sf_dir):
    """How many coefficients each of five nested masks of the block keeps, by row."""
    from bandloom.functions.dims import nested_masks as masks

    return masks(spark, 8, 8, 5).where("kept").groupBy("level", "u").agg(F.count("*").alias("n"))


@query
def row_major_cutoff(spark, sf_dir):
    """Energy that a cut-off in row-major order leaves, by patch."""
    kept = bl.row_major_cut(coefficients(spark, sf_dir).select("image_id", "patch", "z"), 4, F.col("patch") % 16 + 1)
    return kept.groupBy("patch").agg(r(F.sum(tf.array_sum(F.transform("z", lambda v: v * v)))).alias("energy"))


# --- serving, statistics, batches ---


@query
def residual_serve(spark, sf_dir):
    """Pixels of a low-pass base with the stored residuals of two patches put back."""
    path, z = scratch(spark), coefficients(spark, sf_dir).select("image_id", "patch", "z")
    store.write_residual_store(z, path, BANDS, [4, 8])
    base = bl.restored(bl.truncated(z, BANDS, F.lit(4)))
    out = store.residual_serve(spark, base, path, 4, [0, 7])
    return out.select("image_id", "patch", F.posexplode("pixels").alias("i", "v")).select("image_id", "patch", "i", r("v").alias("value"))


@query
def bucket_pilot_stats(spark, sf_dir):
    """Shares of sensitivity by band over all buckets, and by patch in each bucket."""
    g = _gradients(spark, sf_dir).withColumn("bucket_id", (F.col("image_id") % 3).cast("int"))
    return se.bucket_stats(g).select("bucket_id", "kind", "idx", r("value", 9).alias("value"))


@query
def bucket_histogram(spark, sf_dir):
    """Images of each bucket, and how many of the sixteen buckets that were asked for there are."""
    return cr.bucket_histogram(cr.coarse_buckets(shapes(spark, sf_dir), 16), 16)


@query
def equalised_batches(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))
    return sampling.equalised(sampling.shard_batches(e, 48, 10), 3, 8, 2)


@query
def sample_limits(spark, sf_dir):
    return sampling.sample_rows(shapes(spark, sf_dir), 40, seed=13)


@query
def ssim_by_channel(spark, sf_dir):
    """Three grids in a row as channels: SSIM of each, and their mean."""
    pairs = _pixel_pairs(spark, sf_dir).withColumn("channel", (F.col("image_id") % 3).cast("int")).withColumn("image_id", F.floor(F.col("image_id") / 3).cast("long"))
    s = metrics.global_ssim(pairs, ["image_id", "channel"])
    return s.groupBy("image_id").agg(F.count("*").alias("channels"), r(F.avg("ssim"), 9).alias("ssim"))


@query
def store_mismatches(spark, sf_dir):
    """Images that two stores hold, with other labels or shapes in one of them."""
    a = shapes(spark, sf_dir).withColumn("label", (F.col("image_id") % 10).cast("int"))
    b = a.where("image_id % 11 <> 5").withColumn("label", F.expr("if(image_id % 7 = 0, 99, label)")).withColumn("height", F.expr("if(image_id % 5 = 0, height + 1, height)"))
    return metrics.mismatches(a, b)


@query
def fidelity_at(spark, sf_dir):
    """The budget that holds at epochs within and beyond a schedule, and what the schedule is on the whole."""
    s = schedule.budget_schedule(spark, 30, 16, 16, 0.4, 0.9, 1.5)
    asked = spark.range(0, 60, 7).select(F.col("id").cast("int").alias("epoch"))
    held = schedule.held_at(s, asked).select("epoch", "budget")
    return held.crossJoin(F.broadcast(schedule.summary(s, "budget")))


# --- sources ---


@query
def tar_scan(spark, sf_dir):
    """Documents written to archives as samples and read back, the first ten of each archive skipped as stored already."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), F.concat(F.lit("d/k"), F.col("doc_id")).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), (F.col("doc_id") % 10).cast("int").alias("label"))
    names = archives.write_archives(d, scratch(spark).removeprefix("file:"), 40)
    skip = spark.createDataFrame([(n, 10) for n in names], "shard string, done int")
    rows = archives.read_archives(spark, names, skip)
    return rows.select(F.regexp_extract("shard", r"part-(\d+)", 1).cast("int").alias("shard"), "position", "key", F.sha2("content", 256).alias("sha"), "label")


def _encoder(kinds: int):
    """Grids of blocks as grey JPEG files; with kinds, some are progressive and some no JPEG at all."""

    def run(cells: pd.Series, image: pd.Series) -> pd.Series:
        out = []
        for rows, i in zip(cells, image, strict=True):
            q = np.zeros((NPH, NPW, 64), dtype=np.int64)
            for c in rows:
                q[c["patch"] // NPW, c["patch"] % NPW] = c["q"]
            kind = i % kinds
            out.append(b"GIF89a" if kind == 3 else jpeg.encode([q], [(1, 1)], [[1] * 64], 8 * NPH, 8 * NPW, restart=3 * (kind == 1), progressive=kind == 2))
        return pd.Series(out)

    return F.pandas_udf(run, "binary")


def _jpegs(spark: SparkSession, sf_dir: str, kinds: int) -> DataFrame:
    z = coefficients(spark, sf_dir).select("image_id", "patch", F.transform("z", lambda v: F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.rint(v * 50))).cast("int")).alias("q"))
    cells = z.groupBy("image_id").agg(F.collect_list(F.struct("patch", "q")).alias("cells"))
    return cells.select(F.col("image_id").alias("source"), _encoder(kinds)("cells", "image_id").alias("content"))


@query
def jpeg_blocks(spark, sf_dir):
    """Quantised coefficients read from JPEG files. A file is a whole grid; blocks that fill up a last image are not returned."""
    rows = jpeg.decode_blocks(_jpegs(spark, sf_dir, 2)).where("error is null")
    rows = rows.select(F.col("source").alias("image_id"), (F.col("block_row") * NPW + F.col("block_col")).alias("patch"), "coeffs")
    rows = rows.join(blocks(spark, sf_dir).select("image_id", "patch"), ["image_id", "patch"], "left_semi")
    return rows.select("image_id", "patch", F.posexplode("coeffs").alias("pos", "q"))


@query
def jpeg_report(spark, sf_dir):
    out = jpeg.report(jpeg.analysed(_jpegs(spark, sf_dir, 4)))
    return out.select("subsampling", "reason", "files", "blocks", r("zero_share").alias("zero_share"))


@query
def run_histories(spark, sf_dir):
    """Histories written as result files of three ages, and the runs read back from them."""
    e = table(spark, sf_dir, "events").where("value is not null").groupBy((F.col("user_id") % 9).cast("int").alias("run"), (F.col("event_id") % 6).cast("int").alias("epoch")).agg(F.avg(F.abs("value")).alias("acc"))
    lists = e.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("epoch", "acc"))).alias("h")).select("run", F.transform("h", lambda x: x["epoch"].cast("double")).alias("epoch"), F.transform("h", lambda x: F.round(x["acc"], 9)).alias("test_acc"))
    part = F.struct("epoch", "test_acc", F.transform("epoch", lambda x: F.lit(0.5) + x / 100).alias("io_ratio"))
    path, ages = scratch(spark), (("adaptive", lists.where("run % 3 = 0").select("run", part.alias("adaptive"))), ("baseline", lists.where("run % 3 = 1").select("run", part.alias("baseline"))), ("flat", lists.where("run % 3 = 2").select("run", "epoch", "test_acc")))
    for name, rows in ages:
        rows.repartition("run").write.partitionBy("run").json(f"{path}/{name}")
    runs = reports.read_runs(spark, f"{path}/*/*/*.json")
    return runs.select(F.regexp_extract("run", r"=(\d+)", 1).cast("int").alias("run"), "epoch", r("acc", 9).alias("acc"), r("io_ratio", 9).alias("io_ratio"))


@query
def streamed_store(spark, sf_dir):
    """Images that arrive in two files and are streamed into a packed store; a second stream over the same files, without the
    first one's checkpoint, adds nothing. Heads of the store, and the chunks that they own."""
    path = scratch(spark)
    images(spark, sf_dir).withColumn("pixels", F.col("pixels").cast("array<float>")).select("image_id", "label", "height", "width", "pixels").repartition(2, "image_id").write.parquet(f"{path}/in")
    for k in range(2):
        ingest_images(spark, f"{path}/in", f"{path}/store", f"{path}/progress{k}", store.ChunkSpec(tile_blocks=2), records_per_shard=16, files_per_batch=1).awaitTermination()
    heads, chunks, _ = store.open_chunk_store(spark, f"{path}/store")
    owned = heads.join(chunks, ["image_id", "write_id", "shard_id"]).groupBy("image_id").agg(F.count("*").alias("chunks"), F.sum("num_blocks").alias("cells"))
    return heads.select("image_id", "label", "height", "width", "nph", "npw", "num_tiles").join(owned, "image_id")


@query
def crop_read_ops(spark, sf_dir):
    """Reads that crops of a packed store take: runs of consecutive bands of a tile are one."""
    path, spec = scratch(spark), store.ChunkSpec(tile_blocks=2)
    images(spark, sf_dir).write.parquet(f"{path}/source")
    im = spark.read.parquet(f"{path}/source")
    store.write_chunk_store(im, path, spec, records_per_shard=16)
    heads, chunks, spec = store.open_chunk_store(spark, path)
    wanted = im.select("image_id", (F.col("image_id") % 9).cast("int").alias("top"), F.lit(3).alias("left"), F.lit(20).alias("crop_h"), F.lit(18).alias("crop_w"))
    ops = store.crop_bytes(store.crop_reads(heads, chunks, wanted, spec, [0, 1, 3]))
    return ops.select("image_id", "read_ops")


@query
def trial_report(spark, sf_dir):
    """Trials written as JSON and CSV, and read back from both."""
    lost = _values(spark, sf_dir).groupBy("band_id").agg(r(F.sum(F.col("value") ** 2)).alias("energy"))
    path = scratch(spark)
    reports.write_trials([x.asDict() for x in lost.collect()], spark, path)  # a row for each band
    a = spark.read.schema("band_id int, energy double").json(f"{path}/json")
    b = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{path}/csv")
    return a.select(F.lit("json").alias("kind"), "band_id", "energy").unionAll(b.select(F.lit("csv"), F.col("band_id").cast("int"), F.col("energy").cast("double")))


@query
def record_files(spark, sf_dir):
    """Vectors written as files of labelled binary records and as a pair of IDX files, and the images read back from both."""
    folder = scratch(spark).removeprefix("file:")
    os.makedirs(folder)
    v = _vectors(spark, sf_dir).select("image_id", "label", F.transform("pixels", lambda p: F.floor(p * 255).cast("int")).alias("q"))
    rows = v.orderBy("image_id").limit(400).collect()  # small files, written by the driver
    with open(f"{folder}/records.bin", "wb") as a, open(f"{folder}/images.idx", "wb") as b, open(f"{folder}/labels.idx", "wb") as c:
        b.write(bytes(16))
        c.write(bytes(8))
        for x in rows:
            a.write(bytes([7, x["label"], *x["q"]]))
            b.write(bytes(x["q"]))
            c.write(bytes([x["label"]]))
    a = archives.read_labelled_records(spark, f"{folder}/records.bin", 2, 1, 8).select(F.lit("records").alias("kind"), "position", "label", "pixels")
    b = archives.read_idx(spark, f"{folder}/images.idx", f"{folder}/labels.idx", 8).select(F.lit("idx").alias("kind"), "position", "label", "pixels")
    return a.unionAll(b).select("kind", "position", "label", r(tf.array_sum(F.col("pixels"))).alias("total"))


@query
def bucket_canvas(spark, sf_dir):
    """Images of several sizes on the canvas of their bucket."""
    rows = _vectors(spark, sf_dir).withColumns({"height": F.lit(8), "width": F.lit(8), "top": F.lit(0), "left": F.lit(0), "crop_h": (4 + F.col("image_id") % 4).cast("int"), "crop_w": (5 + F.col("image_id") % 3).cast("int")})
    cut = cr.sliced(rows).withColumn("height", F.col("crop_h")).withColumn("width", F.col("crop_w")).withColumn("bucket_id", (F.col("image_id") % 2).cast("int"))
    canvas = cut.groupBy("bucket_id").agg(F.max("height").alias("h"), F.max("width").alias("w"))
    return _by_place(cr.padded(cut.join(F.broadcast(canvas), "bucket_id"), F.col("h"), F.col("w")))


def _bucket_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.operators import quantize

    return quantize.calibrate(_values(spark, sf_dir).withColumn("bucket_id", (F.col("image_id") % 2).cast("int")), ["bucket_id", "band_id"], "percentile", 99.0)


@query
def bucket_scales(spark, sf_dir):
    return _bucket_scales(spark, sf_dir).select("bucket_id", "band_id", r("scale", 9).alias("scale"))


@query
def bucket_scaled_serve(spark, sf_dir):
    """What a bucketed store with scales of its own for each bucket serves of six bands of every block."""
    path, z = scratch(spark), coefficients(spark, sf_dir).select("image_id", "patch", "z")
    store.write_bucket_store(z, _places(spark, sf_dir), path, BANDS, _bucket_scales(spark, sf_dir), tile_blocks=2)
    served, _ = store.read_bucket_store(spark, path, z.select("image_id", "patch", F.lit(6).alias("k")))
    return served.groupBy("image_id").agg(F.count("*").alias("blocks"), r(F.sum(tf.array_sum(F.transform("z", lambda v: v * v))), 3).alias("energy"))


@query
def crop_pixels(spark, sf_dir):
    """Pixels of crops that a packed store serves from three of its bands."""
    path, spec = scratch(spark), store.ChunkSpec(tile_blocks=2)
    images(spark, sf_dir).write.parquet(f"{path}/source")
    im = spark.read.parquet(f"{path}/source")
    store.write_chunk_store(im, path, spec, records_per_shard=16)
    heads, chunks, spec = store.open_chunk_store(spark, path)
    wanted = im.select("image_id", F.lit(5).alias("top"), F.lit(3).alias("left"), F.lit(20).alias("crop_h"), F.lit(18).alias("crop_w"))
    served = store.read_crops(heads, chunks, wanted, spec, [0, 1, 2])
    return served.select("image_id", F.posexplode("pixels").alias("i", "v")).select("image_id", "i", r("v", 4).alias("value"))
