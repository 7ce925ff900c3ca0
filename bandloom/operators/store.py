"""Coefficient stores: Parquet tables partitioned by frequency band, packed chunk tables with codecs, and their readers.

A store is a folder with tables and a one-row `metadata` table whose format is checked on opening. Bands are partitions, so a
reader of few bands opens few files; tiles are sorted, so row groups without a wanted tile are skipped.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandloom.functions.batches import IMAGE_BATCH_BYTES, bounded_batches
from bandloom.functions.codec import compress, unpack
from bandloom.functions.dims import CROP_BANDS, Bands, quality_tables, zigzag
from bandloom.functions.transforms import band_slice, quantise, resize_any, to_ycbcr
from bandloom.operators.blocks import restored, split_blocks, transformed
from bandloom.operators.crops import adaptive_chunk, block_rect, coarse_buckets, exact_buckets, overlapping_tiles, positions
from bandloom.operators.quantize import calibrate
from bandloom.operators.sampling import equalised, shard_batches
from bandloom.sources import files, packed

BAND_STORE, RESIDUAL_STORE, SHARD_STORE, CHUNK_STORE, PACKED_STORE = "bandloom_bands_v1", "bandloom_residuals_v1", "bandloom_shards_v1", "bandloom_chunks_v1", "bandloom_packed_v1"


def write_metadata(spark: SparkSession, path: str, format_: str, values: dict[str, str]) -> None:
    spark.createDataFrame([(format_, values)], "format string, options map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def open_metadata(spark: SparkSession, path: str, format_: str) -> dict[str, str]:
    row = spark.read.schema("format string, options map<string,string>").json(f"{path}/metadata").first()
    if row is None or row["format"] != format_:
        raise ValueError(f"{path} holds {row and row['format']!r}, not {format_!r}")
    return row["options"] or {}


def long_bands(coefficients: DataFrame, bands: Bands) -> DataFrame:
    """One row for each block and band: the columns of coefficients without z, band_id and vals."""
    keys = [c for c in coefficients.columns if c != "z"]
    slices = F.array(*(F.struct(F.lit(b).alias("band_id"), band_slice(F.col("z"), bands, b).alias("vals")) for b in range(bands.count)))
    return coefficients.select(*keys, F.explode(slices).alias("s")).select(*keys, "s.band_id", F.col("s.vals").cast("array<float>").alias("vals"))


def write_band_store(coefficients: DataFrame, path: str, bands: Bands, labels: DataFrame | None = None) -> None:
    """coefficients (image_id, patch, ..., z) as one folder for each band, sorted by image and patch."""
    spark = coefficients.sparkSession
    rows = long_bands(coefficients, bands).sortWithinPartitions("band_id", "image_id", "patch")
    rows.write.mode("overwrite").partitionBy("band_id").parquet(f"{path}/bands")
    if labels is not None:
        labels.write.mode("overwrite").parquet(f"{path}/labels")
    write_metadata(spark, path, BAND_STORE, {"edges": ";".join(f"{a},{b}" for a, b in bands.edges)})


def read_band_store(spark: SparkSession, path: str, k: int | None = None) -> tuple[DataFrame, Bands]:
    """(rows of the first k bands, the store's bands); the filter on band_id leaves the other folders unread."""
    options = open_metadata(spark, path, BAND_STORE)
    bands = Bands(tuple(tuple(int(x) for x in e.split(",")) for e in options["edges"].split(";")))
    rows = spark.read.parquet(f"{path}/bands")
    return rows if k is None else rows.where(F.col("band_id") < min(max(k, 0), bands.count)), bands


def gather_bands(rows: DataFrame, bands: Bands, keys: list[str]) -> DataFrame:
    """Rows (keys, z): blocks put together again; bands that are missing are zeros."""
    parts = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("band_id", "vals"))).alias("m"))
    zeros = [F.array_repeat(F.lit(0.0).cast("float"), hi - lo) for lo, hi in bands.edges]
    whole = F.concat(*(F.coalesce(F.try_element_at("m", F.lit(b)), zeros[b]) for b in range(bands.count)))
    return parts.select(*keys, whole.cast("array<double>").alias("z"))


def write_residual_store(coefficients: DataFrame, path: str, bands: Bands, ks: list[int]) -> list[int]:
    """What the first k bands leave out, as pixels of each patch, for every k that leaves something; returns those k."""
    useful = sorted({k for k in ks if 0 < k < bands.count})
    spark = coefficients.sparkSession
    if useful:
        rows = coefficients.crossJoin(F.broadcast(spark.createDataFrame([(k, bands.width(k)) for k in useful], "k int, kept int")))
        rest = rows.withColumn("z", F.transform("z", lambda v, i: F.when(i >= F.col("kept"), v).otherwise(0.0))).drop("kept")
        restored(rest, out="residual").write.mode("overwrite").partitionBy("k", "patch").parquet(f"{path}/residuals")
    write_metadata(spark, path, RESIDUAL_STORE, {"k": ",".join(map(str, useful))})
    return useful


def read_residuals(spark: SparkSession, path: str, k: int, patches: list[int]) -> DataFrame:
    known = open_metadata(spark, path, RESIDUAL_STORE)["k"]
    if str(k) not in known.split(","):
        raise ValueError(f"no residuals for k={k}; there are {known or 'none'}")
    return spark.read.parquet(f"{path}/residuals").where((F.col("k") == k) & F.col("patch").isin(patches))


def write_shard_store(coefficients: DataFrame, path: str, bands: Bands, scales: DataFrame, records_per_shard: int, limit: int = 127) -> None:
    """Quantised bands in shards of consecutive images: partitions by shard and band, no compression of our own."""
    spark = coefficients.sparkSession
    rows = long_bands(coefficients, bands).join(F.broadcast(scales), "band_id")  # a row for each band
    q = F.transform("vals", lambda v: quantise(v, F.col("scale"), limit).cast("short"))
    rows = rows.withColumn("vals", q).drop("scale").withColumn("shard_id", F.floor(F.col("image_id") / records_per_shard).cast("int"))
    rows.repartition("shard_id").sortWithinPartitions("shard_id", "band_id", "image_id", "patch").write.mode("overwrite").partitionBy("shard_id", "band_id").parquet(f"{path}/shards")
    scales.write.mode("overwrite").parquet(f"{path}/scales")
    write_metadata(spark, path, SHARD_STORE, {"edges": ";".join(f"{a},{b}" for a, b in bands.edges), "records_per_shard": str(records_per_shard)})


def read_shard_store(spark: SparkSession, path: str, k: int | None = None, shards: list[int] | None = None) -> DataFrame:
    """Dequantised rows of the first k bands of some shards."""
    open_metadata(spark, path, SHARD_STORE)
    rows = spark.read.parquet(f"{path}/shards")
    if shards is not None:
        rows = rows.where(F.col("shard_id").isin(shards))
    if k is not None:
        rows = rows.where(F.col("band_id") < k)
    scales = F.broadcast(spark.read.parquet(f"{path}/scales"))  # a row for each band
    return rows.join(scales, "band_id").withColumn("vals", F.transform("vals", lambda v: v * F.col("scale"))).drop("scale")


# --- packed chunks: the unit of reading is the band of a tile ---


@dataclass(frozen=True)
class ChunkSpec:
    quality: int = 95
    tile_blocks: int = 4
    block: int = 8
    codec: str = "zstd"
    level: int = 1
    bands: Bands = CROP_BANDS


def _pack(spec: ChunkSpec):
    """Blocks of a tile, in order, three channels each, as little-endian shorts; the DC band as differences along the tile."""

    def run(blocks: pd.Series) -> pd.Series:
        out = []
        for rows in blocks:
            first = rows[0]["vals"]
            a = np.array([r["vals"] for r in rows], dtype=np.int16).reshape(len(rows) // 3, 3, len(first))
            if rows[0]["band_id"] == 0:
                a = np.diff(a, axis=0, prepend=np.zeros((1, *a.shape[1:]), dtype=np.int16))
            out.append(a.astype("<i2").tobytes())
        return pd.Series(out)

    return F.pandas_udf(run, "binary")


def quantised_ycbcr(images: DataFrame, spec: ChunkSpec) -> DataFrame:
    """Rows (image_id, channel, patch, nph, npw, z): quantised coefficients of 8-bit YCbCr planes around zero."""

    def planes(pixels: pd.Series) -> pd.Series:
        out = []
        for p in pixels:
            r, g, b = np.asarray(p, dtype=np.float64).reshape(3, -1) * 255.0
            y, cb, cr = to_ycbcr(r, g, b)
            out.append(np.concatenate([y, cb, cr]) - 128.0)
        return pd.Series(out, dtype=object)

    planes = F.pandas_udf(planes, "array<double>")("pixels")
    z = transformed(split_blocks(images.withColumn("pixels", planes), spec.block, "replicate"))
    tables = quality_tables(spec.quality)[:, list(zigzag(8, 8))]
    steps = F.get(F.array(*(F.array(*(F.lit(int(q)) for q in t)) for t in tables)), F.col("channel"))
    return z.withColumn("z", F.zip_with("z", steps, lambda v, q: quantise(v, q, 32767).cast("short")))


def chunk_tables(images: DataFrame, spec: ChunkSpec) -> tuple[DataFrame, DataFrame]:
    """(images, chunks): one chunk for each tile and band, with its place in the image's payload."""
    blocks = quantised_ycbcr(images, spec)
    tile = F.floor(F.floor(F.col("patch") / F.col("npw")) / spec.tile_blocks) * F.ceil(F.col("npw") / float(spec.tile_blocks)) + F.floor(F.col("patch") % F.col("npw") / spec.tile_blocks)
    rows = blocks.withColumn("tile_id", tile.cast("int"))
    slices = F.array(*(F.struct(F.lit(b).alias("band_id"), band_slice(F.col("z"), spec.bands, b).alias("vals")) for b in range(spec.bands.count)))
    rows = rows.select("image_id", "tile_id", "patch", "channel", F.explode(slices).alias("s"))
    cell = F.struct("patch", "channel", F.col("s.band_id").alias("band_id"), F.col("s.vals").alias("vals"))
    tiles = rows.groupBy("image_id", "tile_id", F.col("s.band_id").cast("short").alias("band_id")).agg(F.sort_array(F.collect_list(cell)).alias("blocks"))
    packed = tiles.select("image_id", "tile_id", "band_id", (F.size("blocks") / 3).cast("int").alias("num_blocks"), _pack(spec)("blocks").alias("raw"))
    packed = packed.select("image_id", "tile_id", "band_id", "num_blocks", F.octet_length("raw").alias("raw_length"), compress("raw", spec.codec, spec.level).alias("payload"))
    packed = packed.withColumn("length", F.octet_length("payload"))
    before = Window.partitionBy("image_id").orderBy("tile_id", "band_id").rowsBetween(Window.unboundedPreceding, -1)
    chunks = packed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    heads = images.withColumns({"nph": F.ceil(F.col("height") / 8.0).cast("int"), "npw": F.ceil(F.col("width") / 8.0).cast("int")})
    per_tile = F.ceil(F.col("nph") / float(spec.tile_blocks)) * F.ceil(F.col("npw") / float(spec.tile_blocks))
    return heads.drop("pixels").withColumn("num_tiles", per_tile.cast("int")), chunks


def write_chunk_store(images: DataFrame, path: str, spec: ChunkSpec, records_per_shard: int = 1024, resume: bool = False) -> None:
    """images (image_id, label, height, width, pixels RGB in 0..1) packed by tile and band, in folders by shard and band.

    Every write has an id that its chunks and its images carry, and readers match both. So chunks of a write that failed before
    its images were listed are never read, and a write that runs again stores each image once: with resume only images that
    the store does not list are added. drop_orphans() deletes what failed writes have left.
    """
    spark = images.sparkSession
    if resume:
        open_metadata(spark, path, CHUNK_STORE)
        images = images.join(spark.read.parquet(f"{path}/images").select("image_id"), "image_id", "left_anti")
    write_id = uuid.uuid4().hex
    heads, chunks = chunk_tables(images, spec)
    heads = heads.withColumn("write_id", F.lit(write_id))
    chunks = chunks.withColumn("write_id", F.lit(write_id))
    shard = F.floor(F.col("image_id") / records_per_shard).cast("int")
    mode = "append" if resume else "overwrite"
    # chunks first: an image that is listed has its chunks
    chunks.withColumn("shard_id", shard).repartition("shard_id").sortWithinPartitions("shard_id", "band_id", "image_id", "tile_id").write.mode(mode).partitionBy("write_id", "shard_id", "band_id").parquet(f"{path}/chunks")
    heads.withColumn("shard_id", shard).write.mode(mode).parquet(f"{path}/images")
    if not resume:
        write_metadata(spark, path, CHUNK_STORE, {"quality": str(spec.quality), "tile_blocks": str(spec.tile_blocks), "codec": spec.codec})


def drop_orphans(spark: SparkSession, path: str) -> list[str]:
    """Deletes the chunks of writes that no image names; not while a write is running. Returns their ids."""
    listed = {r[0] for r in spark.read.parquet(f"{path}/images").select("write_id").distinct().collect()}
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("write_id=")]
    orphans = [f for f in folders if f.getName().removeprefix("write_id=") not in listed]
    for f in orphans:
        fs.delete(f, True)
    return [f.getName().removeprefix("write_id=") for f in orphans]


def open_chunk_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, ChunkSpec]:
    o = open_metadata(spark, path, CHUNK_STORE)
    spec = ChunkSpec(int(o["quality"]), int(o["tile_blocks"]), codec=o["codec"])
    return spark.read.parquet(f"{path}/images"), spark.read.parquet(f"{path}/chunks"), spec


def crop_reads(images: DataFrame, chunks: DataFrame, requests: DataFrame, spec: ChunkSpec, wanted: list[int] | None = None) -> DataFrame:
    """The chunks that requests (image_id, top, left, crop_h, crop_w) touch, with the range of blocks each request needs."""
    heads = images.select("image_id", "shard_id", "write_id", "nph", "npw", "height", "width")
    tiles = overlapping_tiles(block_rect(requests.join(heads, "image_id"), spec.block), spec.tile_blocks)
    chosen = chunks if wanted is None else chunks.where(F.col("band_id").isin(wanted))
    return tiles.join(chosen, ["write_id", "shard_id", "image_id", "tile_id"])


def _unpacker(spec: ChunkSpec):
    codec, edges, t = spec.codec, spec.bands.edges, spec.tile_blocks
    order, tables = list(zigzag(8, 8)), quality_tables(spec.quality)

    def run(payload: pd.Series, raw_length: pd.Series, band: pd.Series, tile: pd.Series, nph: pd.Series, npw: pd.Series) -> pd.Series:
        out = []
        for data, n, b, i, h, w in zip(payload, raw_length, band, tile, nph, npw, strict=True):
            lo, hi = edges[b]
            a = np.frombuffer(unpack(bytes(data), int(n), codec), dtype="<i2").reshape(-1, 3, hi - lo)
            if b == 0:
                a = np.cumsum(a, axis=0, dtype=np.int16)  # wraps as the differences did
            values = a * tables[:, order[lo:hi]]
            cols = -(-int(w) // t)
            r0, c0 = int(i) // cols * t, int(i) % cols * t
            wide = min(t, int(w) - c0)
            patches = [(r0 + j // wide) * int(w) + c0 + j % wide for j in range(len(a))]
            out.append([{"patch": p, "channel": c, "vals": values[j, c].astype(float).tolist()} for j, p in enumerate(patches) for c in range(3)])
        return pd.Series(out)

    return F.pandas_udf(run, "array<struct<patch: int, channel: int, vals: array<double>>>")


def crop_blocks(reads: DataFrame, spec: ChunkSpec) -> DataFrame:
    """Rows (image_id, channel, patch, nph, npw, crop, z) of the blocks that requests need, from crop_reads()."""
    bounded_batches(reads.sparkSession, IMAGE_BATCH_BYTES)
    crop = F.struct("top", "left", "crop_h", "crop_w", "height", "width").alias("crop")
    keys = ["image_id", "nph", "npw", "row0", "row1", "col0", "col1"]
    cells = reads.select(*keys, crop, "band_id", F.explode(_unpacker(spec)("payload", "raw_length", "band_id", "tile_id", "nph", "npw")).alias("b"))
    cells = cells.select(*keys, "crop", "band_id", "b.*")
    row, col = F.floor(F.col("patch") / F.col("npw")), F.col("patch") % F.col("npw")
    inside = cells.where((row >= F.col("row0")) & (row < F.col("row1")) & (col >= F.col("col0")) & (col < F.col("col1")))
    return gather_bands(inside, spec.bands, ["image_id", "crop", "channel", "patch", "nph", "npw"])


def read_crops(images: DataFrame, chunks: DataFrame, requests: DataFrame, spec: ChunkSpec, wanted: list[int] | None = None) -> DataFrame:
    """Rows (image_id, top, left, crop_h, crop_w, pixels RGB): requests served from the bands wanted, clipped to the image."""
    return served_crops(crop_reads(images, chunks, requests, spec, wanted), spec)


def served_crops(reads: DataFrame, spec: ChunkSpec) -> DataFrame:
    """The crops of crop_reads() with the payloads of their chunks."""
    blocks = restored(crop_blocks(reads, spec))
    parts = blocks.groupBy("image_id", "crop", "npw").agg(F.collect_list(F.struct("channel", "patch", "pixels")).alias("b"))
    h = F.least(F.col("crop.crop_h"), F.col("crop.height") - F.col("crop.top"))
    w = F.least(F.col("crop.crop_w"), F.col("crop.width") - F.col("crop.left"))
    parts = parts.select("image_id", "b", "npw", F.col("crop.top").alias("top"), F.col("crop.left").alias("left"), h.alias("crop_h"), w.alias("crop_w"))
    return parts.select("image_id", "top", "left", "crop_h", "crop_w", F.pandas_udf(_crop_pixels, "array<double>")("b", "npw", "top", "left", "crop_h", "crop_w").alias("pixels"))


def resized_crops(crops: DataFrame, out_h: int, out_w: int, antialias: bool = True) -> DataFrame:
    """crops (crop_h, crop_w, pixels in planes) with their pixels resized to out_h x out_w, whatever their size."""
    return crops.withColumn("pixels", resize_any("pixels", "crop_h", "crop_w", F.lit(out_h), F.lit(out_w), antialias))


def residual_serve(spark: SparkSession, base: DataFrame, path: str, k: int, patches: list[int]) -> DataFrame:
    """base (image_id, patch, pixels) of the first k bands with the stored residuals of these patches added; a residual store
    without that k is an error."""
    rest = read_residuals(spark, path, k, patches).select("image_id", "patch", "residual")
    whole = F.zip_with("pixels", F.coalesce("residual", F.transform("pixels", lambda v: F.lit(0.0))), lambda a, b: a + b)
    return base.join(rest, ["image_id", "patch"], "left").withColumn("pixels", whole).drop("residual")


def _crop_pixels(blocks: pd.Series, npw: pd.Series, top: pd.Series, left: pd.Series, crop_h: pd.Series, crop_w: pd.Series) -> pd.Series:
    """RGB in 0..1 of each crop, from the YCbCr blocks that it touches."""
    out = []
    for cells, cols, t, l, h, w in zip(blocks, npw, top, left, crop_h, crop_w, strict=True):
        r0, c0 = t // 8, l // 8
        canvas = np.zeros((3, ((t + h + 7) // 8 - r0) * 8, ((l + w + 7) // 8 - c0) * 8))
        for c in cells:
            y, x = (c["patch"] // cols - r0) * 8, (c["patch"] % cols - c0) * 8
            canvas[c["channel"], y : y + 8, x : x + 8] = np.asarray(c["pixels"]).reshape(8, 8)
        y, cb, cr = canvas[:, t - r0 * 8 : t - r0 * 8 + h, l - c0 * 8 : l - c0 * 8 + w]
        rgb = np.stack([y + 128 + 1.402 * cr, y + 128 - 0.344136 * cb - 0.714136 * cr, y + 128 + 1.772 * cb])
        out.append(np.clip(rgb / 255, 0, 1).ravel())
    return pd.Series(out, dtype=object)


def crop_bytes(reads: DataFrame) -> DataFrame:
    """Rows (image_id, top, left, crop_h, crop_w, bytes_read, read_ops): runs of consecutive bands of a tile are one read."""
    keys = ["image_id", "top", "left", "crop_h", "crop_w"]
    run = F.col("band_id") - F.row_number().over(Window.partitionBy(*keys, "tile_id").orderBy("band_id"))
    runs = reads.withColumn("run", run).groupBy(*keys, "tile_id", "run").agg(F.sum("length").alias("n"))
    return runs.groupBy(*keys).agg(F.sum("n").alias("bytes_read"), F.count("*").alias("read_ops"))


# --- packed stores: chunks in payload files, read by byte ranges ---


def packed_rows(images: DataFrame, spec: ChunkSpec, records_per_shard: int, first_image: int = 0, first_shard: int = 0) -> DataFrame:
    """images (image_id, label, height, width, pixels, and source_key, source_url if they are there) as rows of a packed store;
    shards are numbered from first_shard, that of first_image."""
    heads, chunks = chunk_tables(images, spec)
    shard = (F.floor((F.col("image_id") - first_image) / records_per_shard) + first_shard).cast("int").alias("shard_id")
    head = [f.split()[0] for f in packed.HEAD.split(", ")]
    named = [F.col(c).cast(t) if c in heads.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in packed.HEAD.split(", "))]
    nothing = [F.lit(-1).alias("tile_id"), F.lit(-1).alias("band_id"), F.lit(0).alias("num_blocks"), F.lit(0).alias("raw_length"), F.lit(None).cast("binary").alias("payload")]
    rows = chunks.select(shard, "image_id", "tile_id", F.col("band_id").cast("int"), "num_blocks", "raw_length", "payload", *(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in packed.HEAD.split(", "))))
    return rows.unionByName(heads.select(shard, "image_id", *nothing, *(c.alias(n) for c, n in zip(named, head, strict=True))))


def write_packed_store(images: DataFrame, path: str, spec: ChunkSpec, records_per_shard: int = 1024, contiguous: bool = True, batch: str = "", own_shards: bool = False) -> None:
    """Adds images to a packed store as shards of consecutive images, all or none; see sources.packed. The first write fixes the
    format. With contiguous, images must follow on those that are there; a batch that was added before is not added again. Shards
    are numbered by image, or with own_shards on from the last one that is there."""
    spark = images.sparkSession
    options = {"quality": str(spec.quality), "tile_blocks": str(spec.tile_blocks), "codec": spec.codec, "records_per_shard": str(records_per_shard)}
    if files.names(f"{path}/metadata"):
        if (known := open_metadata(spark, path, PACKED_STORE)) != options:
            raise ValueError(f"{path} holds {known}, not {options}")
    else:
        write_metadata(spark, path, PACKED_STORE, options)
    first_image = first_shard = 0
    if own_shards:
        if batch and any(s["batch"] == batch for s in packed.committed(path)):
            return
        first_image = images.agg(F.min("image_id")).first()[0] or 0
        first_shard = max((s["shard_id"] for s in packed.committed(path)), default=-1) + 1
    packed.write_packed(packed_rows(images, spec, records_per_shard, first_image, first_shard), path, spec.bands.count, contiguous, batch)


def ensured_packed_store(images: DataFrame, path: str, spec: ChunkSpec, records_per_shard: int = 1024) -> str:
    """The folder of a packed store of these images (numbered from 0) in this format below `path`: built if there is none,
    continued by the shards that it lacks if some are there, and left alone if all are. Each format has a folder of its own, so
    another format never spoils a store."""
    told = f"{spec.quality}-{spec.tile_blocks}-{spec.block}-{spec.codec}-{spec.level}-{spec.bands.edges}-{records_per_shard}"
    folder = f"{path}/{hashlib.sha256(told.encode()).hexdigest()[:16]}"
    there = packed.committed(folder)
    following = max((s["last_image"] for s in there), default=-1) + 1
    last = images.agg(F.max("image_id")).first()[0]
    if last is not None and following <= last:
        if following % records_per_shard:
            raise ValueError(f"the last shard of {folder} is not full, so no image can follow on {following - 1}")
        write_packed_store(images.where(F.col("image_id") >= following), folder, spec, records_per_shard)
    return folder


def loader(spark: SparkSession, path: str, requests: DataFrame, batch: int, world: int, seed: int, epoch: int, records_per_shard: int, wanted: list[int] | None = None) -> DataFrame:
    """Rows (rank, place, image_ids, labels, images): the batches of an epoch, stacked, as replicas take them.

    requests: a crop (image_id, top, left, crop_h, crop_w) for each image, all of one size. Batches are runs of images of one shard,
    so a batch reads few ranges; whole batches are shuffled by seed and epoch and dealt so that all ranks take equally many. A
    stack holds `batch` images; its images are arrays of pixels in the order of image_ids.
    """
    heads, _, _ = open_packed_store(spark, path)
    total = heads.count()
    batches = shard_batches(requests, records_per_shard, batch, drop_last=True, total=total)
    dealt = equalised(batches, world, seed, epoch)
    chosen = batches.join(dealt, ["shard_id", "batch_no"])
    reads, spec = packed_reads(spark, path, chosen.select("image_id", "top", "left", "crop_h", "crop_w"), wanted)
    served = served_crops(reads, spec).join(chosen.select("image_id", "rank", "place"), "image_id").join(heads.select("image_id", "label"), "image_id")
    stack = served.groupBy("rank", "place").agg(F.sort_array(F.collect_list(F.struct("image_id", "label", "pixels"))).alias("s"))
    part = lambda name: F.transform("s", lambda x: x[name])
    return stack.select("rank", "place", part("image_id").alias("image_ids"), part("label").alias("labels"), part("pixels").alias("images"))


def open_packed_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, ChunkSpec]:
    """(images, chunks without payloads, format) of what the store's manifest lists."""
    o = open_metadata(spark, path, PACKED_STORE)
    return *packed.packed_index(spark, path), ChunkSpec(int(o["quality"]), int(o["tile_blocks"]), codec=o["codec"])


def packed_reads(spark: SparkSession, path: str, requests: DataFrame, wanted: list[int] | None = None) -> tuple[DataFrame, ChunkSpec]:
    """(the chunks that requests (image_id, top, left, crop_h, crop_w) touch, with their payloads and reads; the store's format).
    Requests meet the index, which has no payloads; only the byte ranges that remain are then read."""
    heads, chunks, spec = open_packed_store(spark, path)
    return packed.fetch(crop_reads(heads, chunks, requests, spec, wanted), path, "top", "left"), spec


def coefficient_rows(chunks: DataFrame, images: DataFrame, spec: ChunkSpec) -> DataFrame:
    """Rows (image_id, band_id, patch, channel, vals): dequantised coefficients of whole chunks."""
    bounded_batches(chunks.sparkSession, IMAGE_BATCH_BYTES)
    rows = chunks.join(images.select("image_id", "write_id", "nph", "npw"), ["image_id", "write_id"])
    cells = rows.select("image_id", "band_id", F.explode(_unpacker(spec)("payload", "raw_length", "band_id", "tile_id", "nph", "npw")).alias("b"))
    return cells.select("image_id", "band_id", "b.*")


# --- bucketed stores: images of one grid together, packed by chunk of images, tile and band ---

BUCKET_STORE = "bandloom_buckets_v1"


def tile_of(patch: Column, npw: Column, tile_blocks: int) -> Column:
    """The tile of a patch, row-major over tiles of tile_blocks x tile_blocks."""
    t = float(tile_blocks)
    return (F.floor(F.floor(patch / npw) / t) * F.ceil(npw / t) + F.floor(patch % npw / t)).cast("int")


def placed(bucketed: DataFrame, chunk: int | Column) -> DataFrame:
    """bucketed (bucket_id, bucket_pos) with chunk_id and the place in the chunk. A chunk may be a column, such as
    adaptive_chunk() of a bucket's largest grid, so the chunk is always stored and never worked out again by a reader."""
    size = F.lit(chunk) if isinstance(chunk, int) else chunk
    return bucketed.withColumn("chunk_id", F.floor(F.col("bucket_pos") / size).cast("int")).withColumn("chunk_pos", (F.col("bucket_pos") % size).cast("int"))


def write_bucket_store(coefficients: DataFrame, places: DataFrame, path: str, bands: Bands, scales: DataFrame, tile_blocks: int = 4, codec: str = "zlib", level: int = 6, limit: int = 127) -> None:
    """coefficients (image_id, patch, z, and channel if there are several) of placed images (image_id, bucket_id, npw, chunk_id,
    chunk_pos) as int8 records of (bucket, chunk, tile, band); a record holds its blocks by image, patch and channel. scales: rows
    (band_id, scale), and bucket_id or channel where each has its own."""
    spark = coefficients.sparkSession
    bounded_batches(spark, IMAGE_BATCH_BYTES)
    block = ["patch", *(c for c in ("channel",) if c in coefficients.columns)]
    rows = long_bands(coefficients.select("image_id", *block, "z").join(places.select("image_id", "bucket_id", "npw", "chunk_id", "chunk_pos"), "image_id"), bands)
    rows = rows.join(F.broadcast(scales), _scale_keys(scales)).withColumn("tile_id", tile_of(F.col("patch"), F.col("npw"), tile_blocks))  # a row for each band
    q = F.transform("vals", lambda v: quantise(v, F.col("scale"), limit))
    cell = F.struct("chunk_pos", *block, "image_id", q.alias("vals"))
    records = rows.groupBy("bucket_id", "band_id", "chunk_id", "tile_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))

    def raw(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: b"".join(np.asarray(x["vals"], dtype=np.int8).tobytes() for x in c))

    keys = F.transform("cells", lambda c: F.struct(*(c[n].alias(n) for n in ("image_id", *block))))
    packed = records.select("bucket_id", "band_id", "chunk_id", "tile_id", keys.alias("blocks"), F.pandas_udf(raw, "binary")("cells").alias("raw"))
    packed = packed.select("bucket_id", "band_id", "chunk_id", "tile_id", "blocks", F.octet_length("raw").alias("raw_length"), compress("raw", codec, level).alias("payload"))
    packed = packed.withColumn("length", F.octet_length("payload"))
    packed.sortWithinPartitions("bucket_id", "band_id", "chunk_id", "tile_id").write.mode("overwrite").partitionBy("bucket_id", "band_id").parquet(f"{path}/records")
    scales.write.mode("overwrite").parquet(f"{path}/scales")
    places.write.mode("overwrite").parquet(f"{path}/images")
    write_metadata(spark, path, BUCKET_STORE, {"edges": ";".join(f"{a},{b}" for a, b in bands.edges), "tile_blocks": str(tile_blocks), "codec": codec})


def write_quantised_store(images: DataFrame, path: str, bands: Bands, buckets: int | None = None, tile_blocks: int = 4, base_chunk: int = 256, most_bytes: int = 1 << 30, stat: str = "max", percentile: float = 99.99, block: int = 8) -> None:
    """images (image_id, height, width, pixels in planes) of any sizes as a bucketed store of int8, in two passes over them.

    Images of one grid are a bucket, or with `buckets` of one area and aspect. They are padded with zeros to the bucket's canvas,
    and a chunk is as many of them as `most_bytes` of working memory hold, base_chunk at most; a record is built in one group, and
    no group is larger than a chunk's tile. The first pass finds each bucket's step for every channel and band, by its largest
    value or a percentile; the second quantises and packs.
    """
    shapes = images.select("image_id", "height", "width")
    if buckets is None:
        placed_ = exact_buckets(shapes, block).withColumns({"canvas_nph": F.col("nph"), "canvas_npw": F.col("npw")})
    else:
        rough = coarse_buckets(shapes, buckets, block)
        placed_ = positions(rough, "bucket_id", "image_id").withColumn("bucket_pos", F.col("at").cast("int")).withColumns({"canvas_nph": F.col("bucket_nph"), "canvas_npw": F.col("bucket_npw")})
    size = adaptive_chunk(base_chunk, most_bytes, F.col("canvas_nph") * block, F.col("canvas_npw") * block)
    chunked = placed(placed_, size).select("image_id", "height", "width", F.col("bucket_id").cast("int").alias("bucket_id"), "bucket_pos", "chunk_id", "chunk_pos", F.col("canvas_nph").cast("int").alias("nph"), F.col("canvas_npw").cast("int").alias("npw"))
    chunked.write.mode("overwrite").parquet(f"{path}/places")
    places = images.sparkSession.read.schema(chunked.schema).parquet(f"{path}/places")
    wide = images.select("image_id", "height", "width", "pixels").join(places.select("image_id", F.col("nph").alias("canvas_nph"), F.col("npw").alias("canvas_npw")), "image_id")
    z = transformed(split_blocks(wide, block, "zero", canvas=(F.col("canvas_nph"), F.col("canvas_npw")))).select("image_id", "channel", "patch", "z")
    values = z.join(places.select("image_id", "bucket_id"), "image_id").select("bucket_id", "channel", F.posexplode("z").alias("pos", "value")).withColumn("band_id", bands.of(F.col("pos")).cast("int"))
    scales = calibrate(values, ["bucket_id", "channel", "band_id"], stat, percentile)
    scales.write.mode("overwrite").parquet(f"{path}/calibration")
    write_bucket_store(z, places, path, bands, images.sparkSession.read.schema(scales.schema).parquet(f"{path}/calibration"), tile_blocks)


def _scale_keys(scales: DataFrame) -> list[str]:
    return [c for c in ("bucket_id", "channel", "band_id") if c in scales.columns]


def read_bucket_store(spark: SparkSession, path: str, alloc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, records): the blocks (image_id, patch, z, and channel if the store has it) that alloc (image_id, patch, k) grants, and the records (length) that
    had to be read for them. A record is read if any of its blocks needs its band; blocks get exactly their k bands."""
    o = open_metadata(spark, path, BUCKET_STORE)
    bounded_batches(spark, IMAGE_BATCH_BYTES)
    bands, t, codec = Bands(tuple(tuple(int(x) for x in e.split(",")) for e in o["edges"].split(";"))), int(o["tile_blocks"]), o["codec"]
    places = spark.read.parquet(f"{path}/images").select("image_id", "bucket_id", "npw", "chunk_id")
    wanted = alloc.where("k > 0").join(places, "image_id").withColumn("tile_id", tile_of(F.col("patch"), F.col("npw"), t))
    needs = wanted.groupBy("bucket_id", "chunk_id", "tile_id").agg(F.max("k").alias("most"))
    records = spark.read.parquet(f"{path}/records").join(needs, ["bucket_id", "chunk_id", "tile_id"]).where(F.col("band_id") < F.col("most"))
    widths = [hi - lo for lo, hi in bands.edges]

    def split(payload: pd.Series, n: pd.Series, band: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(unpack(bytes(p), int(k), codec), dtype=np.int8).reshape(-1, widths[b]).astype(float).tolist() for p, k, b in zip(payload, n, band, strict=True)])

    values = F.pandas_udf(split, "array<array<double>>")("payload", "raw_length", "band_id")
    block = [f for f in records.schema["blocks"].dataType.elementType.names if f != "image_id"]
    cells = records.select("bucket_id", "band_id", F.explode(F.arrays_zip("blocks", values.alias("vals"))).alias("c")).select("bucket_id", "band_id", "c.blocks.image_id", *(f"c.blocks.{n}" for n in block), "c.vals")
    granted = cells.join(alloc, ["image_id", "patch"]).where(F.col("band_id") < F.col("k"))
    scales = spark.read.parquet(f"{path}/scales")
    granted = granted.join(F.broadcast(scales), _scale_keys(scales)).withColumn("vals", F.transform("vals", lambda v: (v * F.col("scale")).cast("float")))
    return gather_bands(granted, bands, ["image_id", *block]), records.select("bucket_id", "chunk_id", "tile_id", "band_id", "length")


def record_reads(alloc: DataFrame, places: DataFrame, bands: int, tile_blocks: int) -> DataFrame:
    """Rows (bucket_id, chunk_id, reads, full_reads): records that an allocation touches, and all of its tiles' records."""
    rows = alloc.join(places.select("image_id", "bucket_id", "npw", "chunk_id"), "image_id").withColumn("tile_id", tile_of(F.col("patch"), F.col("npw"), tile_blocks))
    tiles = rows.groupBy("bucket_id", "chunk_id", "tile_id").agg(F.max("k").alias("most"))
    return tiles.groupBy("bucket_id", "chunk_id").agg(F.sum("most").alias("reads"), (F.count("*") * bands).alias("full_reads"))
