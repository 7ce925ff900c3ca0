"""Properties and edge cases of the engine's operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import codec, dims
from bandloom.functions import transforms as tf
from bandloom.operators import allocate as al
from bandloom.operators import blocks as bl
from bandloom.operators import crops as cr
from bandloom.operators import keys, quantize, sampling, schedule, store
from bandloom.sources.synthetic import noise_images, smooth_images


def image(spark, h, w, channels=1, value=None):
    pixels = value or [float(i % 251) / 251 for i in range(channels * h * w)]
    return spark.createDataFrame([(1, 0, h, w, pixels)], "image_id long, label int, height int, width int, pixels array<double>")


def test_basis_is_orthonormal_and_zigzag_a_permutation():
    for n in (1, 2, 8, 16):
        assert np.allclose(dims.basis(n) @ dims.basis(n).T, np.eye(n))
    assert dims.zigzag(8, 8)[:8] == (0, 1, 8, 16, 9, 2, 3, 10)
    assert sorted(dims.zigzag(5, 7)) == list(range(35))


def test_bands_take_every_position_once():
    for size, count in ((64, 16), (64, 5), (64, 64), (7, 3)):
        edges = dims.Bands.even(size, count).edges
        assert [p for a, b in edges for p in range(a, b)] == list(range(size))
    with pytest.raises(ValueError):
        dims.Bands.even(4, 5)


def test_quality_tables():
    assert dims.quality_tables(50)[0, 0] == 16 and dims.quality_tables(100).max() == 1 and dims.quality_tables(-3).max() == 255


@pytest.mark.parametrize("padding,h,w,n", [("drop", 19, 17, 4), ("replicate", 19, 17, 9), ("zero", 19, 17, 9), ("drop", 8, 8, 1), ("drop", 7, 30, 0)])
def test_blocks_and_back(spark, padding, h, w, n):
    im = image(spark, h, w, 2)
    b = bl.split_blocks(im, 8, padding)
    assert b.count() == 2 * n
    if n and padding != "drop":
        rows = {r["channel"]: r for r in bl.merge_blocks(b, 8, F.lit(h), F.lit(w)).collect()}
        whole = im.first()["pixels"]
        for c in (0, 1):
            assert rows[c]["pixels"] == pytest.approx(whole[c * h * w : (c + 1) * h * w])


def test_replicate_and_zero_padding_values(spark):
    im = image(spark, 1, 1, 1, [0.5])
    assert bl.split_blocks(im, 8, "replicate").first()["pixels"] == [0.5] * 64
    assert bl.split_blocks(im, 8, "zero").first()["pixels"] == [0.5] + [0.0] * 63


def test_transform_keeps_nulls_and_energy(spark):
    df = spark.createDataFrame([([1.0] * 64,), (None,), ([0.0] * 64,)], "b array<double>")
    rows = [r[0] for r in df.select(tf.dct2("b")).collect()]
    assert rows[1] is None and rows[0][0] == pytest.approx(8.0) and max(map(abs, rows[0][1:])) < 1e-12 and rows[2] == [0.0] * 64


def test_quantise_is_half_even_and_clipped(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (1e9,), (-1e9,)], "v double")
    assert [r[0] for r in df.select(tf.quantise(F.col("v"), F.lit(1.0), 127)).collect()] == [0, 2, 0, 127, -128]


def test_dpcm_wraps_and_comes_back(spark):
    values = [32767, -32768, 0, 32767, -1]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "image_id int, patch int, dc int")
    d = quantize.dpcm(df, ["image_id"], "patch", "dc")
    assert all(-32768 <= r["delta"] <= 32767 for r in d.collect())
    assert [r["restored"] for r in quantize.undpcm(d, ["image_id"], "patch").orderBy("patch").collect()] == values


@pytest.mark.parametrize("name", codec.CODECS)
def test_codecs(spark, name):
    df = spark.createDataFrame([(bytearray(b"abc" * 100),), (bytearray(),), (None,)], "raw binary")
    packed = df.select("raw", F.octet_length("raw").alias("n"), codec.compress("raw", name).alias("p"))
    rows = packed.where("raw is not null").select("raw", codec.decompress("p", "n", name).alias("back")).collect()
    assert all(r["raw"] == r["back"] for r in rows)
    with pytest.raises(Exception, match="corrupt record"):
        packed.where("n > 0").select(codec.decompress("p", F.col("n") + 1, name)).collect()
    with pytest.raises(ValueError):
        codec.compress("raw", "rar")


def signal(spark, images=3, patches=4):
    return spark.createDataFrame([(i, p, 1.0 + (i * 7 + p * 3) % 5) for i in range(images) for p in range(patches)], "image_id long, patch int, signal double")


@pytest.mark.parametrize("ratio,k_low", [(0.0, 1), (0.5, 0), (0.5, 1), (1.0, 2), (0.3, 8)])
@pytest.mark.parametrize("policy", ["greedy", "gradient", "static", "random"])
def test_allocations_stay_in_budget(spark, ratio, k_low, policy):
    f = al.Fidelity(8, k_low=k_low, ratio=ratio, policy=policy)
    rows = al.allocate(signal(spark), f, spark.createDataFrame([(b, 1.0 / (b + 1)) for b in range(8)], "band_id int, weight double")).collect()
    assert len(rows) == 12 and all(k_low <= r["k"] <= 8 for r in rows)
    wanted = max(4 * k_low, round(ratio * 32))
    for i in range(3):
        total = sum(r["k"] for r in rows if r["image_id"] == i)
        assert total == wanted if policy == "greedy" else total <= wanted + 8 - k_low


def test_ties_fill_patches_in_order(spark):
    s = spark.createDataFrame([(0, p, 1.0) for p in range(4)], "image_id long, patch int, signal double")
    rows = al.allocate(s, al.Fidelity(4, k_low=1, budget=10)).orderBy("patch").collect()
    assert [r["k"] for r in rows] == [4, 4, 1, 1]


def test_no_requests(spark):
    empty = signal(spark).where("false")
    assert al.allocate(empty, al.Fidelity(8, ratio=0.5)).count() == 0
    assert cr.exact_buckets(spark.createDataFrame([], "image_id long, height int, width int")).count() == 0


def test_bad_fidelity():
    with pytest.raises(ValueError):
        al.Fidelity(4, k_low=5)
    with pytest.raises(ValueError):
        al.Fidelity(4, policy="best")


def test_uniform_prefix():
    assert [al.prefix_for_ratio(16, r) for r in (0, 0.01, 0.5, 0.51, 1, 3)] == [1, 1, 8, 9, 16, 16]


def test_crops_at_the_border(spark):
    df = spark.createDataFrame([(1, 64, 48, 0, 0, 64, 48), (2, 64, 48, 60, 44, 30, 30), (3, 8, 8, 0, 0, 1, 1)], "image_id long, height int, width int, top int, left int, crop_h int, crop_w int")
    df = df.withColumn("nph", cr.grid(F.col("height"), 8)).withColumn("npw", cr.grid(F.col("width"), 8))
    rows = {r["image_id"]: r for r in cr.block_rect(df).collect()}
    assert (rows[1]["row0"], rows[1]["row1"], rows[1]["col0"], rows[1]["col1"]) == (0, 8, 0, 6)
    assert (rows[2]["row0"], rows[2]["row1"], rows[2]["col0"], rows[2]["col1"]) == (7, 8, 5, 6)
    tiles = cr.overlapping_tiles(cr.block_rect(df), 4)
    assert sorted((r["image_id"], r["tile_id"]) for r in tiles.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 3), (3, 0)]
    assert "BroadcastNestedLoopJoin" not in tiles._jdf.queryExecution().toString()


def test_band_groups_with_gaps(spark):
    df = spark.createDataFrame([(1, b) for b in (0, 2, 3, 7)], "image_id int, band_id int")
    assert sorted(tuple(r) for r in cr.band_groups(df, ["image_id"]).select("first", "last", "n").collect()) == [(0, 0, 1), (2, 3, 2), (7, 7, 1)]


def test_bucket_factors():
    assert [cr.bucket_factors(n) for n in (8, 16, 32, 64)] == [(4, 2), (4, 4), (8, 4), (8, 8)]
    with pytest.raises(ValueError):
        cr.bucket_factors(12)


def test_isotonic_fit(spark):
    df = spark.createDataFrame(list(enumerate([3, 1, 2, 4, 4, 3, 9])), "epoch int, k int")
    assert [r["fitted"] for r in schedule.isotonic(df, "k").orderBy("epoch").collect()] == pytest.approx([2, 2, 2, 11 / 3, 11 / 3, 11 / 3, 9])


def test_schedule_never_falls_and_stays_in_range(spark):
    df = spark.createDataFrame(list(enumerate([5, 9, 2, 14])), "epoch int, k int")
    ks = [r["k"] for r in schedule.pilot_schedule(df, "k", 30, 16).orderBy("epoch").collect()]
    assert ks == sorted(ks) and ks[-1] == 16 and ks[0] >= 1
    one = schedule.pilot_schedule(df.where("epoch = 0"), "k", 5, 16).orderBy("epoch").collect()
    assert [r["k"] for r in one] == [5] * 5


def test_batches(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "image_id long, bucket_id int")
    rows = sampling.bucket_batches(df, 4, seed=1).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["bucket_id"], r["batch_no"], r["place"]), []).append(r["image_id"])
    assert all(len(v) == 4 for v in sizes.values()) and len(rows) == 48
    kept = sampling.shard_batches(df, 16, 5, drop_last=True, total=50).groupBy("shard_id", "batch_no").count().collect()
    assert all(r["count"] == 5 for r in kept) and sum(r["count"] for r in kept) == 45
    assert sampling.rank_stride(df, 4, 1).count() == 13
    assert sampling.random_subset(df, 7, 3).count() == 7


def test_missing_keys_are_errors(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "key string"), spark.createDataFrame([("x", 1)], "key string, v int")
    assert [r[0] for r in keys.missing_keys(a, b, "key").collect()] == ["y"]
    with pytest.raises(KeyError):
        keys.by_key(b, a, "key", strict=True)


# --- stores ---


def test_band_store_prunes_bands(spark, tmp_path):
    z = bl.transformed(bl.split_blocks(image(spark, 32, 24)))
    bands, path = dims.Bands.even(64, 16), str(tmp_path / "bands")
    store.write_band_store(z, path, bands)
    rows, known = store.read_band_store(spark, path, 3)
    assert known == bands and "PartitionFilters: [isnotnull(band_id" in rows._jdf.queryExecution().toString()
    assert rows.select("band_id").distinct().count() == 3
    whole, _ = store.read_band_store(spark, path)
    back = store.gather_bands(whole, bands, ["image_id", "channel", "patch"]).join(z.select("image_id", "channel", "patch", F.col("z").alias("want")), ["image_id", "channel", "patch"])
    assert back.select(F.max(tf.squared_error(F.col("z"), F.col("want")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        store.open_metadata(spark, path, store.CHUNK_STORE)


def test_residual_store(spark, tmp_path):
    z, bands, path = bl.transformed(bl.split_blocks(image(spark, 32, 24))), dims.Bands.even(64, 8), str(tmp_path / "r")
    assert store.write_residual_store(z, path, bands, [8]) == []
    assert store.write_residual_store(z, path, bands, [2, 4, 9, 2]) == [2, 4]
    assert store.read_residuals(spark, path, 2, [0, 5]).count() == 2
    with pytest.raises(ValueError):
        store.read_residuals(spark, path, 3, [0])


def test_smooth_images_survive_the_chunk_store(spark, tmp_path):
    im, path = smooth_images(spark).cache(), str(tmp_path / "chunks")
    store.write_chunk_store(im, path, store.ChunkSpec(), records_per_shard=2)
    heads, chunks, spec = store.open_chunk_store(spark, path)
    assert {r["image_id"]: r["label"] for r in heads.collect()} == {0: 3, 1: 5, 2: 7}
    whole = im.select("image_id", F.lit(0).alias("top"), F.lit(0).alias("left"), F.col("height").alias("crop_h"), F.col("width").alias("crop_w"))
    served = store.read_crops(heads, chunks, whole, spec).join(im.select("image_id", F.col("pixels").alias("want")), "image_id")
    mse = [r[0] for r in served.select((tf.squared_error(F.col("pixels"), F.col("want")) / F.size("want"))).collect()]
    assert len(mse) == 3 and -10 * np.log10(np.mean(mse)) >= 40
    crop = im.select("image_id", *(F.lit(v).alias(n) for n, v in (("top", 16), ("left", 16), ("crop_h", 64), ("crop_w", 64))))
    cost = [{r["image_id"]: (r["bytes_read"], r["read_ops"]) for r in store.crop_bytes(store.crop_reads(heads, chunks, crop, spec, b)).collect()} for b in (None, [0, 1, 2], [0, 2])]
    assert all(cost[0][i][0] > cost[1][i][0] for i in range(3))
    assert all(cost[2][i][1] == 2 * cost[0][i][1] for i in range(3))  # a gap makes two reads of each tile
    more = noise_images(spark, 2).withColumn("image_id", F.col("image_id") + 2)
    store.write_chunk_store(more, path, spec, records_per_shard=2, resume=True)
    heads, _, _ = store.open_chunk_store(spark, path)
    assert sorted(r["image_id"] for r in heads.collect()) == [0, 1, 2, 3]


def test_store_prunes_shards_and_bands(spark, tmp_path):
    z, bands, path = bl.transformed(bl.split_blocks(noise_images(spark, 5))), dims.Bands.even(64, 16), str(tmp_path / "s")
    values = z.select(F.posexplode("z").alias("pos", "value")).withColumn("band_id", bands.of(F.col("pos")))
    store.write_shard_store(z, path, bands, quantize.calibrate(values, ["band_id"]), 2)
    rows = store.read_shard_store(spark, path, k=4, shards=[1])
    assert {(r["shard_id"], r["band_id"]) for r in rows.select("shard_id", "band_id").distinct().collect()} == {(1, b) for b in range(4)}


@pytest.mark.parametrize("share", [0.0, 0.37, 0.5, 0.9999, 1.0])
def test_exact_percentiles(spark, share):
    """Also where one value is most of a group, and where all values are one."""
    from bandloom.operators.metrics import percentile

    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=501), 1: np.full(40, 2.5), 2: np.r_[np.full(900, 1.0), rng.random(100) * 1e6], 3: np.array([7.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(1, None)], "g int, v double")
    for r in percentile(df, ["g"], F.col("v"), share, bins=64).collect():
        assert r["percentile"] == pytest.approx(np.percentile(groups[r["g"]], share * 100), rel=1e-12)


def test_resize_of_any_size_is_that_of_a_fixed_size(spark):
    rows = spark.createDataFrame([(i, h, w, np.random.default_rng(i).random(2 * h * w).tolist()) for i, (h, w) in enumerate([(8, 8), (5, 9), (20, 3), (1, 1)])], "id int, h int, w int, p array<double>")
    for anti in (True, False):
        for r in rows.select("id", "h", "w", "p", tf.resize_any("p", "h", "w", F.lit(4), F.lit(6), anti).alias("q")).collect():
            planes = np.array(r["p"]).reshape(2, r["h"], r["w"])
            want = np.stack([tf.resize_weights(r["h"], 4, anti) @ x @ tf.resize_weights(r["w"], 6, anti).T for x in planes])
            assert r["q"] == pytest.approx(want.ravel())


def test_places_in_groups(spark):
    df = spark.createDataFrame([(i * 7, i % 3) for i in range(100)], "k long, g int")
    rows = cr.positions(df, "g", "k", span=10).collect()
    for g in range(3):
        mine = sorted((r["k"], r["at"], r["members"]) for r in rows if r["g"] == g)
        assert [x[1] for x in mine] == list(range(len(mine))) and {x[2] for x in mine} == {len(mine)}


def test_equalised_ranks_take_the_same_steps(spark):
    b = spark.range(23).selectExpr("cast(id % 5 as int) as shard_id", "cast(id as int) as batch_no")
    rows = sampling.equalised(b, 4, 1, 0).collect()
    assert len(rows) == 20 and sorted((r["rank"], r["place"]) for r in rows) == [(k, i) for k in range(4) for i in range(5)]
    assert sorted(map(tuple, rows)) != sorted(map(tuple, sampling.equalised(b, 4, 1, 1).collect()))


@pytest.mark.parametrize("share", [0.0, 0.37, 0.95, 0.9999, 1.0])
def test_percentile_is_exact_in_two_passes(spark, share):
    from bandloom.operators import metrics

    r = np.random.default_rng(2)
    groups = {0: r.normal(size=501) ** 3, 1: np.array([0.0, -0.0, 5e-324, -1e300, 1e300, 2.0, 2.0, 2.0]), 2: np.array([4.0]), 3: np.repeat([1.0, 1.5, -3.0], 40)}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [(0, None)], "g int, v double")
    got = {x["g"]: x["percentile"] for x in metrics.percentile(rows, ["g"], F.col("v"), share).collect()}
    assert got == {g: pytest.approx(float(np.quantile(v, share)), rel=1e-12, abs=1e-300) for g, v in groups.items()}
    scans = metrics.percentile(rows, ["g"], F.col("v"), share)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans <= 2


def test_io_report_reads_once(spark):
    from bandloom.operators import metrics

    rows = spark.createDataFrame([(k % 2, (k * 7919) % 50, 100) for k in range(301)] + [(2, None, 10)], "g int, bytes int, full int")
    out = metrics.io_report(rows, ["g"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    for x in out.collect():
        v = np.array([(k * 7919) % 50 for k in range(301) if k % 2 == x["g"]], float)
        if x["g"] == 2:
            assert (x["reads"], x["bytes_read"], x["p95_bytes"]) == (1, None, None)
        else:
            assert (x["reads"], x["bytes_read"], x["avg_bytes"], x["p95_bytes"]) == (len(v), v.sum(), pytest.approx(v.mean()), pytest.approx(np.quantile(v, 0.95)))
