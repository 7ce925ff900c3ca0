"""Scans with a manifest, shuffles by reservoir, isotonic fits, residual gradients, replicas and the quantised store."""

from __future__ import annotations

import os
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bandloom.functions.dims import Bands
from bandloom.operators import replicas, sampling, schedule, store
from bandloom.operators import sensitivity as se
from bandloom.operators.blocks import restored
from bandloom.sources import archives, files, scans
from bandloom.sources.synthetic import noise_images


# --- scans ---


@pytest.fixture
def folder(tmp_path):
    for k in range(3):
        files.write_file(str(tmp_path / "in" / f"{k}.txt"), b"line\n" * (k + 1))
    return tmp_path


def counted(seen, factor=1):
    def scan(shards):
        seen.append(sorted(r["shard"].rsplit("/", 1)[1] for r in shards.collect()))
        return shards.select("shard", (F.col("bytes") * factor).alias("n"))

    return scan


def test_only_what_has_changed_is_scanned(spark, folder):
    seen, go = [], lambda p, f=1: {r["shard"].rsplit("/", 1)[1]: r["n"] for r in scans.ensured(spark, str(folder / "in"), str(folder / "store"), p, counted(seen, f)).collect()}
    assert go({"a": 1}) == {"0.txt": 5, "1.txt": 10, "2.txt": 15}
    assert go({"a": 1}) == {"0.txt": 5, "1.txt": 10, "2.txt": 15} and seen == [["0.txt", "1.txt", "2.txt"]]
    files.write_file(str(folder / "in" / "1.txt"), b"more lines\n" * 2)
    files.write_file(str(folder / "in" / "3.txt"), b"x")
    os.remove(folder / "in" / "0.txt")
    assert go({"a": 1}) == {"1.txt": 22, "2.txt": 15, "3.txt": 1} and seen[1:] == [["1.txt", "3.txt"]]
    os.utime(folder / "in" / "2.txt", (1, 1))
    go({"a": 1})
    assert seen[2:] == [["2.txt"]]
    assert go({"a": 2}, 2) == {"1.txt": 44, "2.txt": 30, "3.txt": 2} and seen[3:] == [["1.txt", "2.txt", "3.txt"]]
    assert [r["scanned"] for r in scans.finished_runs(str(folder / "store"))] == [3, 2, 1, 3]
    os.remove(folder / "in" / "3.txt")
    assert go({"a": 2}, 2) == {"1.txt": 44, "2.txt": 30} and len(seen) == 4


def test_a_scan_that_fails_changes_nothing(spark, folder):
    path = str(folder / "store")
    scans.ensured(spark, str(folder / "in"), path, {}, counted([])).collect()
    files.write_file(str(folder / "in" / "1.txt"), b"y")
    boom = lambda shards: shards.select("shard", F.raise_error(F.lit("lost")).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        scans.ensured(spark, str(folder / "in"), path, {}, boom)
    assert sorted(r["n"] for r in scans.results(spark, path).collect()) == [5, 10, 15] and len(scans.finished_runs(path)) == 1

    def meanwhile(shards):
        files.create_new(f"{path}/versions/00000001.json", b'{"run": "other"}')
        return shards.select("shard", F.lit(1).cast("long").alias("n"))

    with pytest.raises(RuntimeError, match="meanwhile"):
        scans.ensured(spark, str(folder / "in"), path, {}, meanwhile)


# --- reservoirs ---


def test_reservoir_is_a_bounded_shuffle():
    taken = []

    def source():
        for i in range(500):
            taken.append(i)
            yield i

    out, ahead = [], 0
    for x in sampling.reservoir(source(), 20, np.random.default_rng(3)):
        out.append(x)
        ahead = max(ahead, len(taken) - len(out))
    assert sorted(out) == list(range(500)) and ahead <= 20 and all(x <= k + 20 for k, x in enumerate(out))
    assert sum(x != k for k, x in enumerate(out)) > 400
    assert list(sampling.reservoir([], 5, np.random.default_rng(1))) == [] and sorted(sampling.reservoir(range(3), 5, np.random.default_rng(1))) == [0, 1, 2]


def test_shuffled_archives_follow_the_seed(spark, tmp_path):
    rows = spark.range(60).select("id", F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit(b"x").alias("content"), F.lit(1).alias("label"))
    names = archives.write_archives(rows, str(tmp_path), 10)
    order = lambda seed, streams=2: [(r["stream"], r["place"], r["key"]) for r in archives.shuffled_archives(spark, names, seed, streams, 15).orderBy("stream", "place").collect()]
    first = order(1)
    assert first == order(1) and first != order(2) and len({k for _, _, k in first}) == 60
    assert [(s, p) for s, p, _ in first] == [(s, p) for s in range(2) for p in range(30)]
    plan = archives.shuffled_archives(spark, names, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert len(order(1, 50)) == 60 and {s for s, _, _ in order(1, 50)} == set(range(6))


def test_buffer_shuffle_needs_no_exchange(spark):
    rows = spark.range(0, 3000, 1, 3).withColumn("v", F.col("id") * 2)
    out = sampling.buffer_shuffle(rows, 64, 5)
    got = [r["id"] for r in out.collect()]
    assert sorted(got) == list(range(3000)) and got != list(range(3000)) and got == [r["id"] for r in sampling.buffer_shuffle(rows, 64, 5).collect()]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


# --- isotonic fits ---


def test_pooling_is_the_max_min_formula():
    r = random.Random(1)
    for _ in range(200):
        v = [r.randrange(8) for _ in range(r.randrange(1, 12))]
        w = [r.randrange(1, 4) for _ in v]
        mean = lambda i, j: sum(a * b for a, b in zip(v[i : j + 1], w[i : j + 1], strict=True)) / sum(w[i : j + 1])  # noqa: B023, E731
        expected = [max(min(mean(i, j) for j in range(k, len(v))) for i in range(k + 1)) for k in range(len(v))]
        assert schedule.pooled(np.array(v, float), np.array(w, float)) == pytest.approx(expected)


def test_many_long_series_in_one_pass(spark):
    points = spark.range(200_000).select((F.col("id") % 2).cast("int").alias("series"), F.floor(F.col("id") / 2).alias("epoch"), (F.sqrt("id") + F.hash("id") % 50).alias("value"))
    began = time.time()
    out = schedule.isotonic_fits(points, ["series"], "epoch", "value").cache()
    assert out.count() == 200_000 and time.time() - began < 60
    down = out.withColumn("before", F.expr("lag(fitted) over (partition by series order by epoch)")).where("fitted < before")
    assert down.count() == 0
    plan = schedule.isotonic_fits(points, ["series"], "epoch", "value")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    nulls = spark.createDataFrame([(1, 0, 3.0), (1, 1, None), (1, 2, 1.0), (1, 2, 3.0), (2, 0, None)], "s int, epoch int, value double")
    assert sorted(map(tuple, schedule.isotonic_fits(nulls, ["s"], "epoch", "value").collect())) == [(1, 0, pytest.approx(7 / 3)), (1, 2, pytest.approx(7 / 3))]


# --- residual gradients ---


def test_residual_gradient_is_the_derivative(spark):
    r = np.random.default_rng(7)
    bands, k = Bands.even(64, 16), 4
    z, w, label = r.normal(size=(3, 64)), r.normal(size=(4, 64)), [2, 0, 3]
    points = spark.createDataFrame([(i, 0, label[i], z[i].tolist()) for i in range(3)], "image_id long, patch int, label int, z array<double>")
    centroids = spark.createDataFrame([(c, w[c].tolist()) for c in range(4)], "label int, w array<double>")
    got = {x["image_id"]: np.array(x["grad"]) for x in se.residual_gradients(points, centroids, bands, k).collect()}

    def loss(i, residual):  # residual as coefficients beyond the bands
        x = np.where(np.arange(64) < bands.width(k), z[i], 0) + residual
        s = w @ x
        return np.log(np.exp(s - s.max()).sum()) + s.max() - s[label[i]]

    for i in range(3):
        residual = np.where(np.arange(64) >= bands.width(k), z[i], 0)
        numeric = np.zeros(64)
        for p in range(bands.width(k), 64):
            e = np.zeros(64)
            e[p] = 1e-5
            numeric[p] = (loss(i, residual + e) - loss(i, residual - e)) / 2e-5
        pixels = restored(spark.createDataFrame([(i, 0, numeric.tolist())], "image_id long, patch int, z array<double>")).first()["pixels"]
        assert got[i] == pytest.approx(pixels, abs=1e-7)
    share = se.residual_sensitivity(points, centroids, bands, k, ["label"]).collect()
    assert {x["label"] for x in share} == {0, 2, 3} and all(x["value"] == pytest.approx(1, abs=1e-6) for x in share)


# --- replicas ---


def test_replicas_agree(spark):
    rows = spark.range(90).select((F.col("id") % 3).alias("rank"), F.floor(F.col("id") / 9).alias("place"), "id")
    out = replicas.run_replicas(rows, 3, lambda t: {"ids": sum(t.column("id").to_pylist()), "rows": t.num_rows}, every=4).collect()
    by = {}
    for r in out:
        by.setdefault((r["step"], r["metric"]), set()).add(r["total"])
    assert len(out) == 3 * 10 * 2 and all(len(v) == 1 for v in by.values())
    assert by[2, "ids"] == {sum(range(18, 27))} and by[9, "rows"] == {9.0}
    assert {r["rank"] for r in out} == {0, 1, 2}


def test_unequal_replicas_are_an_error(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "rank int, place int")
    with pytest.raises(Exception, match="different steps"):
        replicas.run_replicas(rows, 2, lambda t: {"n": t.num_rows}, every=8).collect()


def test_steps_over_batches():
    import pyarrow as pa

    b = [pa.RecordBatch.from_pandas(pd.DataFrame({"place": p})) for p in ([0, 0, 1], [1, 1], [], [2, 3])]
    assert [(p, t.num_rows) for p, t in replicas.steps(iter(b))] == [(0, 2), (1, 3), (2, 1), (3, 1)]


# --- the quantised store ---


@pytest.mark.parametrize("buckets", [None, 4])
def test_quantised_store_serves_what_went_in(spark, tmp_path, buckets):
    images = noise_images(spark, 6, base=(16, 24), steps=(8, 16))
    bands = Bands.even(64, 16)
    store.write_quantised_store(images, str(tmp_path), bands, buckets, tile_blocks=2, base_chunk=4, most_bytes=3 * 24 * 40 * 8 * 2)
    places = spark.read.parquet(str(tmp_path / "images"))
    rows = {r["image_id"]: r for r in places.collect()}
    for r in rows.values():
        assert r["chunk_pos"] < max(1, min(4, 3 * 24 * 40 * 8 * 2 // (3 * r["nph"] * 8 * r["npw"] * 8 * 8)))
    every = places.select("image_id", F.explode(F.sequence(F.lit(0), F.col("nph") * F.col("npw") - 1)).alias("patch")).withColumn("k", F.lit(16))
    served, records = store.read_bucket_store(spark, str(tmp_path), every)
    source = {r["image_id"]: r for r in images.collect()}
    for r in restored(served).collect():
        im, at = source[r["image_id"]], rows[r["image_id"]]
        plane = np.zeros((at["nph"] * 8, at["npw"] * 8))
        plane[: im["height"], : im["width"]] = np.array(im["pixels"]).reshape(3, im["height"], im["width"])[r["channel"]]
        y, x = divmod(r["patch"], at["npw"])
        assert np.abs(plane[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].ravel() - r["pixels"]).max() < 0.2
    assert served.count() == sum(3 * r["nph"] * r["npw"] for r in rows.values())
    assert records.select("bucket_id", "chunk_id", "tile_id", "band_id").distinct().count() == records.count()


# --- schedules of many runs, folders and guards ---


def test_run_schedules_are_those_of_one_run(spark):
    runs = spark.createDataFrame([(1, 30, 5, 0.4, 0.9, 1.5, 16, 16, 0.4), (2, 1, 0, 0.2, 0.8, 1.0, 3, 16, 0.1)], "run int, total int, warmup int, start double, end double, gamma double, patches int, bands int, base_lr double")
    rows = schedule.run_schedules(runs, beyond=2).collect()
    one = {r["epoch"]: r for r in schedule.budget_schedule(spark, 30, 16, 16, 0.4, 0.9, 1.5).collect()}
    lr = {r["epoch"]: r["lr"] for r in schedule.warmup_cosine(spark, 30, 0.4, 5).collect()}
    for r in (x for x in rows if x["run"] == 1):
        held = one[min(r["epoch"], 29)]
        assert (r["budget"], r["io_ratio"]) == (held["budget"], pytest.approx(held["io_ratio"]))
        assert r["lr"] == pytest.approx(lr.get(r["epoch"], 0.0), abs=1e-12)
    assert [r["budget"] for r in rows if r["run"] == 2] == [10, 10, 10]


def test_refolder_wants_pairs(spark, tmp_path):
    images = spark.createDataFrame([("a.jpg", bytearray(b"1")), ("b.jpg", bytearray(b"2"))], "path string, content binary")
    assert sorted(map(tuple, archives.write_files(images, str(tmp_path / "flat")).collect())) == [("a.jpg", 1), ("b.jpg", 1)]
    (tmp_path / "val.txt").write_text("a.jpg\tn1\t0\nb.jpg\tn2\t0\n")
    archives.refolder(spark, f"{tmp_path}/flat/*.jpg", str(tmp_path / "val.txt"), str(tmp_path / "out")).collect()
    assert sorted(os.listdir(tmp_path / "out")) == ["n1", "n2"] and os.listdir(tmp_path / "out" / "n2") == ["b.jpg"]
    (tmp_path / "val.txt").write_text("a.jpg\tn1\t0\nc.jpg\tn2\t0\n")
    with pytest.raises(Exception, match="no pair for"):
        archives.refolder(spark, f"{tmp_path}/flat/*.jpg", str(tmp_path / "val.txt"), str(tmp_path / "out")).collect()


def test_batches_of_one_bucket(spark):
    from bandloom.operators.crops import one_bucket

    places = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "image_id long, bucket_id int")
    ask = lambda rows: one_bucket(spark.createDataFrame(rows, "batch_no int, image_id long"), places).collect()
    assert sorted((r["batch_no"], r["image_id"], r["bucket_id"]) for r in ask([(0, 0), (0, 1), (1, 2)])) == [(0, 0, 1), (0, 1, 1), (1, 2, 2)]
    for bad in ([(0, 0), (0, 2)], [(0, 9)]):
        with pytest.raises(Exception, match="one bucket"):
            ask(bad)
