"""Shard lists, archives, histories, JPEG files and the stream."""

from __future__ import annotations

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import dims, jpeg
from bandloom.sources import archives, folders, reports
from bandloom.sources.synthetic import noise_images


def test_braces():
    assert folders.expand_braces("a{008..011}.tar") == ["a008.tar", "a009.tar", "a010.tar", "a011.tar"]
    assert folders.expand_braces("{1..2}-{9..10}") == ["1-9", "1-10", "2-9", "2-10"]
    assert folders.shard_list(["x", "y{1..1}"]) == ["x", "y1"]
    for bad in ("{3..1}", "a{b}", []):
        with pytest.raises(ValueError):
            folders.shard_list(bad)


def test_shared_folder(spark):
    class Told:
        def __init__(self, conf=None, folder=None, master="local[2]"):
            self.sparkContext = self
            self.conf, self.folder, self.master, self.applicationId = conf, folder, master, "told"
            self._jsc = self

        def getConf(self):
            return {"spark.checkpoint.dir": self.conf} if self.conf else {}

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return self.folder is not None

        def get(self):
            return self.folder

    assert folders.shared_folder(Told("hdfs://a/b/", "/c")) == "hdfs://a/b" and folders.shared_folder(Told(None, "/c")) == "/c"
    assert "bandloom-" in folders.shared_folder(Told())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared_folder(Told(master="spark://x"))


def tar(path, files):
    with tarfile.open(path, "w") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


@pytest.fixture
def shards(tmp_path):
    tar(tmp_path / "s-00.tar", [("k1.jpg", b"one"), ("k1.cls", b"3"), ("k2.cls", b"4\n"), ("k2.png", b"two"), ("lone.jpg", b"x")])
    tar(tmp_path / "s-01.tar", [("d/k3.jpeg", b"three"), ("d/k3.cls", b"5"), ("d/k3.txt", b"no")])
    return str(tmp_path / "s-{00..01}.tar")


def test_archives(spark, shards):
    rows = sorted((r["key"], bytes(r["content"]), r["label"], r["position"]) for r in archives.read_archives(spark, shards).collect())
    assert rows == [("d/k3", b"three", 5, 0), ("k1", b"one", 3, 0), ("k2", b"two", 4, 1)]
    first = archives.read_archives(spark, shards).where("key = 'k1'").first()["shard"]
    rest = archives.read_archives(spark, shards, spark.createDataFrame([(first, 1)], "shard string, done int"))
    assert sorted(r["key"] for r in rest.collect()) == ["d/k3", "k2"]


def test_keys_from_archives(spark, shards):
    wanted = spark.createDataFrame([("k2",)], "key string")
    assert archives.read_keys(spark, shards, wanted).first()["label"] == 4
    with pytest.raises(KeyError, match="k9"):
        archives.read_keys(spark, shards, spark.createDataFrame([("k9",)], "key string"))


def test_keys_in_shards_whose_names_do_not_tell(spark, tmp_path):
    tar(tmp_path / "s-k1.tar", [("k1a.jpg", b"one"), ("k1a.cls", b"3")])
    tar(tmp_path / "s-k2.tar", [("k1b.jpg", b"two"), ("k1b.cls", b"4")])
    wanted = spark.createDataFrame([("k1a",), ("k1b",)], "key string")
    rows = archives.read_keys(spark, [str(tmp_path / f"s-{k}.tar") for k in ("k1", "k2")], wanted, r"^(k\d)")
    assert sorted((r["key"], r["label"]) for r in rows.collect()) == [("k1a", 3), ("k1b", 4)]


def test_archives_by_address(spark, shards, monkeypatch):
    """Files that only Spark can open, in batches of one sample."""
    monkeypatch.setattr(archives, "SAMPLE_BYTES", 0)
    named = [f"file://{s}" for s in folders.shard_list(shards)]
    skip = spark.createDataFrame([(f"file:{named[0][7:]}", 1)], "shard string, done int")
    rows = archives.read_archives(spark, named, skip).collect()
    assert sorted((r["key"], bytes(r["content"]), r["position"]) for r in rows) == [("d/k3", b"three", 0), ("k2", b"two", 1)]


def test_a_write_that_fails_half_way_leaves_no_doubles(spark, tmp_path):
    from bandloom.operators import store

    path, images = str(tmp_path / "s"), noise_images(spark, 3, base=(16, 16), steps=(0, 8))
    store.write_chunk_store(images.where("image_id = 0"), path, store.ChunkSpec())
    _, chunks = store.chunk_tables(images.where("image_id > 0"), store.ChunkSpec())  # chunks are there, the images are not listed
    chunks.selectExpr("*", "'lost' as write_id", "0 as shard_id").write.mode("append").partitionBy("write_id", "shard_id", "band_id").parquet(f"{path}/chunks")
    store.write_chunk_store(images, path, store.ChunkSpec(), resume=True)
    wanted = images.selectExpr("image_id", "0 as top", "0 as left", "16 as crop_h", "16 as crop_w")

    def read():
        heads, chunks, spec = store.open_chunk_store(spark, path)
        return sorted((r["image_id"], r["bytes_read"]) for r in store.crop_bytes(store.crop_reads(heads, chunks, wanted, spec)).collect()), heads.count()

    before, n = read()
    assert n == 3 and len(before) == 3
    assert store.drop_orphans(spark, path) == ["lost"] and read() == (before, n)


def test_folder_of_classes_and_sizes(spark, tmp_path):
    for name in ("cat/a.jpg", "cat/b.png", "ant/c.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = archives.read_image_folder(spark, str(tmp_path)).collect()
    assert sorted((r["class_name"], r["label"]) for r in rows) == [("ant", 0), ("cat", 1), ("cat", 1)]
    size = {r["folder"].rsplit("/", 1)[1]: (r["files"], r["bytes"]) for r in folders.sizes(spark, str(tmp_path)).collect()}
    assert size == {"ant": (1, 5), "cat": (2, 10)}
    (tmp_path / "val.txt").write_text("x.jpg\tn01\t0\t0\ny.jpg\tn02\n\n")
    assert sorted(map(tuple, archives.read_annotations(spark, str(tmp_path / "val.txt")).collect())) == [("x.jpg", "n01"), ("y.jpg", "n02")]


def test_sizes_count_files_without_a_byte(spark, tmp_path):
    for name, data in {"top.bin": b"1", "a/x.bin": b"", "a/y.bin": b"123", "a/.z.bin": b"4", "b/x.bin": b"", "b/c=1/x.png": b"12", "_c/x.bin": b"5"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = lambda glob: {(r["folder"].removeprefix(f"file:{tmp_path}"), r["files"], r["bytes"]) for r in folders.sizes(spark, str(tmp_path), glob).collect()}
    assert got("*") == {("", 1, 1), ("/a", 2, 3), ("/b", 1, 0), ("/b/c=1", 1, 2)}
    assert got("x.{bin,png}") == {("/a", 1, 0), ("/b", 1, 0), ("/b/c=1", 1, 2)}


def test_histories_of_all_ages(spark, tmp_path):
    files = {"new": {"adaptive": {"epoch": [0, 1], "test_acc": [0.1, 0.2], "io_ratio": [0.5, 0.6]}}, "old": {"baseline": {"test_acc": [0.3], "approx_ratio": [0.7]}}, "flat": {"test_acc": [0.4]}, "bad": {"x": 1}}
    for name, content in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "results.json").write_text(json.dumps(content))
    rows = sorted((r["run"], r["epoch"], r["acc"], r["io_ratio"]) for r in reports.read_runs(spark, f"{tmp_path}/*/results.json").collect())
    assert rows == [("flat", 0, 0.4, 1.0), ("new", 0, 0.1, 0.5), ("new", 1, 0.2, 0.6), ("old", 0, 0.3, 0.7)]
    from bandloom.operators.metrics import run_summary

    lines = reports.markdown(run_summary(reports.read_runs(spark, f"{tmp_path}/*/results.json")))
    assert lines[3] == "| new | 0.20 | 0.20 | 0.550 | 45.0 % |"


# --- JPEG ---


@pytest.mark.parametrize("sampling,name,restart", [([(2, 2), (1, 1), (1, 1)], "4:2:0", 0), ([(2, 1), (1, 1), (1, 1)], "4:2:2", 2), ([(1, 1)] * 3, "4:4:4", 0), ([(1, 1)], "grayscale", 3)])
def test_jpeg_coefficients(spark, sampling, name, restart):
    rng, h, w = np.random.default_rng(5), 35, 50
    hmax, vmax = max(a for a, _ in sampling), max(b for _, b in sampling)
    parts = []
    for a, b in sampling:
        q = rng.integers(-30, 31, (-(-h // (8 * vmax)) * b, -(-w // (8 * hmax)) * a, 64))
        q[rng.random(q.shape) < 0.8] = 0
        parts.append(q)
    tables = [[1] * 64, [2] * 64][: len(sampling)]
    data = jpeg.encode(parts, sampling, tables, h, w, restart)
    got = jpeg.coefficients(jpeg.parse(data))
    assert all((a == b).all() for a, b in zip(got, parts, strict=True))
    assert jpeg.planes(jpeg.parse(data), got).shape == (3, h, w)
    files = spark.createDataFrame([("good", bytearray(data)), ("bad", bytearray(b"GIF")), ("progressive", bytearray(jpeg.encode(parts, sampling, tables, h, w, progressive=True)))], "source string, content binary")
    rows = jpeg.decode_blocks(files).collect()
    assert sum(r["source"] == "good" for r in rows) == sum(p.shape[0] * p.shape[1] for p in parts)
    assert {r["source"] for r in rows if r["error"]} == {"bad", "progressive"}
    first = spark.range(1).select(jpeg.subsampling_key(F.lit(len(sampling)), F.lit(sampling[0][0]), F.lit(sampling[0][1]))).first()[0]
    assert first == name


def test_flat_grey_jpeg_has_its_value():
    q = np.zeros((1, 1, 64), dtype=int)
    q[0, 0, 0] = 10
    data = jpeg.encode([q], [(1, 1)], [[8] * 64], 8, 8)
    p = jpeg.parse(data)
    assert np.allclose(jpeg.planes(p, jpeg.coefficients(p)), (128 + 10) / 255)
    assert dims.zigzag(8, 8)[0] == 0


def test_stream_fills_a_store_once(spark, tmp_path):
    from bandloom.operators.store import open_chunk_store
    from bandloom.streaming.ingest import ingest_images

    source, target = str(tmp_path / "in"), str(tmp_path / "store")
    images = noise_images(spark, 4, base=(16, 16), steps=(0, 8))
    images.where("image_id < 2").coalesce(1).write.parquet(source)
    for expected in (2, 4):
        ingest_images(spark, source, target, str(tmp_path / "check")).awaitTermination()
        heads, chunks, _ = open_chunk_store(spark, target)
        assert heads.count() == expected and chunks.select("image_id").distinct().count() == expected
        images.where("image_id >= 1").coalesce(1).write.mode("append").parquet(source)
