"""Archives by their index, written by tasks, and as a stream that is stopped, killed and limited."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from bandloom.sources import archives, files


@pytest.fixture
def names(spark, tmp_path):
    rows = spark.range(23).select("id", F.concat(F.lit("x/k"), F.col("id") * 37 % 23).alias("key"), F.repeat(F.lit("ab"), (F.col("id") * 300).cast("int")).cast("binary").alias("content"), (F.col("id") % 5).cast("int").alias("label"))
    return archives.write_archives(rows, str(tmp_path / "tar"), 10)


def plain(df):
    return sorted((r["shard"], r["position"], r["key"], bytes(r["content"]), r["label"]) for r in df.collect())


def test_indexed_reads_are_those_of_a_scan(spark, names, tmp_path):
    assert [os.path.basename(n) for n in names] == ["part-000000.tar", "part-000001.tar", "part-000002.tar"] == sorted(os.listdir(tmp_path / "tar"))
    index = archives.member_index(spark, names)
    assert plain(archives.read_indexed(index)) == plain(archives.read_archives(spark, names))
    late = archives.read_indexed(index.where("position >= 7"))
    assert plain(late) == plain(archives.read_archives(spark, names, spark.createDataFrame([(n, 7) for n in names], "shard string, done int")))
    one = archives.read_indexed(index.where(F.col("shard") == names[1]))
    assert one.select(F.spark_partition_id()).distinct().count() > 1  # an archive is shared out among tasks


def test_only_archives_with_wanted_keys_are_opened(spark, names, tmp_path):
    index = archives.member_index(spark, names)
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    wanted = spark.createDataFrame([("x/k8",), ("x/k1",), ("x/k8",)], "key string")  # ids 17 and 5
    for n in names[2:]:
        os.remove(n)
    assert sorted((r["key"], r["label"]) for r in archives.read_indexed_keys(index, wanted).collect()) == [("x/k1", 0), ("x/k8", 2)]
    with pytest.raises(KeyError, match="nowhere"):
        archives.read_indexed_keys(index, spark.createDataFrame([("nowhere",)], "key string"))


def test_a_key_of_several_archives(spark, tmp_path):
    rows = spark.range(8).select("id", F.concat(F.lit("k"), F.col("id") % 4).alias("key"), F.col("id").cast("string").cast("binary").alias("content"), F.col("id").cast("int").alias("label"))
    names = archives.write_archives(rows, str(tmp_path / "tar"), 4)
    index = archives.member_index(spark, names)
    assert sorted(r["label"] for r in archives.read_indexed_keys(index, spark.createDataFrame([("k1",)], "key string")).collect()) == [1, 5]
    assert [r["label"] for r in archives.read_indexed_keys(index, spark.createDataFrame([("k1", names[1])], "key string, shard string")).collect()] == [5]
    with pytest.raises(KeyError, match="k1"):
        archives.read_indexed_keys(index, spark.createDataFrame([("k1", "elsewhere")], "key string, shard string"))


def test_pieces_out_of_order_and_far_apart(tmp_path):
    data = bytes(range(256)) * 64
    files.write_file(str(tmp_path / "f"), data[:100] + b"7" + data[101:12_000] + b"8" + data[12_001:])

    class Counting:
        def __init__(self):
            self.read = []

        def read_at(self, n, at):
            self.read.append((at, n))
            return files.read_file(str(tmp_path / "f"))[at : at + n]

    rows = [("s", 0, "a", 50, 10, 12_000, 1), ("s", 1, "b", 90, 5, 100, 1), ("s", 2, "c", 50, 10, 100, 1)]
    file = Counting()
    got = list(archives._read_rows(file, rows))
    assert [(r[2], r[3], r[4]) for r in got] == [("a", data[50:60], 8), ("b", data[90:95], 7), ("c", data[50:60], 7)]
    assert file.read == [(50, 51), (12_000, 1)]


def run(stream, folder, **trigger):
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/out")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def offsets(folder):
    names = sorted((n for n in os.listdir(f"{folder}/progress/offsets") if n.isdigit()), key=int)
    return [files.read_file(f"{folder}/progress/offsets/{n}").decode().splitlines()[-1] for n in names]


def test_a_stream_with_limits_takes_each_sample_once(spark, names, tmp_path):
    query = run(archives.stream_archives(spark, str(tmp_path / "tar"), samples_per_batch=4, checkpoint=str(tmp_path / "progress")), str(tmp_path), processingTime="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(archives.read_archives(spark, names))
    assert len(offsets(tmp_path)) == 6 and '"sample": 4' in offsets(tmp_path)[0] and '"sample": -1' in offsets(tmp_path)[-1]
    with pytest.raises(ValueError, match="checkpoint"):
        archives.stream_archives(spark, str(tmp_path / "tar"), samples_per_batch=4)
    run(archives.stream_archives(spark, str(tmp_path / "tar"), samples_per_batch=4, checkpoint=str(tmp_path / "progress")), str(tmp_path)).awaitTermination()
    assert len(offsets(tmp_path)) == 6
    run(archives.stream_archives(spark, str(tmp_path / "tar")), str(tmp_path)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 23
    query = run(archives.stream_archives(spark, str(tmp_path / "tar"), shards_per_batch=1, checkpoint=str(tmp_path / "b" / "progress")), str(tmp_path / "b"), processingTime="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert len(offsets(tmp_path / "b")) == 3 and spark.read.parquet(str(tmp_path / "b" / "out")).count() == 23


def test_small_archives_share_a_task(spark, names, tmp_path):
    assert files.grouped(names, 1 << 30) == [[0, 1, 2]] and files.grouped(names, 1) == [[0], [1], [2]] and files.grouped([]) == []
    two = max(os.path.getsize(n) for n in names)
    assert sum(files.grouped(names, two), []) == [0, 1, 2] and len(files.grouped(names, two)) > 1
    assert archives.read_archives(spark, names).rdd.getNumPartitions() == 1


def test_an_index_of_small_archives_is_few_tasks(spark, tmp_path):
    rows = spark.range(40).select("id", F.concat(F.lit("k"), "id").alias("key"), F.lit("x").cast("binary").alias("content"), F.lit(1).alias("label"))
    index = archives.member_index(spark, archives.write_archives(rows, str(tmp_path / "tar"), 1))
    assert index.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and index.count() == 40


def test_a_batch_of_small_archives_is_few_tasks(spark, names, tmp_path):
    run(archives.stream_archives(spark, str(tmp_path / "tar")), str(tmp_path)).awaitTermination()
    assert len(files.names(str(tmp_path / "out"))) == 1
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(archives.read_archives(spark, names))


def test_small_batches_of_a_large_table_are_few(spark, sf, tmp_path, monkeypatch):
    from bandloom.plans import stores
    from bandloom.plans.queries import ORACLE_SQL
    from tests.compare import difference, duck

    told = []
    monkeypatch.setattr(stores, "FIRST_PART", 20)
    monkeypatch.setattr(stores, "scratch", lambda spark: told.append(str(tmp_path / "s")) or told[-1])
    assert difference(stores.tar_stream(spark, sf), duck(sf), ORACLE_SQL["tar_stream"]) is None
    assert len([n for n in os.listdir(tmp_path / "s" / "progress" / "commits") if n.isdigit()]) == 2


def test_a_killed_stream_goes_on_where_it_was(spark, names, tmp_path):
    """A task of the second batch dies; the batch runs again from its logged offsets, and every sample is there once."""
    broken = str(tmp_path / "broken")
    files.write_file(broken, b"")

    def dies(batches):
        for b in batches:
            if os.path.exists(broken) and "x/k4" in b.column("key").to_pylist():  # id 20 of the third archive
                os._exit(3)
            yield b

    stream = archives.stream_archives(spark, str(tmp_path / "tar"), shards_per_batch=1, checkpoint=str(tmp_path / "progress")).mapInArrow(dies, archives.SCHEMA)
    query = run(stream, str(tmp_path), processingTime="0 seconds")
    with pytest.raises(Exception):  # noqa: B017
        query.processAllAvailable()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    os.remove(broken)
    run(stream, str(tmp_path)).awaitTermination()
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(archives.read_archives(spark, names))


def test_a_broken_archive_is_an_error_and_an_empty_folder_is_not(spark, tmp_path):
    files.write_file(str(tmp_path / "bad.tar"), b"no archive" * 200)
    with pytest.raises(Exception, match="ReadError|invalid header"):
        archives.member_index(spark, str(tmp_path / "bad.tar")).collect()
    os.makedirs(tmp_path / "none")
    query = run(archives.stream_archives(spark, str(tmp_path / "none")), str(tmp_path / "x"))
    query.awaitTermination()


def test_many_small_files_are_few_tasks(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("c"), F.col("id") % 3, F.lit("/v"), "id", F.lit(".jpg")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    archives.write_files(rows, str(tmp_path)).count()
    files.write_file(str(tmp_path / "c1" / "other.txt"), b"x")
    got = archives.read_image_folder(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((int(bytes(r["content"])), r["class_name"], r["label"]) for r in got.collect()) == [(i, f"c{i % 3}", i % 3) for i in range(300)]
    assert {r["path"] for r in got.collect()} == {f"file:{tmp_path}/c{i % 3}/v{i}.jpg" for i in range(300)}
