"""Packed stores: byte ranges, what a filter opens, writes that fail, gaps, two writers, and images of many sizes."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from bandloom.operators import store
from bandloom.sources import files, packed
from bandloom.sources.synthetic import noise_images

SPEC = store.ChunkSpec(tile_blocks=2, codec="none")


def images(spark, first, n):
    return noise_images(spark, first + n, base=(16, 24), steps=(8, 16)).where(F.col("image_id") >= first)


@pytest.fixture
def path(spark, tmp_path):
    store.write_packed_store(images(spark, 0, 5), str(tmp_path / "s"), SPEC, records_per_shard=2)
    return str(tmp_path / "s")


def listed(spark, path):
    return [(r["shard_id"], r["first_image"], r["last_image"]) for r in packed.manifest(spark, path).orderBy("shard_id").collect()]


class Counting:
    def __init__(self, data):
        self.data, self.read = data, []

    def read_at(self, nbytes, offset):
        self.read.append((offset, nbytes))
        return self.data[offset : offset + nbytes]


def test_only_the_ranges_are_read():
    data = bytes(range(200))
    file = Counting(data)
    got = [p for _, _, parts, _, _ in files.fetched(file, [(0, 5), (5, 5), (5, 5), (20, 0), (30, 10), (40, 4), (60, 1)], most=12) for p in parts]
    assert got == [data[0:5], data[5:10], data[5:10], b"", data[30:40], data[40:44], data[60:61]]
    assert file.read == [(0, 10), (20, 0), (30, 10), (40, 4), (60, 1)]
    with pytest.raises(OSError):
        list(files.fetched(file, [(190, 20)]))


def test_filters_decide_what_is_opened(spark, path):
    every = packed.packed_chunks(spark, path)
    some = packed.packed_chunks(spark, path, ("image_id", "=", 3), ("band_id", "in", [0, 2]), ("tile_id", "<", 2))
    rows = some.collect()
    assert {(r["tile_id"], r["band_id"]) for r in rows} == {(t, b) for t in (0, 1) for b in (0, 2)}
    assert sum({r["span"]: r["span_length"] for r in rows}.values()) == sum(r["length"] for r in rows)
    whole = sum(os.path.getsize(f"{path}/payload/{n}") for n in files.names(f"{path}/payload"))
    assert packed.opened(every.withColumn("all", F.lit(1)), "all").first()["bytes_opened"] == whole
    # all bytes that the filter does not want are spoilt, and the other shards' files are gone: the rows stay the same
    name = rows[0]["write_id"]
    for n in files.names(f"{path}/payload"):
        if not n.startswith(name):
            os.remove(f"{path}/payload/{n}")
    data = bytearray(files.read_file(f"{path}/payload/{name}.bin"))
    wanted = {b for r in rows for b in range(r["offset"], r["offset"] + r["length"])}
    files.write_file(f"{path}/payload/{name}.bin", bytes(x if k in wanted else 0xFF for k, x in enumerate(data)))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("filters,shards", [((("image_id", ">", 3),), {2}), ((("image_id", ">=", 3),), {1, 2}), ((("image_id", "<", 2),), {0}), ((("image_id", "<=", 2),), {0, 1}), ((("shard_id", "=", 1),), {1}), ((("image_id", "in", [0, 4]), ("band_id", "=", 1)), {0, 2}), ((("image_id", "=", 99),), set())])
def test_shards_that_cannot_hold_rows_are_not_planned(spark, path, filters, shards):
    planned = packed._Reader(path, filters).partitions()
    assert {int(p.value.split("-")[1]) for p in planned if p.value} == shards
    rows = packed.packed_chunks(spark, path, *filters)
    where = " and ".join(f"{c} {o} {tuple(v) if o == 'in' else v}" for c, o, v in filters)
    same = packed.packed_index(spark, path)[1].where(where)
    key = ["write_id", "image_id", "tile_id", "band_id", "offset", "length"]
    assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, same.select(*key).collect()))
    with pytest.raises(ValueError, match="no filter"):
        packed.packed_chunks(spark, path, ("label", "=", 1))


def test_crops_are_those_of_the_chunk_store(spark, path, tmp_path):
    im = images(spark, 0, 5)
    store.write_chunk_store(im, str(tmp_path / "c"), SPEC, records_per_shard=2)
    wanted = im.selectExpr("image_id", "int(image_id * 3) as top", "2 as left", "9 as crop_h", "11 as crop_w").unionAll(im.selectExpr("0L", "0", "0", "16", "16").limit(3))
    heads, chunks, spec = store.open_chunk_store(spark, str(tmp_path / "c"))
    reads, packed_spec = store.packed_reads(spark, path, wanted.distinct(), [0, 2])
    as_rows = lambda df: sorted((r["image_id"], r["top"], [round(v, 9) for v in r["pixels"]]) for r in df.collect())
    assert as_rows(store.served_crops(reads, packed_spec)) == as_rows(store.read_crops(heads, chunks, wanted.distinct(), spec, [0, 2]))


def test_a_write_that_fails_leaves_nothing(spark, path):
    before = listed(spark, path)
    rows = store.packed_rows(images(spark, 6, 4), SPEC, 2)
    boom = rows.withColumn("num_blocks", F.when((F.col("image_id") == 9) & (F.col("band_id") == 1), F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("num_blocks")))
    with pytest.raises(Exception, match="lost"):
        packed.write_packed(boom, path, 4)
    assert listed(spark, path) == before and packed.packed_chunks(spark, path).where("image_id > 5").count() == 0
    packed.discard(path)
    assert {n.rpartition(".")[0] for n in files.names(f"{path}/payload")} == {s["name"] for s in packed.committed(path)}


def test_a_killed_task_leaves_nothing(spark, path):
    """The worker process dies with a shard half written; its files stay, and no reader sees them."""
    before = listed(spark, path)

    def die(batches):
        for b in batches:
            yield b.slice(0, b.num_rows // 2)
            os._exit(9)

    rows = store.packed_rows(images(spark, 6, 2), SPEC, 2).repartition(1).sortWithinPartitions("image_id", "tile_id")
    with pytest.raises(Exception):  # noqa: B017
        spark.dataSource.register(packed.PackedChunks)
        rows.select(*packed.WRITE_SCHEMA.replace(",", "").split()[::2]).mapInArrow(die, packed.WRITE_SCHEMA).write.format("packed_chunks").options(path=path, bands="4").mode("append").save()
    assert listed(spark, path) == before and packed.packed_index(spark, path)[1].where("image_id > 5").count() == 0


@pytest.mark.parametrize("rows,why", [
    (lambda im: im.where("image_id > 7"), "starts with image 8 instead of 5"),  # a gap before it
    (lambda im: im.where("image_id = 6").withColumn("image_id", F.lit(4).cast("long")), "there already"),
])
def test_gaps_and_doubles_are_errors(spark, path, rows, why):
    before = listed(spark, path)
    with pytest.raises(Exception, match=why):
        store.write_packed_store(rows(images(spark, 6, 4)), path, SPEC, records_per_shard=2)
    assert listed(spark, path) == before


def test_a_gap_within_a_shard_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="do not follow"):
        store.write_packed_store(images(spark, 0, 3).where("image_id <> 1"), str(tmp_path / "g"), SPEC, records_per_shard=4)
    store.write_packed_store(images(spark, 0, 3).where("image_id <> 1"), str(tmp_path / "g"), SPEC, records_per_shard=4, contiguous=False)
    assert listed(spark, str(tmp_path / "g")) == [(0, 0, 2)]


def test_incomplete_images_and_doubles_are_errors(spark, tmp_path):
    rows = store.packed_rows(images(spark, 0, 2), SPEC, 2)
    for n, (bad, why) in enumerate([(rows.where("not (band_id = 2 and image_id = 1)"), "does not have"), (rows.where("not (band_id = -1 and image_id = 1)"), "does not hold"), (rows.unionAll(rows.where("band_id = -1")), "twice")]):
        with pytest.raises(Exception, match=why):
            packed.write_packed(bad, str(tmp_path / str(n)), 4)
        assert packed.committed(str(tmp_path / str(n))) == []


def test_growing_and_batches(spark, path):
    with pytest.raises(Exception, match="holds"):
        store.write_packed_store(images(spark, 5, 1), path, SPEC, records_per_shard=3)
    more = images(spark, 5, 3).withColumn("image_id", F.col("image_id"))
    with pytest.raises(Exception, match="there already"):
        store.write_packed_store(more, path, SPEC, records_per_shard=2)  # image 5 belongs to a shard that is closed
    for _ in range(2):
        store.write_packed_store(images(spark, 6, 2), path, SPEC, records_per_shard=2, contiguous=False, batch="stream 1")
    assert listed(spark, path) == [(0, 0, 1), (1, 2, 3), (2, 4, 4), (3, 6, 7)]
    assert packed.discard(path) == []


def test_of_two_writers_one_wins(tmp_path):
    shard = lambda k: {"shard_id": k, "name": f"n{k}", "images": 1, "chunks": 1, "bytes": 1, "first_image": k, "last_image": k}
    with ThreadPoolExecutor(8) as pool:
        def attempt(k):
            try:
                return packed.commit_shards(str(tmp_path), [shard(0) | {"name": f"w{k}"}], True, "")
            except ValueError:
                return None
        assert sorted(map(str, pool.map(attempt, range(8)))) == ["None"] * 7 + ["True"]
        assert all(pool.map(lambda k: packed.commit_shards(str(tmp_path), [shard(k)], False, ""), range(1, 9)))
    assert sorted(s["shard_id"] for s in packed.committed(str(tmp_path))) == list(range(9))
    assert not packed.commit_shards(str(tmp_path), [shard(9)], False, "b") or not packed.commit_shards(str(tmp_path), [shard(10)], False, "b")


def test_empty_store(spark, tmp_path):
    store.write_packed_store(images(spark, 0, 1).limit(0), str(tmp_path / "e"), SPEC)
    assert packed.packed_chunks(spark, str(tmp_path / "e")).count() == 0 and packed.manifest(spark, str(tmp_path / "e")).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    """A thousand images of 45 kB are many batches, whatever a batch may hold in rows."""
    from bandloom.operators import blocks

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        one = spark.range(0, 1000, 1, 1).select(F.col("id").alias("image_id"), F.lit(72).alias("height"), F.lit(80).alias("width"), F.array_repeat(F.lit(0.5), 72 * 80).alias("pixels"))
        blocks.split_blocks(one)
        most = one.mapInArrow(lambda bs: (b.select(["image_id"]).slice(0, 1) for b in bs), "image_id long").count()
        assert most > 10
    finally:
        spark.conf.set(key, before)
