"""Tar archives of samples: members that share a name up to the first dot are one sample, an image and its label."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from bandloom.sources import files
from bandloom.sources.folders import listed_files, shard_list

IMAGE_SUFFIXES = ("jpg", "jpeg", "png")
LABEL_SUFFIX = "cls"
#: Bytes of images in a batch of samples.
SAMPLE_BYTES = 8 << 20
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")
SCHEMA = "shard string, position int, key string, content binary, label int"
_TYPES = {"shard": pa.string(), "position": pa.int32(), "key": pa.string(), "content": pa.binary(), "label": pa.int32()}
SHUFFLED_SCHEMA = f"{SCHEMA}, stream int, place long"
_SHUFFLED_TYPES = _TYPES | {"stream": pa.int32(), "place": pa.int64()}
INDEX_SCHEMA = "shard string, position int, key string, image_offset long, image_length long, label_offset long, label_length long"
_INDEX_NAMES = ["shard", "position", "key", "image_offset", "image_length", "label_offset", "label_length"]
_INDEX_TYPES = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 4]


def members(archive: tarfile.TarFile) -> Iterator[tuple[str, str, tarfile.TarInfo]]:
    """(key, suffix, member) of the files in an archive, whose contents are not read yet."""
    for m in archive:
        if m.isfile():
            folder, _, name = m.name.rpartition("/")
            base, _, suffix = name.partition(".")
            yield f"{folder}/{base}" if folder else base, suffix.lower(), m


def samples(file: BinaryIO, done: int = 0) -> Iterator[tuple[int, str, bytes, int]]:
    """(position, key, image, label) as soon as both are there; samples that lack one are left out. Contents of the first `done`
    samples are not read."""
    images: dict[str, tarfile.TarInfo] = {}
    labels: dict[str, tarfile.TarInfo] = {}
    position = 0
    with tarfile.open(fileobj=file) as archive:
        for key, suffix, m in members(archive):
            if suffix in IMAGE_SUFFIXES:
                images[key] = m
            elif suffix == LABEL_SUFFIX:
                labels[key] = m
            if key in images and key in labels:
                image, label = images.pop(key), labels.pop(key)
                if position >= done:
                    yield position, key, archive.extractfile(image).read(), int(archive.extractfile(label).read().decode().strip())
                position += 1
            archive.members = []  # the list of what was seen would grow with the archive


class _TarReader(DataSourceReader):
    def __init__(self, shards: list[tuple[str, int]]) -> None:
        self.shards = shards

    def partitions(self) -> list[InputPartition]:
        return [InputPartition([self.shards[k] for k in some]) for some in files.grouped([s for s, _ in self.shards])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(self._rows(partition.value))

    @staticmethod
    def _rows(shards: list[tuple[str, int]]) -> Iterator[tuple]:
        for shard, done in shards:
            with open(shard, "rb") as file:  # members are read one by one, so an archive may be larger than memory
                yield from ((shard, *x) for x in samples(file, done))


class _ShuffledReader(DataSourceReader):
    """Streams of archives in a drawn order, each with a reservoir."""

    def __init__(self, shards: list[str], seed: int, streams: int, size: int) -> None:
        order = sorted(shards, key=lambda s: hashlib.sha256(f"{seed}:{s.rpartition('/')[2]}".encode()).digest())
        self.streams, self.seed, self.size = [order[k::streams] for k in range(min(streams, len(order)))], seed, size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, s)) for k, s in enumerate(self.streams)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from bandloom.operators.sampling import reservoir

        stream, shards = partition.value

        def each() -> Iterator[tuple]:
            for shard in shards:
                fs, inner = files.located(shard)
                with fs.open_input_file(inner) as file:
                    yield from ((shard, *x) for x in samples(file))

        mixed = reservoir(each(), self.size, np.random.default_rng([self.seed, stream]))
        for b in _batches(((*row, stream, place) for place, row in enumerate(mixed)), _SHUFFLED_TYPES):
            yield b


class ShuffledTar(DataSource):
    """Archives in a random order. Options: shards (JSON), seed, streams, size."""

    @classmethod
    def name(cls) -> str:
        return "tar_shuffled"

    def schema(self) -> str:
        return SHUFFLED_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ShuffledReader(json.loads(self.options["shards"]), *(int(self.options[n]) for n in ("seed", "streams", "size")))


def shuffled_archives(spark: SparkSession, patterns: str | list[str], seed: int, streams: int, size: int = 1000) -> DataFrame:
    """Rows (SCHEMA, stream, place): all samples, in `streams` tasks that read whole archives in an order drawn by the seed and the
    archives' names, each through a reservoir of `size` samples. Nothing is sorted or shuffled, and a task holds `size` samples
    whatever its archives hold; place is the order in a stream, the same for the same seed, archives and streams."""
    spark.dataSource.register(ShuffledTar)
    return spark.read.format("tar_shuffled").options(shards=json.dumps(shard_list(patterns)), seed=seed, streams=streams, size=size).load()


class TarSamples(DataSource):
    """Archives on mounted folders as a Spark source: a partition for each, small ones together. Option shards: JSON of [path,
    samples to skip]."""

    @classmethod
    def name(cls) -> str:
        return "tar_samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TarReader([tuple(s) for s in json.loads(self.options["shards"])])


def read_archives(spark: SparkSession, patterns: str | list[str], skip: DataFrame | None = None) -> DataFrame:
    """Rows (shard, position, key, content, label) of all samples; an archive is one task's work, and a task takes
    several small ones.

    Archives with a plain path are streamed member by member; others, such as those in object stores, are read as whole files by
    Spark, which takes files of up to 2 GB. skip: rows (shard, done), one for each shard at most: the first samples of a shard
    that are stored already, and whose contents are left unread.
    """
    shards = shard_list(patterns)
    done = {r["shard"]: r["done"] for r in skip.select("shard", "done").collect()} if skip is not None else {}
    if not any(_SCHEME.match(s) for s in shards):
        spark.dataSource.register(TarSamples)
        return spark.read.format("tar_samples").option("shards", json.dumps([(s, done.get(s, 0)) for s in shards])).load()
    whole = spark.read.format("binaryFile").load(shards).select(F.col("path").alias("shard"), "content").repartition("shard")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches((shard, *x) for x in samples(io.BytesIO(content.as_buffer()), done.get(shard, 0)))

    return whole.mapInArrow(unfold, SCHEMA)


def _batches(rows: Iterable[tuple], kinds: dict[str, pa.DataType] | None = None) -> Iterator[pa.RecordBatch]:
    """Samples in batches of about SAMPLE_BYTES."""
    kinds = kinds or _TYPES
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > SAMPLE_BYTES:
            yield _batch(held, kinds)
            held, size = [], 0
    yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def write_archives(rows: DataFrame, folder: str, samples_per_shard: int) -> list[str]:
    """Rows (id, key, content, label) as archives of consecutive ids; returns their names. A task writes an archive under a name of
    its own and then renames it, so none is ever seen half written, and one that is written again is the same."""
    dealt = rows.withColumn("shard_id", F.floor(F.col("id") / samples_per_shard).cast("int")).repartition("shard_id").sortWithinPartitions("shard_id", "id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = files.located(folder)
        fs.create_dir(inner, recursive=True)
        written: list[str] = []
        each = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("shard_id", "key", "content", "label")), strict=True))
        for shard, members_ in groupby(each, key=lambda row: row[0]):
            name, own = f"part-{shard:06d}.tar", f"{inner}/.part-{shard:06d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out, tarfile.open(fileobj=out, mode="w|") as archive:
                for _, key, content, label in members_:
                    for suffix, data in ((IMAGE_SUFFIXES[0], content), (LABEL_SUFFIX, str(label).encode())):
                        info = tarfile.TarInfo(f"{key}.{suffix}")
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
            fs.move(own, f"{inner}/{name}")
            written.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], ["name"])

    return sorted(r["name"] for r in dealt.select("shard_id", "key", "content", "label").mapInArrow(write, "name string").collect())


# --- the index of an archive's members: samples are then read by their bytes, and an archive by many tasks ---


def places(file: BinaryIO) -> Iterator[tuple[int, str, int, int, int, int]]:
    """(position, key, image offset, its length, label offset, its length) of the samples of an archive, from its headers alone."""
    images: dict[str, tarfile.TarInfo] = {}
    labels: dict[str, tarfile.TarInfo] = {}
    position = 0
    with tarfile.open(fileobj=file, mode="r:") as archive:
        for key, suffix, m in members(archive):
            if suffix in IMAGE_SUFFIXES:
                images[key] = m
            elif suffix == LABEL_SUFFIX:
                labels[key] = m
            if key in images and key in labels:
                image, label = images.pop(key), labels.pop(key)
                yield position, key, image.offset_data, image.size, label.offset_data, label.size
                position += 1
            archive.members = []


def member_index(spark: SparkSession, patterns: str | list[str]) -> DataFrame:
    """Rows of INDEX_SCHEMA, one for each sample: an archive is one task's work, which reads headers and skips contents, and a task
    takes several small ones. Written once as a table, it serves every later read: by key, from a position on, or of some archives."""
    listed = shard_list(patterns)
    width = max(len(files.grouped(listed)), 2 * spark.sparkContext.defaultParallelism)
    shards = spark.createDataFrame([(s,) for s in listed], "shard string").repartition(min(len(listed), width, 4096), "shard")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                fs, inner = files.located(shard)
                with fs.open_input_file(inner) as file:
                    rows = ((shard, *x) for x in places(file))
                    while some := list(islice(rows, 65_536)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _INDEX_TYPES, strict=True)], _INDEX_NAMES)

    return shards.mapInArrow(walk, INDEX_SCHEMA)


def read_indexed(index: DataFrame) -> DataFrame:
    """Rows of SCHEMA for rows of the index: only the bytes of their images and labels are read. Tasks take ranges of archives and
    places, so an archive is shared out among many, and one of which nothing is wanted is not opened."""
    width = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select(*_INDEX_NAMES).repartitionByRange(width, "shard", "image_offset").sortWithinPartitions("shard", "image_offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, rows in groupby(zip(*(c.to_pylist() for c in b.columns), strict=True), key=lambda row: row[0]):
                fs, inner = files.located(shard)
                with fs.open_input_file(inner) as file:
                    yield from _batches(_read_rows(file, list(rows)))

    return dealt.mapInArrow(read, SCHEMA)


def _read_rows(file: BinaryIO, rows: list[tuple]) -> Iterator[tuple]:
    """Samples of one archive; the pieces of up to 1 024 of them are read in the order of their places."""
    for at in range(0, len(rows), 1024):
        some = rows[at : at + 1024]
        pieces = sorted({(o, n) for r in some for o, n in ((r[3], r[4]), (r[5], r[6]))})
        found: dict[tuple[int, int], bytes] = {}
        last: dict[tuple[int, int], int] = {}
        for k, r in enumerate(some):
            last[r[3], r[4]] = last[r[5], r[6]] = k
        reads = files.fetched(file, pieces, gap=4096)
        for k, (shard, position, key, io_, in_, lo, ln) in enumerate(some):
            while (io_, in_) not in found or (lo, ln) not in found:
                first, end, parts, _, _ = next(reads)
                found.update(zip(pieces[first:end], parts, strict=True))
            image, label = found[io_, in_], found[lo, ln]
            for piece in ((io_, in_), (lo, ln)):
                if last[piece] == k:
                    found.pop(piece, None)
            yield shard, position, key, image, int(label.decode().strip())


def read_indexed_keys(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Samples of the wanted keys (column key), found by the index whatever the archives are called; missing ones are an error. Keys
    need not be unique over archives: all samples of a key come, or with a column shard in wanted only those of that archive."""
    on = [c for c in ("key", "shard") if c in wanted.columns]
    keys = wanted.select(*on).distinct()
    missing = keys.join(index, on, "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"missing keys: {', '.join(str(r['key']) for r in missing)}")
    return read_indexed(index.join(keys, on, "left_semi"))


# --- archives as a stream ---


class _TarStream(DataSourceStreamReader):
    """Offsets are (name of an archive, samples of it that are done); archives are taken in the order of their names, so new ones
    must sort behind those that are there. A batch takes all that is there, or `shards` whole archives, or `samples` samples."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.shards, self.samples = options["path"], int(options.get("shards_per_batch", 0)), int(options.get("samples_per_batch", 0))
        self.at: dict | None = None
        if "checkpoint" in options:
            done = [n for n in files.names(f"{options['checkpoint']}/commits") if n.isdigit()]
            last = max(done, key=int, default=None)
            self.at = {"shard": "", "sample": 0} if last is None else json.loads(files.read_file(f"{options['checkpoint']}/offsets/{last}").decode().splitlines()[-1])

    def _names(self) -> list[str]:
        return [n for n in files.names(self.path) if n.endswith(".tar")]

    def initialOffset(self) -> dict:
        return {"shard": "", "sample": 0}

    def latestOffset(self) -> dict:
        names = self._names()
        if self.at is None or not (self.shards or self.samples):
            return {"shard": names[-1], "sample": -1} if names else {"shard": "", "sample": 0}
        shard, done = self.at["shard"], self.at["sample"]
        rest = [n for n in names if n > shard or (n == shard and done >= 0)]
        if not self.samples:
            if rest:
                self.at = {"shard": rest[: self.shards][-1], "sample": -1}
            return self.at
        room = self.samples
        for n in rest:
            start = done if n == shard else 0
            size = self._count(n)
            if start + room < size:
                self.at = {"shard": n, "sample": start + room}
                return self.at
            room -= size - start
            self.at = {"shard": n, "sample": -1}
            if room == 0:
                break
        return self.at

    def _count(self, name: str) -> int:
        fs, inner = files.located(f"{self.path}/{name}")
        with fs.open_input_file(inner) as file:
            return sum(1 for _ in places(file))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        out = []
        for n in self._names():
            lo = 0 if n > start["shard"] else start["sample"] if n == start["shard"] else -1
            hi = -1 if n < end["shard"] else end["sample"]
            if lo >= 0 and n <= end["shard"] and lo != hi:
                out.append((f"{self.path}/{n}", lo, hi))
        return [InputPartition([out[k] for k in some]) for some in files.grouped([s for s, _, _ in out])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(self._rows(partition.value))

    @staticmethod
    def _rows(parts: list[tuple[str, int, int]]) -> Iterator[tuple]:
        for shard, lo, hi in parts:
            fs, inner = files.located(shard)
            with fs.open_input_file(inner) as file:
                rows = [(shard, *x) for x in islice(places(file), lo, None if hi < 0 else hi)]
                yield from _read_rows(file, rows)


class TarStream(DataSource):
    """A folder of archives as a stream. Options: path, shards_per_batch (no limit), samples_per_batch (no limit), checkpoint."""

    @classmethod
    def name(cls) -> str:
        return "tar_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _TarStream(dict(self.options))


def stream_archives(spark: SparkSession, folder: str, shards_per_batch: int = 0, samples_per_batch: int = 0, checkpoint: str | None = None) -> DataFrame:
    """A stream of the samples (SCHEMA) of the archives in a folder, each once over restarts from one checkpoint. The checkpoint
    has where it is, so nothing is looked up in what was written.

    Without limits the driver only lists the folder, and a batch, whose archives are tasks (small ones together), takes all that is there. Limits are for
    streams that go on (with availableNow a start takes one batch); they need the query's checkpoint, as Spark does not tell a
    source where it starts, and it is read for that. With samples_per_batch the driver also reads the headers of a batch's archives.
    """
    limits = {"shards_per_batch": shards_per_batch, "samples_per_batch": samples_per_batch}
    if any(limits.values()):
        if checkpoint is None:
            raise ValueError("limits need the checkpoint of the query")
        limits["checkpoint"] = checkpoint
    spark.dataSource.register(TarStream)
    return spark.readStream.format("tar_stream").options(path=folder, **limits).load()


def read_keys(spark: SparkSession, patterns: str | list[str], wanted: DataFrame, shard_of_key: str | None = None) -> DataFrame:
    """Samples of the wanted keys (column key); missing ones are an error. With a pattern whose first group is found in keys
    and in shard names, shards whose name fits a wanted key are opened first, and others only if a key is not in these."""
    shards = shard_list(patterns)
    if shard_of_key is not None:
        heads = {r[0] for r in wanted.select(F.regexp_extract("key", shard_of_key, 1)).distinct().collect()}  # one for each shard at most
        shards = [s for s in shards if any(h and h in s for h in heads)] or shards[:1]
    keys = wanted.select("key").distinct()
    rows = read_archives(spark, shards).join(keys, "key", "left_semi")
    lost = keys.join(rows.select("key"), "key", "left_anti")
    rest = [x for x in shard_list(patterns) if x not in set(shards)]
    if rest and not lost.isEmpty():  # names do not tell after all: look in the other shards too
        rows = rows.unionAll(read_archives(spark, rest).join(lost, "key", "left_semi"))
    missing = keys.join(rows.select("key"), "key", "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"missing keys: {', '.join(r[0] for r in missing)}")
    return rows


def with_contents(rows: DataFrame) -> DataFrame:
    """rows (path, ...) with the content of each file, read by as many tasks as a shuffle has: Spark's own source counts a file as
    4 MB at least, so that a task would read 32 small ones."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, first = [], 0, 0
            for k, path in enumerate(b.column("path").to_pylist()):
                held.append(files.read_file(path))
                size += len(held[-1])
                if size > SAMPLE_BYTES or k + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(held)).columns, pa.array(held, pa.binary())], [*b.schema.names, "content"])
                    held, size, first = [], 0, k + 1

    return dealt.mapInArrow(read, T.StructType([*dealt.schema.fields, T.StructField("content", T.BinaryType())]))


def read_image_folder(spark: SparkSession, path: str, glob: str = "*.[jJpP]*[gG]") -> DataFrame:
    """Rows (path, class_name, label, content): the folder of an image is its class; labels number the sorted classes."""
    rows = listed_files(spark, path, glob).select("path", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("class_name"))
    names = rows.groupBy("class_name").agg(F.lit(0).alias("zero")).groupBy("zero").agg(F.sort_array(F.collect_list("class_name")).alias("names"))
    labels = names.select(F.posexplode("names").alias("label", "class_name"))  # a row for each class
    return with_contents(rows.join(F.broadcast(labels), "class_name").select("path", "class_name", "label"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (path, content) as files below a folder, by the tasks that have them; returns rows (path, bytes). A file is written
    under another name and then renamed, so that a task that runs again replaces it whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = files.located(folder)
        fs.create_dir(inner, recursive=True)  # without rows, it is an empty folder
        for b in batches:
            sizes = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place, _, name = f"{inner}/{path}".rpartition("/")
                fs.create_dir(place, recursive=True)
                own = f"{place}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(content)
                fs.move(own, f"{place}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return rows.select("path", "content").mapInArrow(write, "path string, bytes long")


def refolder(spark: SparkSession, images: str, annotations: str, target: str) -> DataFrame:
    """Copies images of one flat folder into a folder for each class that the annotations (file, class_id) give them, where
    read_image_folder() reads them; returns rows (path, bytes). Files without an annotation, and annotations without a file, are
    an error."""
    folder, _, glob = images.rpartition("/") if re.search(r"[*?\[][^/]*$", images) else (images, "", "*")
    found = listed_files(spark, folder, glob, recursive=False).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("path").alias("source"))
    both = found.join(read_annotations(spark, annotations), "file", "full")
    fits = F.when(F.col("source").isNull() | F.col("class_id").isNull(), F.raise_error(F.concat(F.lit("no pair for "), F.col("file")))).otherwise(F.concat_ws("/", "class_id", "file"))
    read = with_contents(both.select(fits.cast("string").alias("target"), F.col("source").alias("path")))
    return write_files(read.select(F.col("target").alias("path"), "content"), target)


def write_records(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (file, place, record) as files of their records one after another; returns rows (path, bytes). A file is streamed
    by one task."""
    dealt = rows.select("file", "place", "record").repartition("file").sortWithinPartitions("file", "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = files.located(folder)
        fs.create_dir(inner, recursive=True)
        each = (x for b in batches for x in zip(b.column("file").to_pylist(), b.column("record").to_pylist(), strict=True))
        for name, records in groupby(each, key=lambda x: x[0]):
            own, size = f"{inner}/.{name}-{uuid.uuid4().hex}", 0
            with fs.open_output_stream(own) as out:
                for _, record in records:
                    out.write(record)
                    size += len(record)
            fs.move(own, f"{inner}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["path", "bytes"])

    return dealt.mapInArrow(write, "path string, bytes long")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, class_id) of tab-separated annotations, whose further columns are left."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    return lines.select(F.trim(F.get("p", F.lit(0))).alias("file"), F.trim(F.get("p", F.lit(1))).alias("class_id"))


def read_records(spark: SparkSession, path: str, header: int, size: int) -> DataFrame:
    """Rows (path, position, record) of files of fixed-size binary records behind a header. Records leave a task in batches."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())[header:]
                if len(data) % size:
                    raise ValueError(f"{name} does not hold whole records of {size} bytes")
                step = max(1, SAMPLE_BYTES // size)
                for at in range(0, len(data) // size, step):
                    n = min(step, len(data) // size - at)
                    part = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), n, [None, pa.py_buffer(data[at * size : (at + n) * size])])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), part.cast(pa.binary())], ["path", "position", "record"])

    return files.mapInArrow(unfold, "path string, position long, record binary")


def read_labelled_records(spark: SparkSession, path: str, labels: int, channels: int, side: int) -> DataFrame:
    """Rows (path, position, label, height, width, pixels in planes, 0..1) of files whose records are `labels` label bytes, the
    last of which counts, and then the planes of an image, as CIFAR has them (one label byte, or two: coarse and fine)."""
    rows = read_records(spark, path, 0, labels + channels * side * side)
    byte = lambda i: F.conv(F.hex(F.substring("record", i, 1)), 16, 10).cast("int")
    return rows.select("path", "position", byte(F.lit(labels)).alias("label"), F.lit(side).alias("height"), F.lit(side).alias("width"), byte_values(F.substring("record", labels + 1, channels * side * side)).alias("pixels"))


def read_idx(spark: SparkSession, images: str, labels: str, side: int = 28) -> DataFrame:
    """Rows (position, label, height, width, pixels in 0..1) of an IDX file of images and one of labels, as MNIST has them."""
    pixels = read_records(spark, images, 16, side * side).select("position", byte_values(F.col("record")).alias("pixels"))
    marks = read_records(spark, labels, 8, 1).select("position", F.conv(F.hex("record"), 16, 10).cast("int").alias("label"))
    return pixels.join(marks, "position").select("position", "label", F.lit(side).alias("height"), F.lit(side).alias("width"), "pixels")


def byte_values(data: Column) -> Column:
    """Bytes as numbers in 0..1."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, dtype=np.uint8) / 255.0 for x in batch], dtype=object)

    return F.pandas_udf(run, "array<double>")(data)
