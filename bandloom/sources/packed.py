"""Packed stores: one payload file for a shard of images, an index of its chunks, and a manifest that says which shards there are.

    payload/NAME.bin      chunks of a shard by image, tile and band
    chunks/NAME.parquet   where each chunk lies in the payload
    images/NAME.parquet   the shard's images
    manifest/N.json       the shards that commit N has added; what no manifest lists is not there for any reader

NAME is new for every attempt of a task, so tasks that fail, run twice or outlive their job never touch a listed file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from bandloom.sources import files

HEAD = "label int, height int, width int, nph int, npw int, num_tiles int, source_key string, source_url string"
#: What a writer takes: a row for each chunk, and one with band_id -1 for each image, sorted by shard, image, tile and band.
WRITE_SCHEMA = f"shard_id int, image_id long, tile_id int, band_id int, num_blocks int, raw_length int, payload binary, {HEAD}"
INDEX = "image_id long, shard_id int, write_id string, tile_id int, band_id int, num_blocks int, offset long, length int, raw_length int"
READ_SCHEMA = f"{INDEX}, span long, span_length int, payload binary"
MANIFEST = "shard_id int, name string, images long, chunks long, bytes long, first_image long, last_image long, batch string"
_INDEX_TYPES = {"image_id": pa.int64(), "shard_id": pa.int32(), "write_id": pa.string(), "tile_id": pa.int32(), "band_id": pa.int32(), "num_blocks": pa.int32(), "offset": pa.int64(), "length": pa.int32(), "raw_length": pa.int32()}
_OPS = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}


@dataclass
class Shards(WriterCommitMessage):
    """The shards that a task has written."""

    rows: list[dict] = field(default_factory=list)


def committed(path: str) -> list[dict]:
    """The shards that the manifest lists."""
    return [json.loads(line) for n in files.names(f"{path}/manifest") for line in files.read_file(f"{path}/manifest/{n}").decode().splitlines() if line]


def commit_shards(path: str, new: list[dict], contiguous: bool, batch: str) -> bool:
    """Lists new shards, all at once, or none: a shard that is listed already, or with contiguous an image that does not follow on
    the last one, is an error. Of two that commit at the same time, the second is checked against the first. A batch that is
    listed already is not listed again; then the answer is no."""
    new = sorted(new, key=lambda s: s["shard_id"])
    while True:
        versions = files.names(f"{path}/manifest")
        old = committed(path)
        if batch and any(s["batch"] == batch for s in old):
            return False
        known = {s["shard_id"] for s in old}
        following = max((s["last_image"] for s in old), default=-1) + 1
        for s in new:
            if s["shard_id"] in known:
                raise ValueError(f"shard {s['shard_id']} is there already, or comes from two tasks")
            known.add(s["shard_id"])
            if contiguous and s["first_image"] != following:
                raise ValueError(f"shard {s['shard_id']} starts with image {s['first_image']} instead of {following}")
            following = s["last_image"] + 1
        if not new:
            return True
        number = int(versions[-1].removesuffix(".json")) + 1 if versions else 0
        rows = [s | {"batch": batch} for s in new]
        if files.create_new(f"{path}/manifest/{number:08d}.json", "".join(json.dumps(s) + "\n" for s in rows).encode()):
            return True


def discard(path: str, of: Iterable[str] | None = None) -> list[str]:
    """Deletes files that the manifest does not list, or only those whose names start so; without `of` not while a write runs."""
    listed, starts, gone = {s["name"] for s in committed(path)}, None if of is None else tuple(of), []
    for folder, suffix in (("payload", ".bin"), ("chunks", ".parquet"), ("images", ".parquet")):
        lost = [n for n in files.names(f"{path}/{folder}") if n.removesuffix(suffix) not in listed and (starts is None or n.startswith(starts))]
        files.delete_files(f"{path}/{folder}", lost)
        gone += lost
    return sorted({n.rpartition(".")[0] for n in gone})


class _Shard:
    """One shard while a task writes it: chunks go to the payload at once, their places are kept."""

    def __init__(self, path: str, write_id: str, shard_id: int, bands: int, contiguous: bool) -> None:
        self.path, self.shard_id, self.bands, self.contiguous = path, shard_id, bands, contiguous
        self.name = f"{write_id}-{shard_id:06d}-{uuid.uuid4().hex[:8]}"
        self.images: list[pa.RecordBatch] = []
        self.chunks: list[dict] = []
        self.tiles: dict[int, int] = {}
        self.held: dict[int, int] = {}
        self.at = 0
        fs, inner = files.located(f"{path}/payload/{self.name}.bin")
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(inner)

    def add(self, rows: pa.RecordBatch) -> None:
        heads = rows.filter(pc.equal(rows.column("band_id"), -1))
        self.images.append(heads)
        for i, n in zip(heads.column("image_id").to_pylist(), heads.column("num_tiles").to_pylist(), strict=True):
            if i in self.tiles:
                raise ValueError(f"image {i} is there twice")
            self.tiles[i] = n
        chunks = rows.filter(pc.not_equal(rows.column("band_id"), -1))
        payload = chunks.column("payload").to_pylist()
        lengths = [len(p) for p in payload]
        offsets = list(accumulate(lengths[:-1], initial=self.at))[: len(lengths)]
        self.out.write(b"".join(payload))
        self.at += sum(lengths)
        for i in chunks.column("image_id").to_pylist():
            self.held[i] = self.held.get(i, 0) + 1
        same = pa.array([self.shard_id] * len(payload), pa.int32()), pa.array([self.name] * len(payload), pa.string())
        columns = {"shard_id": same[0], "write_id": same[1], "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int32())}
        self.chunks.append(pa.RecordBatch.from_arrays([(columns.get(c) if c in columns else chunks.column(c)).cast(t) for c, t in _INDEX_TYPES.items()], list(_INDEX_TYPES)))

    def close(self) -> dict:
        self.out.close()
        for i, n in self.tiles.items():
            if self.held.pop(i, 0) != n * self.bands:
                raise ValueError(f"image {i} of shard {self.shard_id} does not have {n} tiles of {self.bands} bands")
        if self.held:
            raise ValueError(f"chunks of image {min(self.held)}, which shard {self.shard_id} does not hold")
        ids = sorted(self.tiles)
        if self.contiguous and ids != list(range(ids[0], ids[0] + len(ids))):
            raise ValueError(f"images of shard {self.shard_id} do not follow on each other")
        images = pa.Table.from_batches(self.images)
        images = images.drop_columns(["tile_id", "band_id", "num_blocks", "raw_length", "payload"]).append_column("write_id", pa.array([self.name] * len(images), pa.string()))
        chunks = pa.Table.from_batches(self.chunks)
        for folder, rows in (("images", images), ("chunks", chunks)):
            fs, inner = files.located(f"{self.path}/{folder}/{self.name}.parquet")
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            pq.write_table(rows, inner, filesystem=fs)
        return {"shard_id": self.shard_id, "name": self.name, "images": len(ids), "chunks": len(chunks), "bytes": self.at, "first_image": ids[0], "last_image": ids[-1]}


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.bands, self.batch = options["path"], int(options["bands"]), options.get("batch", "")
        self.contiguous = options.get("contiguous", "true") == "true"
        self.write_id = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        done, now = Shards(), None
        seen: set[int] = set()
        for b in iterator:
            ids = b.column("shard_id").to_pylist()
            cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if now is None or now.shard_id != ids[lo]:
                    if now is not None:
                        done.rows.append(now.close())
                    if ids[lo] in seen:
                        raise ValueError(f"rows of shard {ids[lo]} are not together")
                    seen.add(ids[lo])
                    now = _Shard(self.path, self.write_id, ids[lo], self.bands, self.contiguous)
                now.add(b.slice(lo, hi - lo))
        if now is not None:
            done.rows.append(now.close())
        return done

    def commit(self, messages: list[Shards | None]) -> None:
        if not commit_shards(self.path, [r for m in messages if m is not None for r in m.rows], self.contiguous, self.batch):
            discard(self.path, [self.write_id])

    def abort(self, messages: list[Shards | None]) -> None:
        discard(self.path, [self.write_id])


class _Reader(DataSourceReader):
    """Filters on the columns of the index decide which shards are opened, and which bytes of their payloads."""

    def __init__(self, path: str, filters: list[tuple[str, str, object]]) -> None:
        self.path, self.filters = path, filters

    def _may_hold(self, shard: dict) -> bool:
        """Whether a shard can have rows that all filters let through."""
        for column, op, v in self.filters:
            if column in ("image_id", "shard_id"):
                lo, hi = (shard["first_image"], shard["last_image"]) if column == "image_id" else (shard["shard_id"],) * 2
                fits = any(lo <= x <= hi for x in v) if op == "in" else {"=": lo <= v <= hi, ">": hi > v, ">=": hi >= v, "<": lo < v, "<=": lo <= v}[op]
                if not fits:
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s["name"]) for s in committed(self.path) if self._may_hold(s)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        keep = pc.scalar(True)
        for column, op, v in self.filters:
            keep = keep & (pc.field(column).isin(v) if op == "in" else _OPS[op](pc.field(column), v))
        fs, inner = files.located(f"{self.path}/chunks/{partition.value}.parquet")
        index = pq.read_table(inner, filesystem=fs, filters=keep, schema=pa.schema(list(_INDEX_TYPES.items()))).sort_by("offset").combine_chunks()
        yield from with_payloads(self.path, iter(index.to_batches()))


class PackedChunks(DataSource):
    """The chunks of a packed store. Options: path; for reading filters; for writing bands, contiguous (default true) and batch."""

    @classmethod
    def name(cls) -> str:
        return "packed_chunks"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], json.loads(self.options.get("filters", "[]")))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("packed stores only grow: use mode('append')")
        return _Writer(dict(self.options))


def with_payloads(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index, in the order of write_id and offset, with the bytes of their chunks, and the reads (span, span_length)
    that fetched these: chunks that follow on each other are one read, and one that comes again is not read again."""
    open_name, file = None, None
    for b in batches:
        owners, offsets, lengths = (b.column(c).to_pylist() for c in ("write_id", "offset", "length"))
        lo = 0
        while lo < len(owners):
            hi = lo
            while hi < len(owners) and owners[hi] == owners[lo]:
                hi += 1
            if owners[lo] != open_name:
                if file is not None:
                    file.close()
                fs, inner = files.located(f"{path}/payload/{owners[lo]}.bin")
                open_name, file = owners[lo], fs.open_input_file(inner)
            for first, end, parts, start, length in files.fetched(file, list(zip(offsets[lo:hi], lengths[lo:hi], strict=True))):
                rows = b.slice(lo + first, end - first)
                extra = [pa.array([start] * len(parts), pa.int64()), pa.array([length] * len(parts), pa.int32()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, "span", "span_length", "payload"])
            lo = hi
    if file is not None:
        file.close()


def write_packed(rows: DataFrame, path: str, bands: int, contiguous: bool = True, batch: str = "") -> None:
    """Adds rows of WRITE_SCHEMA to the store: all of them, or none if a task or a check fails."""
    dealt = rows.repartition("shard_id").sortWithinPartitions("shard_id", "image_id", "tile_id", "band_id")
    rows.sparkSession.dataSource.register(PackedChunks)
    options = {"path": path, "bands": str(bands), "contiguous": str(contiguous).lower(), "batch": batch}
    dealt.select(*(f.name for f in T._parse_datatype_string(WRITE_SCHEMA).fields)).write.format("packed_chunks").options(**options).mode("append").save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shard_id, name, images, chunks, bytes, first_image, last_image, batch), one for each shard."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest") if files.names(f"{path}/manifest") else spark.createDataFrame([], MANIFEST)


def packed_chunks(spark: SparkSession, path: str, *filters: tuple[str, str, int | list[int]]) -> DataFrame:
    """Chunks with their payloads. filters, all of which hold, are (column, operator, value): image_id, shard_id, tile_id or band_id;
    =, <, <=, >, >= or in. They become shards that are not opened and byte ranges of the payloads.

    Filters are arguments and not left to where(), as Spark keeps the filters that it pushes into a source in Python with the
    relation, and a frame that is then filtered in another way, or not at all, would read by the first ones.
    """
    for column, op, v in filters:
        if column not in ("image_id", "shard_id", "tile_id", "band_id") or op not in (*_OPS, "in") or isinstance(v, list) != (op == "in"):
            raise ValueError(f"no filter: {column} {op} {v}")
    spark.dataSource.register(PackedChunks)
    return spark.read.format("packed_chunks").options(path=path, filters=json.dumps(filters)).load()


def packed_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, chunks) of the listed shards, without payloads. write_id is the name of the shard's files."""
    shards = manifest(spark, path).select(F.col("name").alias("write_id"))
    listed = lambda df: df.join(shards, "write_id", "left_semi")
    head = f"shard_id int, image_id long, {HEAD}, write_id string"
    return listed(spark.read.schema(head).parquet(f"{path}/images")), listed(spark.read.schema(INDEX).parquet(f"{path}/chunks"))


def global_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (image_id, shard_id, row): the shard of each image, and its place in the shard's list of images."""
    images, _ = packed_index(spark, path)
    place = F.row_number().over(Window.partitionBy("write_id").orderBy("image_id")) - 1  # the images of one shard
    return images.select("image_id", "shard_id", place.cast("int").alias("row"))


def fetch(rows: DataFrame, path: str, *more: str) -> DataFrame:
    """Rows of packed_index(), with any further columns, and their payload, span and span_length. Rows are dealt by ranges of their
    place, and of `more` columns where many rows want one chunk, so tasks read ascending ranges of few files."""
    order = ["write_id", "offset", *more]
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    extra = T._parse_datatype_string("span long, span_length int, payload binary").fields
    return dealt.mapInArrow(lambda batches: with_payloads(path, batches), T.StructType([*dealt.schema.fields, *extra]))


def opened(reads: DataFrame, *by: str) -> DataFrame:
    """Rows (by, bytes_opened, reads): what was read of payload files for rows with spans, each read once."""
    each = reads.select(*by, "write_id", "span", "span_length").distinct()
    return each.groupBy(*by).agg(F.sum("span_length").alias("bytes_opened"), F.count("*").alias("reads"))

