"""Folders: the one that driver and executors share, lists of shards, and sizes of what lies in them."""

from __future__ import annotations

import atexit
import fnmatch
import re
import tempfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.sources import files

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one told to setCheckpointDir(). Where neither is
    set, a temporary folder of a session in local mode; on a cluster that is an error, as no machine sees another's."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        told = folder.get() if folder.isDefined() else None
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        own = tempfile.TemporaryDirectory(prefix="bandloom-")
        _own[app] = own.name
        atexit.register(own.cleanup)
    return _own[app]


_RANGE = re.compile(r"\{(\d+)\.\.(\d+)\}")


def expand_braces(pattern: str) -> list[str]:
    """All names of a pattern with ranges like {0000..0012}; a bound that starts with zero fixes the width."""
    found = _RANGE.search(pattern)
    if found is None:
        return [pattern]
    low, high = found[1], found[2]
    if int(low) > int(high):
        raise ValueError(f"reversed range {found[0]} in {pattern!r}")
    width = max(len(b) for b in (low, high)) if any(b[0] == "0" and len(b) > 1 for b in (low, high)) else 0
    tails = expand_braces(pattern[found.end() :])
    return [f"{pattern[: found.start()]}{i:0{width}d}{tail}" for i in range(int(low), int(high) + 1) for tail in tails]


def shard_list(patterns: str | list[str]) -> list[str]:
    """The shards of one or several patterns; no shards, or braces that are no range, are an error."""
    out = [s for p in ([patterns] if isinstance(patterns, str) else patterns) for s in expand_braces(p)]
    if not out:
        raise ValueError("no shards")
    if left := [s for s in out if "{" in s or "}" in s]:
        raise ValueError(f"braces without a range in {left[0]!r}")
    return out


def listed_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Rows (path, length) of the files in a folder whose name fits, and with recursive of those in folders below it. Files without
    a byte are listed as well, which Spark's own sources leave out. One task and not the driver lists the folder; the folders in it
    are listed by as many tasks as a shuffle has."""
    globs = files.alternatives(glob)

    def rows(found: Iterator[tuple[str, int | None]]) -> Iterator[pa.RecordBatch]:
        fits = (x for x in found if x[1] is None or any(fnmatch.fnmatchcase(x[0].rpartition("/")[2], g) for g in globs))
        while some := list(islice(fits, 65_536)):
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some]), pa.array([n for _, n in some], pa.int64())], ["path", "length"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from rows((p, n) for p, n in files.entries(path) if recursive or n is not None)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.is_valid(b.column("length")))
            for folder in b.filter(pc.is_null(b.column("length"))).column("path").to_pylist():
                yield from rows(files.walked(folder))

    first = spark.range(0, 1, 1, 1).mapInArrow(top, "path string, length long")
    return first.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(below, first.schema) if recursive else first


def sizes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Rows (folder, files, bytes) below a folder, from the listing alone: contents are not read."""
    found = listed_files(spark, path, glob)
    return found.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def forecast(sample: DataFrame, total: int) -> DataFrame:
    """Rows (n, mean_bytes, std_bytes, forecast_bytes) of a sample's sizes (bytes), carried on to `total` records."""
    out = sample.agg(F.count("*").alias("n"), F.avg("bytes").alias("mean_bytes"), F.stddev_pop("bytes").alias("std_bytes"))
    return out.withColumn("forecast_bytes", F.col("mean_bytes") * total)
