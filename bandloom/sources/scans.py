"""Scans of files that are kept and brought up to date: a manifest knows which version of each file was scanned with what parameters.

    results/run=ID/       what the scan of run ID has returned, with the file of each row in `shard`
    manifest/run=ID/      rows (shard, bytes, modified, parameters, scanned) of all files as of run ID; scanned: the run of its results
    versions/N.json       the runs that were finished, in their order; a run that is not listed is not there for any reader
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.sources import files

MANIFEST = "shard string, bytes long, modified timestamp, parameters string, scanned string"
Scan = Callable[[DataFrame], DataFrame]


def listing(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Rows (shard, bytes, modified) of files, from the listing alone: contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("shard"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def digest(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()


def finished_runs(store: str) -> list[dict]:
    return [json.loads(files.read_file(f"{store}/versions/{n}")) for n in files.names(f"{store}/versions")]


def manifest(spark: SparkSession, store: str, runs: list[dict] | None = None) -> DataFrame:
    """The files that the last finished run knows."""
    runs = finished_runs(store) if runs is None else runs
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/run={runs[-1]['run']}") if runs else spark.createDataFrame([], MANIFEST)


def outdated(now: DataFrame, known: DataFrame, parameters: dict) -> DataFrame:
    """The files of a listing that are new, have another size or time than when they were scanned, or were scanned with other
    parameters."""
    same = known.where(F.col("parameters") == digest(parameters)).select("shard", "bytes", "modified")
    return now.join(same, ["shard", "bytes", "modified"], "left_anti")


def brought_up_to_date(spark: SparkSession, now: DataFrame, store: str, parameters: dict, scan: Scan) -> bool:
    """Scans what is outdated and nothing else; whether there was anything. scan takes rows (shard, bytes, modified) and returns
    rows with the file of each in `shard`; what it returns must depend on the files and the parameters alone.

    Files that are gone are forgotten. A run whose job fails is not listed, and its files are never read. Of two runs that end at
    the same time, the second is an error, as it does not know what the first has scanned.
    """
    runs = finished_runs(store)
    known, run = manifest(spark, store, runs), uuid.uuid4().hex
    todo = outdated(now, known, parameters)
    stays = known.where(F.col("parameters") == digest(parameters)).join(now, ["shard", "bytes", "modified"], "left_semi")
    new = todo.select("shard", "bytes", "modified", F.lit(digest(parameters)).alias("parameters"), F.lit(run).alias("scanned"))
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    stays.select(*columns).unionByName(new).write.parquet(f"{store}/manifest/run={run}")
    fresh = spark.read.schema(MANIFEST).parquet(f"{store}/manifest/run={run}")
    scanned = fresh.where(F.col("scanned") == run).count()
    if not scanned and runs and fresh.count() == known.count():
        return False
    if scanned or not runs:
        scan(fresh.where(F.col("scanned") == run).select("shard", "bytes", "modified")).write.parquet(f"{store}/results/run={run}")
    if not files.create_new(f"{store}/versions/{len(runs):08d}.json", json.dumps({"run": run, "parameters": parameters, "scanned": scanned}, default=str).encode()):
        raise RuntimeError(f"another run of {store} has ended meanwhile")
    return True


def results(spark: SparkSession, store: str) -> DataFrame:
    """What the scans of the files of the last finished run have returned, from the folders of the runs that count."""
    now = manifest(spark, store).select("shard", "scanned")
    runs = [r[0] for r in now.select("scanned").distinct().collect()] or [finished_runs(store)[-1]["run"]]  # a row for each run
    rows = spark.read.option("basePath", f"{store}/results").parquet(*(f"{store}/results/run={x}" for x in runs))
    return rows.join(now.withColumnRenamed("scanned", "run"), ["shard", "run"], "left_semi").drop("run")


def ensured(spark: SparkSession, path: str | list[str], store: str, parameters: dict, scan: Scan, glob: str = "*") -> DataFrame:
    """The results for the files in `path` as they are now: scanned if there are none yet, in part if some files have changed, all
    again if the parameters have, and otherwise as they are."""
    brought_up_to_date(spark, listing(spark, path, glob), store, parameters, scan)
    return results(spark, store)
