"""A training-corpus pipeline over `documents`: five stages, each one of the corpus operators at work on whole rows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it back as the next
stage's docs. All stages but the last return the columns of documents; the last adds `shard`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.common import carried, cut, read_table
from bandloom.llm.decontaminate import decontaminate
from bandloom.llm.mixing import mixed_rows
from bandloom.llm.quality import quality_scores
from bandloom.llm.queries import toxic_labels
from bandloom.llm.sharding import sharded_rows
from bandloom.llm.simhash import near_duplicates


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one column beside their id and text, so that operators carry them through whatever their columns are."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go, among them those without words."""
    scored = quality_scores(_packed(docs), toxic_labels(spark, sf_dir), id_col="row", label_id_col="doc_id")
    return scored.where("keep").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, and of rows with equal id and text one, whatever
    their other columns are. A hash of the text stands in for a null id. Only ids are shuffled, but for repeated rows."""
    key = F.struct(F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("k"), F.xxhash64("text").alias("t"))
    rows = _packed(docs).withColumn("key", key)
    groups = near_duplicates(rows, id_col="key", shingle=5, similarity=0.8, budget=3)
    ids = groups.groupBy("key.k", "key.t").agg(F.count("*").alias("n"), F.max(F.col("key") == F.col("component_id")).alias("stays"))
    other = cut(ids.where("not stays or n > 1"), "copies")
    rows = rows.select("row", "key.k", "key.t")
    alone = rows.join(carried(other.select("k", "t"), 24), ["k", "t"], "left_anti")
    repeated = rows.join(carried(other.where("stays").select("k", "t"), 24), ["k", "t"], "left_semi").dropDuplicates(["k", "t"])
    return alone.unionByName(repeated).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(_packed(docs), read_table(spark, sf_dir, "benchmark"), id_col="row")
    return found.where("n_hit = 0").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix draws it."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard."""
    return sharded_rows(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: Fingerprints, the classifier and the random mix have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
