"""The queries that apply the corpus operators to their whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm.common import read_table

TOKENIZER, TOKEN_LIMIT = "word_bpe_49k.json", 2048
PACKING_TOKENIZER = "byte_bpe_50k.json"


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("mark"))


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of every tenth document, by a hash of its id, the words from some place on repeat; a null id has no such words."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.mixing import mix_sources

    mixed = mix_sources(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, shards=8)
    dealt = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["shard"], d["place"])), ",").alias("dealt")  # shard and place of each draw
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), dealt)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.quality import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), toxic_labels(spark, sf_dir))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.simhash import simhash_groups

    return simhash_groups(read_table(spark, sf_dir, "documents"), shingle=3, budget=3, seed=42)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.decontaminate import decontaminate

    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.license_scan import license_scan

    return license_scan(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from bandloom.llm.token_counts import token_counts

    counts = token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.html_wrappers import extract_articles

    texts = extract_articles(read_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.sharding import kd_shards

    placed = kd_shards(read_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.exact_topk import exact_topk

    vectors = read_table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.line_dedup import line_dedup

    kept = line_dedup(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep_first=False)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from bandloom.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER), room=2048, end_id=1)


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.resampling import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=25, least_words=20, longest=2, buckets=10_000, seed=7)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bandloom.llm.periodic_runs import periodic_runs, strongest

    found = periodic_runs(read_table(spark, sf_dir, "documents"), least=24, times=3, reorder=repeated_tail)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest("runs").alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_license_scans": op5_license_scans,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_exact_topk": op9_exact_topk,
    "op10_line_dedup": op10_line_dedup,
    "op11_sequence_packing": op11_sequence_packing,
    "op12_target_resampling": op12_target_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}
