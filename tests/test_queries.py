"""Every named query of the engine beside its DuckDB SQL, and the contract of __spark_entry__."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bandloom.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import difference, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark, sf, con):
    assert difference(QUERIES[name](spark, sf), con, ORACLE_SQL[name]) is None


@pytest.fixture(scope="module")
def ragged(spark, sf, tmp_path_factory):
    """The last image lacks four of its blocks."""
    folder = str(tmp_path_factory.mktemp("ragged"))
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 496").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["jpeg_blocks", "policy_comparison", "bucket_store_serve"])
def test_a_last_image_that_is_not_full(name, spark, ragged):
    assert difference(QUERIES[name](spark, ragged), duck(ragged), ORACLE_SQL[name]) is None


ODD = {
    "empty": lambda d: d.withColumn("text", F.when(d.doc_id % 10 == 3, "").otherwise(d.text)),
    "null": lambda d: d.withColumn("text", F.when(d.doc_id % 10 == 3, None).otherwise(d.text)),
    "twice": lambda d: d.unionByName(d.where("doc_id < 20")),
    "none": lambda d: d.where("doc_id < 0"),
}


@pytest.mark.parametrize("kind", ODD)
def test_artefacts_of_odd_documents(kind, spark, sf, tmp_path):
    ODD[kind](spark.read.parquet(f"{sf}/documents.parquet")).write.parquet(f"{tmp_path}/documents.parquet")
    assert difference(QUERIES["artefact_sizes"](spark, str(tmp_path)), duck(str(tmp_path)), ORACLE_SQL["artefact_sizes"]) is None


def test_random_queries_agree_on_reruns(spark, sf):
    for name in ("alloc_random", "random_crops", "augmented", "mixup"):
        first, again = (sorted(map(tuple, QUERIES[name](spark, sf).collect())) for _ in range(2))
        assert first == again and first


def test_random_crops_fit(spark, sf):
    for r in QUERIES["random_crops"](spark, sf).collect():
        assert r["crop_h"] > 0 and r["crop_w"] > 0 and r["top"] >= 0 and r["left"] >= 0
        assert r["top"] + r["crop_h"] <= r["height"] and r["left"] + r["crop_w"] <= r["width"]


def test_random_allocation_keeps_the_quota(spark, sf):
    rows = QUERIES["alloc_random"](spark, sf).collect()
    by_image = {}
    for r in rows:
        by_image.setdefault(r["image_id"], []).append(r["k"])
    assert all(len(k) == 20 and sum(x == 16 for x in k) == 7 for k in by_image.values())


def test_precision_search_ends_with_a_pass(spark, sf):
    trials = sorted(QUERIES["precision_search"](spark, sf).collect(), key=lambda r: r["trial"])
    assert trials[-1]["passed"] and trials[-1]["psnr"] >= 45
    assert any(not t["passed"] for t in trials)


def test_chunk_store_serves_crops(spark, sf):
    rows = QUERIES["chunk_store_crops"](spark, sf).collect()
    full, cut = ({r["image_id"]: r for r in rows if r["bands"] == n} for n in (4, 3))
    assert full.keys() == cut.keys() and full
    for i in full:
        assert full[i]["values"] == 3 * 20 * 18
        assert full[i]["bytes_read"] > cut[i]["bytes_read"] and full[i]["psnr"] > cut[i]["psnr"]


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(0 < r["io_ratio"] <= 1 for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_published_ramp_means(spark, sf):
    means = {r["preset"]: r["avg_io"] for r in QUERIES["budget_ramp_means"](spark, sf).collect()}
    assert means["cap90"] == pytest.approx(0.6006, abs=2e-3) and means["cap80"] == pytest.approx(0.5605, abs=2e-3)
    assert means["big90"] == pytest.approx(0.75, abs=1e-3) and means["big70"] == pytest.approx(0.625, abs=1e-3)
