"""Every operator on odd, empty and clashing tables."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bandloom.llm.decontaminate import decontaminate
from bandloom.llm.exact_topk import exact_topk
from bandloom.llm.html_wrappers import extract_articles
from bandloom.llm.license_scan import license_scan
from bandloom.llm.line_dedup import line_dedup
from bandloom.llm.mixing import mix_sources, mixed_rows
from bandloom.llm.quality import quality_scores
from bandloom.llm.sharding import kd_shards, sharded_rows
from bandloom.llm.simhash import simhash_groups
from bandloom.llm.token_counts import token_counts
from tests.llm.data import empty_documents, odd_documents, same_rows


def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma"), (1, "omega"), (2, None), (3, " !! "), (None, "delta élan")], "item_id long, text string")


OPERATORS = {
    "mixing": mix_sources,
    "quality": quality_scores,
    "simhash": simhash_groups,
    "decontaminate": lambda d: decontaminate(d, benchmark(d.sparkSession)),
    "license": license_scan,
    "tokens": lambda d: token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
    "sharding": kd_shards,
    "lines": lambda d: line_dedup(d, min_docs=10, keep_first=False),
}


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row_and_no_clash(name, spark, odd):
    out = OPERATORS[name](odd).cache()
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"]) for r in df.select("doc_id").collect())
    assert ids(out) == ids(odd)
    assert same_rows(OPERATORS[name](odd_documents(spark, extra=True)), out)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, spark):
    assert OPERATORS[name](empty_documents(spark)).collect() == []


def test_whole_rows_keep_their_columns(spark, odd):
    wide = odd_documents(spark, extra=True)
    assert mixed_rows(wide).columns == wide.columns
    assert sharded_rows(wide).columns == [c for c in wide.columns if c != "shard"] + ["shard"]
    assert sharded_rows(odd).drop("shard").exceptAll(odd).count() == 0
    assert mixed_rows(odd).select("doc_id", "text").distinct().exceptAll(odd.select("doc_id", "text").distinct()).count() == 0


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, text string"
    rows = [(1, "https://a.b/x", "<article><p>T &amp; u<p>v</article><nav>n</nav>", "c", "c"), (2, None, "<p>plain", None, None), (3, "no url", None, "", ""), (None, "https://A.b/", "", "", ""), (1, "https://a.b/x", "<article><p>T &amp; u<p>v</article><nav>n</nav>", "c", "c")]
    out = extract_articles(spark.createDataFrame(rows, schema))
    assert sorted((r["page_id"] or 0, r["text"]) for r in out.collect()) == [(0, ""), (1, "T & u v"), (1, "T & u v"), (2, "plain"), (3, "")]
    assert extract_articles(spark.createDataFrame([], schema)).collect() == []


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, rank int, score string"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0]), (2, [0.25, 0.25]), (3, [0.25, 0.25]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [9.0, 9.0]), (100, []), (8, [1e30, 0.0])]
    v = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    out = exact_topk(v, v.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()
    top = 2**63 - 1
    assert [tuple(r) for r in out if r["query_id"] == 0] == [(0, 1, 8, top), (0, 2, 1, 1 << 20), (0, 3, 2, 256 * 1024 + 256 * 512)]
    assert [tuple(r) for r in out if r["query_id"] == 100] == [(100, 1, 0, 0), (100, 2, 0, 0), (100, 3, 1, 0)]
    none = v.where(F.lit(False))
    assert exact_topk(none, none).collect() == [] and exact_topk(none, v).collect() == []
