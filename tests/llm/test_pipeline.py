"""The corpus pipeline: its stages' decisions take effect and clean documents stay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from bandloom.llm.common import read_table
from tests.llm.data import empty_documents, odd_documents


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_run(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    out = cp.run(spark, sf).cache()
    assert out.columns == [*docs.columns, "shard"]
    assert out.drop("shard").distinct().exceptAll(docs).count() == 0
    bad = labels.where("quality = 0").join(out, "doc_id", "left_semi").count()
    assert bad <= 0.1 * labels.where("quality = 0").count()
    assert out.select("doc_id", "text").distinct().groupBy("text").count().where("count > 1").count() == 0
    assert out.groupBy("doc_id").count().where("count > 2").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_each_stage_bears_odd_rows(k, spark, sf):
    stage = cp.STAGES[k][1]
    for docs in (odd_documents(spark), odd_documents(spark, extra=True), empty_documents(spark)):
        out = stage(spark, docs, sf)
        assert set(out.columns) == ({*docs.columns, "shard"} if k == 4 else set(docs.columns))
        assert out.select("doc_id", "text").distinct().exceptAll(docs.select("doc_id", "text").distinct()).count() == 0


def test_dedup_keeps_one_of_each_group(spark, sf):
    docs = odd_documents(spark)
    out = cp.near_dedup(spark, docs, sf)
    assert out.where(F.col("doc_id").between(200, 211)).count() == 0 and out.where("doc_id = 3").count() == 1
    assert out.count() == out.distinct().count()


def test_decontamination_drops_planted_passages(spark, sf):
    item = read_table(spark, sf, "benchmark").where("length(text) > 80").first()["text"]
    docs = odd_documents(spark)
    planted = docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat(F.lit("before "), F.upper(F.lit(item)), F.lit(" after")))
    out = cp.decontamination(spark, docs.unionAll(planted), sf)
    assert out.where("doc_id >= 5000").count() == 0 and out.count() == docs.count()


def test_run_against_brute_force(spark, sf):
    """The whole pipeline over a small table: what the classifier keeps, then copies, benchmark windows and the mix by plain Python."""
    from collections import Counter

    from bandloom.llm.mixing import water_fill
    from tests.llm.test_results import near_copies

    docs = read_table(spark, sf, "documents")
    good = {r["doc_id"] for r in cp.quality(spark, docs, sf).select("doc_id").collect()}
    rows = sorted((r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect() if r["doc_id"] in good)
    root = near_copies([t.encode() for _, t, _ in rows])
    rows = [x for k, x in enumerate(rows) if root[k] == k]
    table = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
    words = lambda t: (t or "").encode().translate(table).split()
    items = [words(r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    lengths = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))
    rows = [x for x in rows if clean(words(x[1]))]
    out = cp.run(spark, sf).collect()
    times = Counter(r["doc_id"] for r in out)
    assert set(times) <= {i for i, *_ in rows} and {r["shard"] for r in out} == set(range(8))
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    size = {i: len(t.encode().split()) for i, t, _ in rows}
    sizes = [sum(size[i] for i, _, x in rows if x == s) for s in sources]
    targets = water_fill(sizes, [(3, 1, 2)[k % 3] for k in range(len(sources))], 1.5, 2.0)
    for s, n, target in zip(sources, sizes, targets, strict=True):
        mine = [i for i, _, x in rows if x == s]
        assert abs(sum(size[i] * times[i] for i in mine) - target) <= max(size[i] for i in mine) / 2 + 1
        assert all(int(target // n) <= times[i] <= -(-target // n) for i in mine) if n else True
