"""Importance resampling towards a target: hashed word n-grams of corpus and target, gains by bucket, and a Gumbel top draw."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import bounded_batches, cut, discard, keyed_texts, renamed, shuffle_width

#: A word of the lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BUCKETS = np.dtype("<u2")


def _splitter():
    """An untrained pre-tokenizer whose pieces are the words, with their offsets."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def window_crcs(text: str, spans: list[tuple[str, tuple[int, int]]], longest: int) -> list[list[int]]:
    """For each length up to `longest`, the CRCs of all windows of that many words, joined by one space. A window goes from one
    pair of offsets to another; its CRC goes on from that of the window without its last word, so no window is written out."""
    words = [text[a:b].encode() for _, (a, b) in spans]
    out = [list(map(crc32, words))]
    later = [b" " + w for w in words]
    for k in range(1, longest):
        out.append(list(map(crc32, later[k:], out[-1])))
    return out


def hashed(docs: DataFrame, longest: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n_words, features): the bucket of every feature of a text, as little-endian unsigned shorts."""
    bounded_batches(docs.sparkSession)
    keyed = keyed_texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter()
        for b in batches:
            counts, features = [], []
            for raw in b.column(1).to_pylist():
                text = (raw or b"").lower().decode()
                crcs = window_crcs(text, split.pre_tokenize_str(text), longest)
                counts.append(len(crcs[0]))
                features.append((np.array([c for some in crcs for c in some], np.int64) % buckets).astype(_BUCKETS).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(features, pa.binary())], ["id", "n_words", "features"])

    schema = T.StructType([renamed(keyed.schema["id"], "id"), T.StructField("n_words", T.LongType()), T.StructField("features", T.BinaryType())])
    return keyed.mapInArrow(run, schema)


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows: a task adds up its rows, Spark the tasks, and a row a bucket is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column(0)), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    rows = features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def _flat(column: pa.Array) -> np.ndarray:
    """All buckets of a column of rows."""
    return np.frombuffer(b"".join(column.to_pylist()), _BUCKETS)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much more often the target has each bucket, both smoothed by one, floored."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.array([math.floor(1000 * math.log(x)) for x in ((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))).tolist()], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows (id, n_words, n_features, weight): the floored mean of the gains of a text's features; 0 without any."""
    shipped = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x) for x in b.column("features").to_pylist()], np.int64) // _BUCKETS.itemsize
            ends = np.cumsum(sizes)
            sums = np.r_[0, np.cumsum(shipped.value[_flat(b.column("features"))])]
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_words"), pa.array(sizes), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    long = T.LongType()
    schema = T.StructType([features.schema["id"], *(T.StructField(c, long) for c in ("n_words", "n_features", "weight"))])
    return features.mapInArrow(run, schema)


def gumbel(id_col: str, seed: int) -> Column:
    """1000 times a Gumbel variate of the id and the seed, floored; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """(rows with their place from 1 in that order as `rank`, how many there are). Rows are dealt to tasks by ranges of the order,
    numbered there and moved by what is before; the last of the order must tell all rows apart, so that no range is too large."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    before, starts = 0, []
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        starts.append((r["part"], before))
        before += r["n"]
    parts = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    return dealt.join(parts, "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("part", "before", "place"), before


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_features, weight, score, rank), one for each row of docs.

    Texts are lower-cased by ASCII and split into words; features are all runs of 1 to `longest` words, in `buckets` (65 536 at
    most) by the CRC of their bytes. A bucket's gain compares all texts of target with all of docs; a document's weight is the
    floored mean of its gains, its score the weight and a Gumbel variate of its id. Of the documents with `least_words` words or
    more, `percent` per cent with the highest scores are drawn and ranked from 1, ties by the smaller id, null ids last, repeated
    rows in any order; others have no rank.

    Features are written once, 4 bytes a word, and read for the histogram and the weights, so texts are tokenized once. Only
    ids and scores are shuffled. Null and empty texts have no features, weight 0 and no rank; a null id draws as an empty one;
    an empty docs gives no rows; an empty target has no features, and all gains follow from the smoothing; other columns are ignored.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be 1 to 65536")
    features = cut(hashed(docs, longest, buckets, id_col, text_col), "features")
    gain = gains(histogram(features, buckets), histogram(hashed(target.select(F.lit(0).alias("k"), F.col(text_col).alias("t")), longest, buckets, "k", "t"), buckets))
    scored = cut(weighted(features, gain).withColumns({"score": F.col("weight") + gumbel("id", seed), "tie": F.monotonically_increasing_id()}), "scored")
    discard(features)
    drawn, n = ranked(scored.where(F.col("n_words") >= least_words), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie").asc())
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
