"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.common import bounded_batches, ceil_div, cut

#: Queries that one pass over the candidates answers; a pass carries them to the tasks (at 64 components about 33 MB).
QUERY_BLOCK = 65_536
#: Queries and candidates of one dense score array (int32: 16 MB).
SCORE_ROWS, SCORE_COLS = 512, 8192
#: Rows with larger components are scored with Python's integers.
LARGE = 2**28
LOWEST = np.iinfo(np.int64).min


def integer_rows(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows that take part, their integer components as int64, or as objects if some are large).

    A row is left out if it is null, or a component is null, not finite, or overflows a double when scaled. Shorter vectors
    are filled up with zeros.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    lengths = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    valid = np.asarray(vectors.is_valid())
    flat = vectors.flatten()
    good = np.asarray(flat.is_valid())
    x = np.asarray(flat.cast(pa.float64()).fill_null(0.0)) * float(scale)
    good &= np.isfinite(x)
    row = np.repeat(np.arange(n), lengths)
    valid &= np.bincount(row[~good], minlength=n) == 0
    x = np.floor(np.where(good, x, 0.0))
    dims = int(lengths.max(initial=0))
    keep = np.flatnonzero(valid)
    at = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(x) and np.abs(x).max() >= LARGE:
        out = np.zeros((n, dims), dtype=object)
        out[row, at] = [int(v) for v in x]
    else:
        out = np.zeros((n, dims), dtype=np.int64)
        out[row, at] = x.astype(np.int64)
    return keep, out[keep]


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores of every query with every row of block, term at a time: each non-zero query weight scatters its term's postings."""
    dims = min(queries.shape[1], block.shape[1])
    if queries.dtype == object or block.dtype == object:
        scores = np.zeros((len(queries), len(block)), dtype=object)
    else:
        bound = int(np.abs(queries).max(initial=0)) * int(np.abs(block).max(initial=0)) * max(dims, 1)
        kind = np.int32 if bound < 2**31 else np.int64
        queries, block, scores = queries.astype(kind), block.astype(kind), np.zeros((len(queries), len(block)), dtype=kind)
    for t in range(dims):
        weights, rows = block[:, t], np.flatnonzero(queries[:, t])
        posted = np.flatnonzero(weights)
        if len(rows) == len(queries) and 2 * len(posted) >= len(block):
            scores += queries[:, t, None] * weights
        elif len(rows) and len(posted):
            scores[np.ix_(rows, posted)] += queries[rows, t, None] * weights[posted]
    if scores.dtype == object:
        scores = np.clip(scores, LOWEST + 1, np.iinfo(np.int64).max)
    return scores.astype(np.int64)


def _strip(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row that reach `least`; of equal ones the first columns. Never more than k a row."""
    n = scores.shape[1]
    if n > k:
        bound = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
        above = scores > bound[:, None]
        tied = scores == bound[:, None]
        room = k - above.sum(axis=1)
        tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= room[:, None]
        return np.nonzero(above | tied)
    return np.nonzero(scores >= least[:, None])


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query; ties go to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < k
    return query[keep], ids[keep], scores[keep]


def scan(qids: np.ndarray, queries: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of the k best candidates of all blocks for each query, a query's own id left out.

    Memory: the queries, k rows for each, and one strip of scores, however many scores are equal.
    """
    strips = range(0, len(qids), SCORE_ROWS)
    found = [(np.zeros(0, np.int64),) * 3 for _ in strips]
    floor = np.full(len(qids), LOWEST + 1)
    for all_ids, all_rows in blocks:
        order = np.argsort(all_ids, kind="stable")  # so that of equal scores the smaller ids come first
        all_ids, all_rows = all_ids[order], all_rows[order]
        for c in range(0, len(all_ids), SCORE_COLS):
            ids, rows = all_ids[c : c + SCORE_COLS], all_rows[c : c + SCORE_COLS]
            for i, q in enumerate(strips):
                scores = accumulate(queries[q : q + SCORE_ROWS], rows)
                scores[qids[q : q + SCORE_ROWS, None] == ids] = LOWEST
                r, col = _strip(scores, floor[q : q + SCORE_ROWS], k)
                if not len(r):
                    continue
                found[i] = mine = _best(*(np.concatenate(x) for x in zip(found[i], (r + q, ids[col], scores[r, col]), strict=True)), k)
                count = np.bincount(mine[0] - q, minlength=len(scores))
                full = np.flatnonzero(count == k)
                floor[q + full] = mine[2][(np.cumsum(count) - 1)[full]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, id_col, score): for each query row its k highest integer inner products over all rows of vectors.

    Each component x becomes floor(scale * x); scores beyond a long count as the largest or smallest one, so they tie and go by
    id. Queries are written in blocks of about query_block rows. One block at a time, of that fixed size, goes to the tasks, which pass over the candidates and write k rows for each query; it is released before
    the next one is read. A ranked window merges what the tasks wrote.

    Left out on both sides: rows with a null id, null vectors, and vectors with null or non-finite components. Shorter vectors
    count as filled up with zeros. Rows that share a query's id are its own rows and no candidates; equal query rows count
    once, equal candidate rows each. Ties go to the smaller id. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)

    def pick(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null")

    asked = pick(queries).dropDuplicates()
    n_queries = asked.count()
    rounds, merged = ceil_div(n_queries, query_block), None
    if rounds > 1:  # by id and vector, so that many vectors of one id spread too
        asked = cut(asked.withColumn("round", F.pmod(F.xxhash64("id", "v"), F.lit(rounds)).cast("int")), "queries", "round")
    for r in range(rounds):
        table = (asked.where(F.col("round") == r) if rounds > 1 else asked).select("id", "v").toArrow()
        keep, rows = integer_rows(table.column("v"), scale)
        sent = spark.sparkContext.broadcast((np.asarray(table.column("id"))[keep], rows))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, qrows = sent.value

            def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for b in batches:
                    keep, rows = integer_rows(b.column(1), scale)
                    yield np.asarray(b.column(0))[keep], rows

            query, ids, scores = scan(qids, qrows, blocks(), k)
            for at in range(0, len(query), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(query[part]), pa.array(qids[query[part]]), pa.array(ids[part]), pa.array(scores[part])], ["query", "query_id", "id", "score"])

        part = pick(vectors).mapInArrow(search, "query long, query_id long, id long, score long").withColumn("round", F.lit(r))
        if rounds > 1:
            part = cut(part, "found")
            sent.destroy()
        merged = part if merged is None else merged.unionAll(part)
    order = Window.partitionBy("round", "query").orderBy(F.desc("score"), "id")
    best = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")
