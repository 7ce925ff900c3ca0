"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree deals source block quotas to output shards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.common import CARRIED_BYTES, cut

#: Words of a block at most, about, and blocks that each output shard gets on average at least (while a block has a word).
BLOCK_WORDS, BLOCKS_PER_SHARD = 1 << 18, 64
#: Blocks from the boundary block on from which rows are taken singly to come near a target, and words of them at least.
POOL_BLOCKS, POOL_WORDS = 8, 1 << 17
#: Bytes of a row of sources, about.
SOURCE_BYTES = 256
#: Words `[^\x20\x09-\x0D]+` of a text.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[int], share: float, most: float) -> list[float]:
    """Targets that share `share` times the sum of all sizes by weight; none is above `most` times its size, the excess is
    shared anew by weight among the others until none is above."""
    targets, left, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in above:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(above)]
    return targets


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(source, shard) block quotas: at each node the blocks of the left shards are a multivariate-hypergeometric draw from
    those of the node, so that every shard gets its exact number of blocks and every source's quota is used up."""
    if shards == 1:
        return quotas[:, None]
    left = shards // 2
    n = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, n, method="marginals") if n else np.zeros_like(quotas)
    return np.concatenate([splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, shards - left, rng)], axis=1)


@dataclass(frozen=True)
class MixPlan:
    """sources: source, source_no, source_size, target, blocks. draws: source_no, block, passes (which pass of the block goes to
    which shard), partly (whether the last pass takes only some rows of the block). edges: source_no, key: those rows."""

    sources: DataFrame
    draws: DataFrame
    edges: DataFrame


def sized(docs: DataFrame, payload: Column, source_col: str, text_col: str, id_col: str, seed: int) -> DataFrame:
    """Rows (payload, source, size, key): key is a fixed random number of the row's id and text."""
    text = F.col(text_col)
    return docs.select(payload.alias("payload"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key"))


def plan_mix(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, shards: int, seed: int) -> MixPlan:
    """What to draw. One row for each source reaches the driver; blocks stay distributed."""
    spark = rows.sparkSession
    found = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    found.sort(key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    sizes = [n for _, n in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    block = max(1, min(BLOCK_WORDS, sum(sizes) // (shards * BLOCKS_PER_SHARD)))
    full = [int(t // n) if n else 0 for t, n in zip(targets, sizes, strict=True)]
    table = [(s, i, n, t, max(1, n // block), f, t - f * n) for i, ((s, n), t, f) in enumerate(zip(found, targets, full, strict=True))]
    sources = spark.createDataFrame(table, "source string, source_no int, source_size long, target double, blocks long, full int, rest double")
    if len(table) * SOURCE_BYTES <= CARRIED_BYTES:  # so that rows do not meet by source, of which one may hold a third of them
        sources = F.broadcast(sources)

    words = blocked(rows, sources).groupBy("source_no", "block").agg(F.sum("size").alias("words"))
    blocks = cut(words, "blocks").join(sources.drop("source", "source_size", "target"), "source_no")
    each = blocks.withColumn("pass", F.explode(F.expr("sequence(0, full)")))
    # the draws of a source are its blocks in the permuted order of each pass, pass after pass
    each = cut(permuted(each.where("pass < full or rest > 0"), seed), "ranks")
    wanted = (F.col("pass") < F.col("full")) | (F.col("before") < F.col("rest") + max(POOL_BLOCKS * block, POOL_WORDS))
    counts = {r["source_no"]: r["n"] for r in each.where(wanted).groupBy("source_no").agg(F.count("*").alias("n")).collect()}
    quotas = np.array([counts.get(i, 0) for _, i, *_ in table], dtype=np.int64)
    dealt = splitting_tree(quotas, shards, np.random.default_rng(seed)) if len(quotas) else np.zeros((0, shards), dtype=np.int64)
    ends = spark.createDataFrame([(i, e) for i, e in enumerate(np.cumsum(dealt, axis=1).tolist())], "source_no int, ends array<long>")

    # each shard takes the next draws of its quota; what no shard has room for is not drawn
    place = F.col("pass") * F.col("filled") + F.col("rank")
    drawn = each.join(F.broadcast(ends), "source_no").withColumn("shard", F.size(F.filter("ends", lambda e: e <= place))).where(F.col("shard") < shards)
    past = (F.col("pass") == F.col("full")) & (F.col("before") + F.col("words") > F.col("rest"))
    drawn = drawn.withColumn("cut", F.when(past, F.col("rest") - F.col("before")))
    draws = drawn.groupBy("source_no", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("passes"), F.max("cut").alias("cut"))
    draws = cut(draws, "draws")
    partly = blocked(rows.where("size > 0"), sources).join(draws.where("cut is not null").drop("passes"), ["source_no", "block"])
    edges = partly.groupBy("source_no", "key").agg(F.sum("size").alias("size"), F.max("cut").alias("cut"))
    edges = edges.groupBy("source_no").applyInPandas(_first_fit, "source_no int, key long")
    return MixPlan(sources, draws.select("source_no", "block", "passes", F.col("cut").isNotNull().alias("partly")), cut(edges, "edges"))


def permuted(each: DataFrame, seed: int) -> DataFrame:
    """each (source_no, block, pass, words, ...) with `rank` and `before` (words) in the random order of each source's pass, and
    `filled`, the blocks in it. The order is cut into 64 parts by its hash, which are ranked on their own and moved by what is before, so a task has few blocks."""
    turn = F.xxhash64(F.lit(seed), "block", "pass")
    each = each.withColumn("turn", turn).withColumn("part", F.shiftrightunsigned("turn", 58))
    own = Window.partitionBy("source_no", "pass", "part").orderBy("turn", "block")
    ahead = Window.partitionBy("source_no", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("source_no", "pass", "part").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    filled = F.sum("n").over(Window.partitionBy("source_no", "pass")).alias("filled")
    sums = sums.select("source_no", "pass", "part", filled, *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in "nw"))
    here = F.coalesce(F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = each.withColumn("own", F.row_number().over(own) - 1).withColumn("here", here).join(sums, ["source_no", "pass", "part"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("n_ahead")).withColumn("before", F.col("here") + F.col("w_ahead"))
    return ranked.drop("turn", "part", "own", "here", "n_ahead", "w_ahead")


def _first_fit(block: pd.DataFrame) -> pd.DataFrame:
    """The rows of a source's last blocks that the mix takes: block by block and by key, each that still fits, then perhaps
    the smallest of the others if that comes nearer. There are POOL_BLOCKS blocks of about BLOCK_WORDS words at most, and not more
    rows than words, as rows without words are left out."""
    block = block.sort_values(["cut", "key"], ascending=[False, True])
    room, take = float(block["cut"].iloc[0]), []
    for size in block["size"]:
        take.append(size <= room)
        room -= size * take[-1]
    take = np.array(take)
    if not take.all():
        smallest = int(np.argmin(np.where(take, np.iinfo(np.int64).max, block["size"])))
        take[smallest] = block["size"].iloc[smallest] - room < room
    return block.loc[take, ["source_no", "key"]]


def blocked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    known = rows.join(sources.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source")))
    return known.drop("its_source").withColumn("block", F.pmod("key", "blocks"))


def draw(rows: DataFrame, plan: MixPlan, seed: int) -> DataFrame:
    """rows with source_size, target and draws: an array of (pass, shard, place) for each time that the mix takes the row.
    Sorted by place, a shard is locally shuffled."""
    known = blocked(rows, plan.sources).join(plan.draws, ["source_no", "block"], "left")
    # the last blocks of each source are taken in part; rows without words fit
    known = known.join(plan.edges.withColumn("fits", F.lit(True)), ["source_no", "key"], "left")
    short = F.col("partly") & F.col("fits").isNull() & (F.col("size") > 0)
    passes = F.when(short, F.slice("passes", 1, F.size("passes") - 1)).otherwise(F.col("passes"))
    passes = F.coalesce(passes, F.expr("cast(array() as array<struct<pass: int, shard: int>>)"))
    draws = F.transform(passes, lambda p: F.struct(p["pass"].alias("pass"), p["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.col("key"), p["pass"]).alias("place")))
    return known.select("payload", "source", "size", "source_size", "target", draws.alias("draws"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 8, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (id_col, source, size, source_size, target, draws), one for each row of docs.

    Sizes are words. Sources, by code point and null last, weigh `weights`, repeating; see water_fill() for their targets.
    A source's rows fall into blocks of about equal words by a hash. Its quota of blocks is whole passes over all blocks while
    the target lasts, then blocks of one more pass, the last few of them in part, so that a source's taken words come near its
    target and no row is taken more than ceil(target / source_size) times. The splitting tree deals the quotas to shards
    exactly, and each shard draws its quota as the next of the source's permuted blocks, so that shards get disjoint draws.

    Null texts have size 0 and null sources are a source of their own; null ids and repeated rows are rows like others (equal
    rows can stand for each other); an empty table gives no rows; other columns are ignored. Reruns give the same draws.
    """
    rows = cut(sized(docs, F.col(id_col), source_col, text_col, id_col, seed), "sizes")
    out = draw(rows, plan_mix(rows, weights, share, most, shards, seed), seed)
    return out.withColumnRenamed("payload", id_col)


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shards: int = 8, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: whole rows of docs, one for each draw, with all columns of docs and no others.

    Each partition lays its own rows out shard by shard, and those of a shard in the random order of their places, so no text is
    shuffled; a shard is what all partitions have of it.
    """
    stats = cut(sized(docs, F.lit(None).cast("int"), source_col, text_col, id_col, seed), "sizes")
    plan = plan_mix(stats, weights, share, most, shards, seed)
    rows = sized(docs, F.struct(*docs.columns), source_col, text_col, id_col, seed)
    drawn = draw(rows, plan, seed).select("payload", F.explode("draws").alias("drawn")).select("payload", "drawn.shard", "drawn.place")
    return drawn.sortWithinPartitions("shard", "place").select("payload.*")
