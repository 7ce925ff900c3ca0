"""Sharding by a k-d tree over metadata, with DataFrame functions only."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandloom.llm.common import carried, cut

#: Equal bins of each dimension's range in the whole table, and of the hash that parts the rows of a bin.
BINS = 1024
#: A group of equal texts above this part of a shard's bytes is placed on its own, so that no cut of the tree has to hit it.
LARGE_GROUP = 1 / 64
#: A group of equal texts stays together up to this part of a shard's bytes; larger ones are split by row.
WHOLE_GROUP = 0.5
#: Rows that one numbering group holds on average at most, and the least number of groups of a shard.
NUMBERED_ROWS, NUMBERED_GROUPS = 8192, 64

DIMENSIONS = ("bytes", "non_ascii", "spaces")


def measured(docs: DataFrame, payload: Column, text_col: str = "text") -> DataFrame:
    """Rows (payload, size, crc, grp, dims, salt): metadata of the text alone, so that equal texts lie at one point, but for salt.

    dims: log2 of the bytes, the share of non-ASCII surplus bytes, and the share of spaces. salt: a random number that parts
    repeated rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.octet_length(text)
    size = (n + 1).cast("long")
    dims = F.array(F.log2(size.cast("double")), (n - F.length(text)) / size, (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / size)
    salt = F.floor(F.rand(8) * (1 << 31)).cast("int")
    return docs.select(payload.alias("payload"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("grp"), dims.alias("dims"), salt.alias("salt"))


@dataclass
class ShardPlan:
    """Cuts of the tree by node (root 1, children 2n and 2n + 1): (dimension, bin, bin of the hash) where the right side begins.

    shard_of: the shard of each leaf. placed: rows (grp, home) of large groups that stay together, with their shard.
    split_groups: groups to split by row; salted: whether their rows are repeated so often that they need salt.
    """

    low: list[float]
    spans: list[float]
    placed: DataFrame | None = None
    split_groups: list[int] = field(default_factory=list)
    salted: bool = False
    cuts: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    shard_of: dict[int, int] = field(default_factory=lambda: {1: 0})

    def binned(self, rows: DataFrame, row_key: Column) -> DataFrame:
        """rows with `bins`, one for each dimension and a last one for rows at one point, `tie`, and `home` of placed groups."""
        key = F.col("grp")
        if self.split_groups:
            row_key = F.xxhash64(row_key, "salt") if self.salted else row_key
            key = F.when(F.col("grp").isin(self.split_groups), row_key).otherwise(key)
        at = [F.least(F.lit(BINS - 1), F.floor((F.get("dims", F.lit(i)) - lo) * (BINS / span))) for i, (lo, span) in enumerate(zip(self.low, self.spans, strict=True))]
        hashed = [F.pmod(F.xxhash64(key, F.lit(name)), F.lit(BINS)) for name in ("point", "tie")]
        rows = rows.withColumn("bins", F.array(*(x.cast("int") for x in (*at, hashed[0])))).withColumn("tie", hashed[1].cast("int"))
        return rows.withColumn("home", F.lit(None).cast("int")) if self.placed is None else rows.join(F.broadcast(self.placed), "grp", "left")

    def routed(self, rows: DataFrame) -> DataFrame:
        """rows sent down the tree: `node` becomes the leaf. One fold over the levels, with the cuts as a constant array."""
        if not self.cuts:
            return rows.withColumn("node", F.lit(1))
        none = "cast(null as struct<dim: int, bin: int, tie: int>)"
        told = (self.cuts.get(n) for n in range(max(self.cuts) + 1))
        cuts = ", ".join(none if c is None else f"named_struct('dim', {c[0]}, 'bin', {c[1]}, 'tie', {c[2]})" for c in told)
        right = "get(bins, c.dim) > c.bin or (get(bins, c.dim) = c.bin and tie >= c.tie)"
        step = f"transform(array(get(array({cuts}), node)), c -> if(c is null, node, 2 * node + int({right})))[0]"
        return rows.withColumn("node", F.expr(f"aggregate(sequence(1, {max(self.cuts).bit_length()}), 1, (node, level) -> {step})"))

    def assigned(self, rows: DataFrame, row_key: Column) -> DataFrame:
        """rows with `shard`."""
        shards = F.array(*(F.lit(self.shard_of.get(i, 0)) for i in range(max(self.shard_of) + 1)))
        sent = self.routed(self.binned(rows, row_key)).withColumn("shard", F.coalesce("home", F.get(shards, F.col("node"))))
        return sent.drop("bins", "tie", "home", "node", "dims", "grp")


def _literal_rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A few rows of numbers, or of literals as they stand, as constants of the plan."""
    told = (", ".join(f"{v!r}D" if isinstance(v, float) else str(v) for v in row) for row in rows)
    return spark.range(1).selectExpr(f"inline(array({', '.join(f'struct({t})' for t in told)}))").toDF(*names.split())


def _reached(sums: DataFrame, *keys: str) -> DataFrame:
    """Of sums (keys, wanted, bin, weight) the bin of each key in which the weight `wanted` is reached, with `before`, the weight
    before it, and the first and last bin. A key has BINS bins at most."""
    upto = F.sum("weight").over(Window.partitionBy(*keys).orderBy("bin"))
    ends = Window.partitionBy(*keys)
    told = sums.withColumn("before", upto - F.col("weight")).withColumn("first", F.min("bin").over(ends)).withColumn("last", F.max("bin").over(ends))
    return told.where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("weight") >= F.col("wanted")))


def fit(meta: DataFrame, shards: int, row_key: Column) -> ShardPlan:
    """The k-d tree: every node is cut along its widest dimension at the weighted quantile that leaves each side the bytes of its
    shards, until a leaf is one shard.

    Widths count in parts of the whole table's range. Large groups of equal texts are dealt to shards first, the largest to the
    emptiest, and the leaves take what room they leave. A level takes two jobs: weights by bin for all dimensions of all
    nodes, and by hash within the bins that are cut. A few numbers for each node reach the driver.
    """
    spark, k = meta.sparkSession, len(DIMENSIONS)
    at = [F.get("dims", F.lit(i)) for i in range(k)]
    total = meta.agg(F.sum("size").alias("n"), *(f(c) for c in at for f in (F.min, F.max))).first()
    weight = total["n"] or 0
    if not weight:
        return ShardPlan([0.0] * k, [1.0] * k)
    plan = ShardPlan([total[1 + 2 * i] for i in range(k)], [max(total[2 + 2 * i] - total[1 + 2 * i], 1e-12) for i in range(k)])
    share = weight / shards
    groups = meta.groupBy("grp").agg(F.sum("size").alias("n")).where(F.col("n") > LARGE_GROUP * share)
    large = sorted(((r["n"], r["grp"]) for r in groups.collect()), reverse=True)  # fewer than shards / LARGE_GROUP
    plan.split_groups = [g for n, g in large if n > WHOLE_GROUP * share]
    if plan.split_groups:
        repeats = meta.where(F.col("grp").isin(plan.split_groups)).groupBy(row_key.alias("row")).agg(F.sum("size").alias("n"))
        plan.salted = not repeats.where(F.col("n") > LARGE_GROUP * share).isEmpty()
    emptiest, homes = [(0, s) for s in range(shards)], []
    for n, g in large[len(plan.split_groups) :]:
        held, s = heapq.heappop(emptiest)
        homes.append((g, s))
        heapq.heappush(emptiest, (held + n, s))
    if homes:
        plan.placed = _literal_rows(spark, "grp home", [(f"{g}L", s) for g, s in homes])
    room = [max(share - held, 0.0) for held, _ in sorted(emptiest, key=lambda x: x[1])]

    rows = plan.binned(meta, row_key).where("home is null").select("size", "bins", "tie")
    open_ = {1: (0, shards)}  # the shards of each node
    while open_:
        wanted = []
        for n, (lo, hi) in open_.items():
            mid = (lo + hi) // 2
            wanted.append((n, sum(room[lo:mid]) / max(sum(room[lo:hi]), 1e-9)))
        here = plan.routed(rows).join(F.broadcast(_literal_rows(spark, "node part", wanted)), "node")  # a row for each node that is cut
        by_bin = here.select("node", "part", "size", F.posexplode("bins").alias("dim", "bin")).groupBy("node", "dim", "part", "bin").agg(F.sum("size").alias("weight"))
        whole = F.sum("weight").over(Window.partitionBy("node", "dim"))
        cut_at: dict[int, tuple] = {}
        for r in _reached(by_bin.withColumn("wanted", F.greatest(F.lit(0.5), F.col("part") * whole)), "node", "dim").collect():
            width = r["last"] - r["first"] if r["dim"] < k else -1  # the last one only where all rows are at one point
            if width != 0 and (r["node"] not in cut_at or width > cut_at[r["node"]][0]):
                cut_at[r["node"]] = (width, r["dim"], r["bin"], r["wanted"], r["before"])
        below: dict[int, tuple[int, int]] = {}
        ties = {}
        if cut_at:
            table = _literal_rows(spark, "node dim bin wanted", [(n, dim, bin_, float(w - before)) for n, (_, dim, bin_, w, before) in cut_at.items()])
            inside = here.join(F.broadcast(table), "node").where(F.get("bins", F.col("dim")) == F.col("bin"))
            by_tie = inside.groupBy("node", "wanted", F.col("tie").alias("bin")).agg(F.sum("size").alias("weight"))
            ties = {r["node"]: r for r in _reached(by_tie, "node").collect()}
        for n, (lo, hi) in open_.items():
            mid = (lo + hi) // 2
            if n not in ties:  # a node without rows, or one whose rows cannot be parted
                plan.shard_of[n] = lo
                continue
            _, dim, bin_, *_ = cut_at[n]
            r = ties[n]
            after = r["before"] + r["weight"] - r["wanted"] < r["wanted"] - r["before"]  # the nearer end of the bin
            plan.cuts[n] = (dim, bin_, r["bin"] + int(after))
            for child, part in ((2 * n, (lo, mid)), (2 * n + 1, (mid, hi))):
                if part[1] - part[0] > 1:
                    below[child] = part
                else:
                    plan.shard_of[child] = part[0]
        if shards == 1:
            plan.cuts, plan.shard_of, below = {}, {1: 0}, {}
        open_ = below
    return plan


def numbered(rows: DataFrame, shards: int, n_rows: int, row_key: Column) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard: hashed groups are numbered on their own, then moved by the rows before.
    Groups that many repeated rows make large are parted by salt."""
    groups = max(NUMBERED_GROUPS, n_rows // (shards * NUMBERED_ROWS))
    rows = rows.withColumn("place", row_key).withColumn("part", F.pmod("place", F.lit(groups)))
    large = rows.groupBy("shard", "part").count().where(F.col("count") > 4 * NUMBERED_ROWS)
    large = cut(large.select("shard", "part", F.ceil(F.col("count") / NUMBERED_ROWS).alias("parts")), "parts")
    rows = rows.join(carried(large, 24), ["shard", "part"], "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("salt"), "parts"), F.lit(0)))
    keys = ["shard", "part", "sub"]
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("place", "size", "crc", "salt")) - 1
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return rows.withColumn("own", own).join(offsets, keys).withColumn("slot", (F.col("own") + F.col("ahead")).cast("long"))


def kd_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, size, text_crc32, shard, slot), one for each row of docs; the shards' bytes are near equal.

    size: UTF-8 bytes plus 1. A shard is a leaf of the tree, a box of metadata, with the large groups of equal texts dealt to
    it. Equal texts share a shard unless their group is larger than WHOLE_GROUP of a shard, which is then split by row, so
    that a group of copies that holds a third of all rows does not unbalance the shards.

    Null texts count as empty; null ids are passed on; repeated rows share a shard, unless they alone unbalance it, and have
    slots of their own; an empty table gives no rows; other columns are ignored. Reruns give the same shards.
    """
    meta = cut(measured(docs, F.col(id_col), text_col), "metadata")
    key = F.xxhash64("payload", "crc")
    placed = fit(meta, shards, key).assigned(meta, key)
    done = numbered(placed, shards, meta.count(), key)
    return done.select(F.col("payload").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def sharded_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows of docs with a last column `shard` (which replaces one of that name); texts are not shuffled."""
    key = F.xxhash64("key", "crc")
    meta = cut(measured(docs, F.col(id_col), text_col).withColumnRenamed("payload", "key"), "metadata")
    rows = measured(docs, F.struct(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key")), text_col).select("payload.row", "payload.key", "size", "crc", "grp", "dims", "salt")
    done = fit(meta, shards, key).assigned(rows, key)
    return done.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "shard"), "shard")
