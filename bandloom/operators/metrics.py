"""Quality, entropy and I/O accounting, all as aggregates: what a retried task counts twice never shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psnr(mse: Column, cap: float = 120.0) -> Column:
    """Decibels for a peak of 1; `cap` without error."""
    return F.when(mse <= 0, F.lit(cap)).otherwise(F.least(F.lit(cap), -10.0 * F.log10(F.when(mse > 0, mse))))


def quality(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Rows (by, mse, mae, max_abs, psnr) of value pairs."""
    d = F.col(a) - F.col(b)
    out = pairs.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_abs"))
    return out.withColumn("psnr", psnr(F.col("mse")))


def global_ssim(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", c1: float = 1e-4, c2: float = 9e-4) -> DataFrame:
    """Rows (by, ssim): structural similarity over the whole group, population moments."""
    m = pairs.groupBy(*by).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab"))
    top = (2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cab") + c2)
    return m.select(*by, (top / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2))).alias("ssim"))


def entropy(symbols: DataFrame, by: list[str], value: str = "value", total: bool = True) -> DataFrame:
    """Rows (by, symbols, bits, bytes, zero_share): bits of a symbol, the lower bound in bytes, and the share of zeros.

    Counts come first, so only distinct symbols meet. With total, a row with null keys holds all groups together.
    """
    counts = symbols.groupBy(*by, value).agg(F.count("*").alias("n"))
    if total:
        whole = counts.groupBy(value).agg(F.sum("n").alias("n"))
        counts = counts.unionByName(whole.select(*(F.lit(None).cast(counts.schema[c].dataType).alias(c) for c in by), value, "n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    parts = counts.withColumn("bits", -share * F.log2(share))
    out = parts.groupBy(*by).agg(F.sum("n").alias("symbols"), F.sum("bits").alias("bits"), F.sum(F.when(F.col(value) == 0, F.col("n")).otherwise(0)).alias("zeros"))
    return out.select(*by, "symbols", "bits", (F.col("bits") * F.col("symbols") / 8).alias("bytes"), (F.col("zeros") / F.col("symbols")).alias("zero_share"))


def _bin(v: Column, bins: int) -> Column:
    """A number that never falls as v rises: `bins` bins for each power of two, on either side of zero; NaN comes last."""
    size = F.floor(F.log2(F.abs(v)) * bins) + 1100 * bins
    finite = F.when(v > 0, size).when(v < 0, -size).otherwise(0)
    return F.when(F.isnan(v) | (v == float("inf")), 1 << 40).when(v == float("-inf"), -(1 << 40)).otherwise(finite)


def percentile(values: DataFrame, by: list[str], value: Column, share: float, bins: int = 1 << 11) -> DataFrame:
    """Rows (by, percentile): exact, linear between the two nearest ranks. by: keys of few groups, such as bands or replicas.

    Two passes without a shuffle of values: counts by fixed bins tell in which bins the two ranks lie, and only the values of
    these are then ranked, each once with its count. So no task holds a group's values, but for those of one bin.
    """
    told = values.select(*by, value.cast("double").alias("v")).where("v is not null").withColumn("bin", _bin(F.col("v"), bins))
    counts = told.groupBy(*by, "bin").agg(F.count("*").alias("c"))
    whole, at = Window.partitionBy(*by), share * (F.col("n") - 1)
    counts = counts.withColumns({"n": F.sum("c").over(whole), "upto": F.sum("c").over(whole.orderBy("bin"))})
    counts = counts.withColumns({"low": F.floor(at), "high": F.ceil(at), "before": F.col("upto") - F.col("c")})
    hit = counts.where((F.col("before") <= F.col("high")) & (F.col("upto") > F.col("low")))
    inside = told.join(F.broadcast(hit.select(*by, "bin", "before", "n", "low", "high")), [*by, "bin"])  # two bins of each group
    ranked = inside.groupBy(*by, "bin", "before", "n", "low", "high", "v").count()
    end = F.col("before") + F.sum("count").over(Window.partitionBy(*by, "bin").orderBy("v"))
    ranked = ranked.withColumn("end", end)
    pick = lambda rank: F.max(F.when((F.col("end") > F.col(rank)) & (F.col("end") - F.col("count") <= F.col(rank)), F.col("v"))).alias(f"v_{rank}")
    found = ranked.groupBy(*by, "n", "low", "high").agg(pick("low"), pick("high"))
    return found.select(*by, F.when(F.col("low") == F.col("high"), F.col("v_low")).otherwise((F.col("high") - at) * F.col("v_low") + (at - F.col("low")) * F.col("v_high")).alias("percentile"))


def io_report(reads: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, reads, bytes_read, full_bytes, io_ratio, avg_bytes, p95_bytes) of reads (bytes, full).

    Reads are counted by their size first, so one pass and one shuffle of sizes give sums and ranks; a group has as many rows then
    as there are sizes of a read.
    """
    sizes = reads.groupBy(*by, "bytes").agg(F.count("*").alias("_n"), F.sum("full").alias("_full"))
    known, group = F.when(F.col("bytes").isNotNull(), F.col("_n")).otherwise(0), Window.partitionBy(*by)
    at = 0.95 * (F.sum(known).over(group) - 1)
    sizes = sizes.withColumns({"_upto": F.sum(known).over(group.orderBy("bytes")), "_known": known, "_at": at})
    pick = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_known") <= rank), F.col("bytes")))
    out = sizes.groupBy(*by).agg(
        F.sum("_n").alias("reads"),
        F.sum(F.col("bytes") * F.col("_n")).alias("bytes_read"),
        F.sum("_full").alias("full_bytes"),
        (F.sum(F.col("bytes") * F.col("_n")) / F.nullif(F.sum("_known"), F.lit(0))).alias("avg_bytes"),
        pick(F.floor("_at")).cast("double").alias("_low"),
        pick(F.ceil("_at")).cast("double").alias("_high"),
        F.max("_at").alias("_at"),
    )
    p95 = F.col("_low") + (F.col("_at") - F.floor("_at")) * (F.col("_high") - F.col("_low"))
    out = out.withColumn("p95_bytes", p95).drop("_low", "_high", "_at")
    return out.withColumn("io_ratio", F.col("bytes_read") / F.nullif(F.col("full_bytes"), F.lit(0)))


def run_summary(history: DataFrame) -> DataFrame:
    """Rows (run, best, final, avg_io, avg_saved) of epochs (run, epoch, acc, io_ratio)."""
    out = history.groupBy("run").agg(F.max("acc").alias("best"), F.max_by("acc", "epoch").alias("final"), F.avg("io_ratio").alias("avg_io"))
    return out.withColumn("avg_saved", (1 - F.col("avg_io")) * 100)


def mismatches(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    """One row (matched, only_a, only_b, labels_differ, shapes_differ) of two tables (key, label, height, width)."""
    one = lambda df, n: df.select(F.col(key), F.struct("label", "height", "width").alias(n))
    both = one(a, "a").join(one(b, "b"), key, "full")
    matched = F.col("a").isNotNull() & F.col("b").isNotNull()
    shape = (F.col("a.height") != F.col("b.height")) | (F.col("a.width") != F.col("b.width"))
    return both.agg(F.count_if(matched).alias("matched"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(matched & (F.col("a.label") != F.col("b.label"))).alias("labels_differ"), F.count_if(matched & shape).alias("shapes_differ"))
