"""Schedules: parametric budget ramps, isotonic fits of pilot cut-offs, and linear continuations of sensitivities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epochs(spark: SparkSession, total: int) -> DataFrame:
    return spark.range(total).select(F.col("id").cast("int").alias("epoch"))


def ramp(epoch: Column, total: Column | int, start: Column | float, end: Column | float, gamma: Column | float) -> Column:
    """start + (end - start) * (epoch / last) ** gamma; later epochs stay at the end. All may differ by row."""
    last = F.greatest(_column(total) - 1, F.lit(1))
    return _column(start) + (_column(end) - _column(start)) * F.pow(F.least(epoch, last) / last.cast("double"), _column(gamma).cast("double"))


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def slots(ratio: Column, full: Column | int, least: Column | int) -> Column:
    """Whole slots of a share, half to even, at least `least`."""
    return F.greatest(_column(least), F.least(F.bround(_column(full) * ratio), _column(full))).cast("long")


def run_schedules(runs: DataFrame, beyond: int = 0, k_low: int = 1) -> DataFrame:
    """Rows (run, epoch, budget, io_ratio, lr) of runs (run, total, warmup, start, end, gamma, patches, bands, base_lr) for all their
    epochs and `beyond` more, in which the last budget holds: what get_fidelity() says of each run at each epoch."""
    at = runs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("total") - 1 + beyond)))
    held = F.least("epoch", F.col("total") - 1)
    full = F.col("patches") * F.col("bands")
    budget = slots(ramp(held, F.col("total"), F.col("start"), F.col("end"), F.col("gamma")), full, F.col("patches") * k_low)
    lr = cosine(F.col("epoch"), F.col("total"), F.col("base_lr"), F.col("warmup"))
    return at.select("run", F.col("epoch").cast("int").alias("epoch"), budget.alias("budget"), (budget / full).alias("io_ratio"), lr.alias("lr"))


def cosine(epoch: Column, total: Column | int, base: Column | float, warmup: Column | int, least: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine down to `least`, which later epochs keep."""
    progress = F.least(F.lit(1.0), (epoch - _column(warmup)) / F.greatest(_column(total) - _column(warmup), F.lit(1)).cast("double"))
    down = least + (_column(base) - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(epoch < _column(warmup), _column(base) * (epoch + 1) / F.greatest(_column(warmup), F.lit(1)).cast("double")).otherwise(down)


def budget_schedule(spark: SparkSession, total: int, patches: int, bands: int, start: float, end: float = 1.0, gamma: float = 1.0, k_low: int = 1) -> DataFrame:
    """Rows (epoch, budget, io_ratio): whole slots, half to even, never below k_low bands for each patch."""
    full = patches * bands
    slots = F.bround(full * ramp(F.col("epoch"), total, start, end, gamma))
    budget = F.greatest(F.lit(patches * k_low), F.least(slots, F.lit(full))).cast("long")
    return epochs(spark, total).select("epoch", budget.alias("budget"), (budget / float(full)).alias("io_ratio"))


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The least-squares non-decreasing fit, by pooling adjacent violators: each value is pushed and merged once, so it is linear."""
    means, held, sizes = [], [], []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        n = 1
        while means and means[-1] >= v:
            v = (means[-1] * held[-1] + v * w) / (held[-1] + w)
            w, n = w + held.pop(), n + sizes.pop()
            means.pop()
        means.append(v)
        held.append(w)
        sizes.append(n)
    return np.repeat(means, sizes)


def isotonic_fits(points: DataFrame, by: list[str], x: str, value: str) -> DataFrame:
    """Rows (by, x, fitted): the non-decreasing least-squares fit of each group's series, all groups in one shuffle. Points of one
    x are pooled before it, so a task gets a row for each x of its groups; a series is as long as a schedule has epochs. Null
    points are left out."""
    keys = [F.col(c) for c in by]
    each = points.where(F.col(value).isNotNull() & F.col(x).isNotNull()).groupBy(*keys, F.col(x)).agg(F.avg(F.col(value).cast("double")).alias("_v"), F.count("*").alias("_n"))

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(x)
        return series[[*by, x]].assign(fitted=pooled(series["_v"].to_numpy(), series["_n"].to_numpy(dtype=float)))

    schema = T.StructType([*(points.schema[c] for c in [*by, x]), T.StructField("fitted", T.DoubleType())])
    return each.groupBy(*keys).applyInPandas(fit, schema)


def isotonic(pilot: DataFrame, value: str) -> DataFrame:
    """Rows (epoch, fitted): the least-squares non-decreasing fit of one pilot."""
    return isotonic_fits(pilot.select(F.lit(0).alias("series"), "epoch", value), ["series"], "epoch", value).drop("series")


def pilot_schedules(pilots: DataFrame, by: list[str], total: int, most: Column) -> DataFrame:
    """Rows (by, epoch, value) for `total` epochs of each series of pilots (by, epoch, value): the isotonic fit, then its mean
    slope, clipped to 1..most, never falling, whole. most may differ by series."""
    fitted = isotonic_fits(pilots, by, "epoch", "value")
    ends = fitted.groupBy(*by).agg(F.count("*").alias("n"), F.min_by("fitted", "epoch").alias("first"), F.max_by("fitted", "epoch").alias("last"), F.map_from_entries(F.collect_list(F.struct("epoch", "fitted"))).alias("seen"))
    at = ends.select("*", most.cast("double").alias("most"), F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("epoch"))
    slope = (F.col("last") - F.col("first")) / F.greatest(F.col("n") - 1, F.lit(1))
    going = F.coalesce(F.try_element_at("seen", F.col("epoch")), F.col("last") + slope * (F.col("epoch") - F.col("n") + 1))
    risen = F.max(F.greatest(F.lit(1.0), F.least("most", going))).over(Window.partitionBy(*by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    return at.select(*by, "epoch", F.bround(F.round(risen, 9)).cast("int").alias("value"))


def pilot_schedule(pilot: DataFrame, value: str, total: int, most: int) -> DataFrame:
    """Rows (epoch, value) for all epochs of one pilot, see pilot_schedules()."""
    one = pilot.select(F.lit(0).alias("series"), F.col("epoch").cast("int").alias("epoch"), F.col(value).alias("value"))
    return pilot_schedules(one, ["series"], total, F.lit(most)).select("epoch", F.col("value").alias(value))


def continue_sensitivity(history: DataFrame, total: int, floor: float = 1e-8) -> DataFrame:
    """Rows (epoch, idx, value): measured pilot epochs, then each dimension's least-squares line; clipped and normalised."""
    spark = history.sparkSession
    lines = history.groupBy("idx").agg(F.coalesce(F.regr_slope("value", F.col("epoch").cast("double")), F.lit(0.0)).alias("slope"), F.coalesce(F.regr_intercept("value", F.col("epoch").cast("double")), F.avg("value")).alias("base"))
    grid = epochs(spark, total).crossJoin(F.broadcast(lines)).join(history.withColumnRenamed("value", "seen"), ["epoch", "idx"], "left")
    value = F.greatest(F.coalesce("seen", F.col("base") + F.col("slope") * F.col("epoch")), F.lit(floor))
    return grid.select("epoch", "idx", (value / F.sum(value).over(Window.partitionBy("epoch"))).alias("value"))


def warmup_cosine(spark: SparkSession, total: int, base: float, warmup: int, least: float = 0.0) -> DataFrame:
    """Rows (epoch, lr): linear warm-up, then half a cosine down to `least`."""
    e = F.col("epoch")
    progress = (e - warmup) / float(max(total - warmup, 1))
    down = least + (base - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return epochs(spark, total).select("epoch", F.when(e < warmup, base * (e + 1) / float(max(warmup, 1))).otherwise(down).alias("lr"))


def at_epoch(schedule: DataFrame, epoch: Column, last: int) -> Column:
    """The epoch whose entry holds at `epoch`: schedules go on with their last one."""
    return F.least(epoch, F.lit(last))


def held_at(schedule: DataFrame, asked: DataFrame) -> DataFrame:
    """The entry of a schedule (epoch, ...) that holds at each asked epoch: beyond its end, the last one."""
    last = schedule.agg(F.max("epoch").alias("last"))
    rows = asked.crossJoin(F.broadcast(last)).withColumn("held", F.least("epoch", "last"))
    return rows.join(schedule.withColumnRenamed("epoch", "held"), "held").drop("held", "last")


def summary(schedule: DataFrame, value: str) -> DataFrame:
    """One row (epochs, first, last, least, most, mean) of a schedule."""
    v = F.col(value)
    return schedule.agg(F.count("*").alias("epochs"), F.min_by(v, "epoch").alias("first"), F.max_by(v, "epoch").alias("last"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 9).alias("mean"))
