"""Scale calibration, quantisation reports, DC prediction and the search for a precision that meets a quality gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions.transforms import quantise, wrap16
from bandloom.operators.metrics import global_ssim, quality
from bandloom.operators.metrics import percentile as exact_percentile

LIMITS = {"int8": 127, "int16": 32767}


def calibrate(values: DataFrame, by: list[str], stat: str = "max", percentile: float = 99.99, limit: int = 127, multiplier: float = 1.0) -> DataFrame:
    """Rows (by, scale) of values (by, value): the step that takes the largest, or a percentile, of all |value| to the limit."""
    if stat == "max":
        tops = values.groupBy(*by).agg(F.max(F.abs("value")).alias("percentile"))
    else:
        tops = exact_percentile(values, by, F.abs("value"), percentile / 100.0)
    return tops.select(*by, (F.greatest(F.col("percentile") / limit, F.lit(1e-12)) * multiplier).alias("scale"))


def quantised(values: DataFrame, scales: DataFrame, by: list[str], limit: int = 127) -> DataFrame:
    """values with q, restored, and whether q was clipped or is zero."""
    rows = values.join(F.broadcast(scales), by)  # a row for each band or channel
    q = quantise(F.col("value"), F.col("scale"), limit)
    raw = F.rint(F.col("value") / F.col("scale"))
    return rows.withColumn("q", q).withColumn("restored", F.col("q") * F.col("scale")).withColumn("clipped", (raw > limit) | (raw < -limit - 1)).withColumn("zero", F.col("q") == 0)


def dpcm(blocks: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """blocks with delta: the difference to the block before within `by`, wrapped to 16 bits; the first keeps its value."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(*by).orderBy(order))
    return blocks.withColumn("delta", wrap16(F.col(value) - before))


def undpcm(blocks: DataFrame, by: list[str], order: str, delta: str = "delta") -> DataFrame:
    """blocks with restored: running sums of the deltas within `by`, wrapped to 16 bits."""
    upto = F.sum(delta).over(Window.partitionBy(*by).orderBy(order))
    return blocks.withColumn("restored", wrap16(upto))


@dataclass(frozen=True)
class Gate:
    psnr: float = 45.0
    ssim: float = 0.995
    mae: float | None = None
    max_abs: float | None = None

    def passes(self, row: dict) -> bool:
        return row["psnr"] >= self.psnr and row["ssim"] >= self.ssim and (self.mae is None or row["mae"] <= self.mae) and (self.max_abs is None or row["max_abs"] <= self.max_abs)


def trial(values: DataFrame, by: list[str], limit: int, multiplier: float) -> dict:
    """Quality after quantising with scales of max * multiplier. values: (by, value); errors of an orthonormal transform's
    coefficients are the pixels' errors in sum of squares, so PSNR is read off the coefficients."""
    rows = quantised(values, calibrate(values, by, limit=limit, multiplier=multiplier), by, limit)
    q = quality(rows, [], "value", "restored").crossJoin(global_ssim(rows, [], "value", "restored"))
    shares = rows.agg(F.avg(F.col("clipped").cast("int")).alias("clip_fraction"), F.avg(F.col("zero").cast("int")).alias("zero_fraction"))
    return {"limit": limit, "multiplier": multiplier, **q.crossJoin(shares).first().asDict()}


def search_precision(values: DataFrame, by: list[str], gate: Gate, order: tuple[str, ...] = ("int8", "int16"), most: float = 256.0, steps: int = 18) -> list[dict]:
    """Trials in the order they ran; the last is the coarsest that passes, if any does. values should be cached: every trial
    is one aggregate over it. A type whose finest step fails is left for the next type."""
    trials: list[dict] = []

    def passes(kind: str, multiplier: float) -> bool:
        row = trial(values, by, LIMITS[kind], multiplier)
        trials.append({"dtype": kind, **row, "passed": gate.passes(row)})
        return trials[-1]["passed"]

    for kind in order:
        if passes(kind, most):
            return trials
        if not passes(kind, 1.0):
            continue
        lo, hi, best = 1.0, most, trials[-1]
        for _ in range(steps):
            middle = (lo * hi) ** 0.5
            if passes(kind, middle):
                lo, best = middle, trials[-1]
            else:
                hi = middle
        return [*trials, best]
    return trials
