"""Fidelity allocation: how many bands each patch of an image gets under a budget of (patch, band) slots."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.operators.crops import uniform

#: Scores are compared at this many decimals, so that ties do not hang on the last bit of a sum.
DECIMALS = 12
#: How a slot's worth comes from the patch's signal, the patch's sensitivity and the band's sensitivity.
SCORES = {
    "energy": lambda signal, patch, band: signal * signal * band * band,
    "sensitivity": lambda signal, patch, band: patch * signal * band * band,
    "linear": lambda signal, patch, band: signal * patch * band,
    "static": lambda signal, patch, band: patch * band * band,
}


@dataclass(frozen=True)
class Fidelity:
    """What a pass over the data may read. ratio: of all slots of the visible patches; or budget: slots of an image. quota, or q_ratio
    of the visible patches: how many a binary policy raises from k_low to k_high bands, whatever the budget.

    policy: greedy (slots by SCORES[score]), gradient (whole patches by signal * sensitivity), static (by sensitivity) or
    random (by a hash of seed, image and patch).
    """

    bands: int
    k_low: int = 1
    k_high: int | None = None
    ratio: float | None = None
    budget: int | None = None
    quota: int | None = None
    q_ratio: float | None = None
    policy: str = "greedy"
    score: str = "energy"
    strict: bool = False
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.k_low <= self.bands:
            raise ValueError(f"k_low {self.k_low} of {self.bands} bands")
        if self.policy not in ("greedy", "gradient", "static", "random") or self.score not in SCORES:
            raise ValueError(f"unknown policy {self.policy!r} or score {self.score!r}")

    @property
    def top(self) -> int:
        return self.bands if self.k_high is None else min(self.k_high, self.bands)

    def slots(self, patches: Column) -> Column:
        """The budget of an image with so many patches, between k_low and all bands for each."""
        wanted = F.lit(self.budget) if self.budget is not None else F.bround(F.lit(1.0 if self.ratio is None else self.ratio) * patches * self.bands)
        return F.greatest(patches * self.k_low, F.least(patches * self.bands, wanted)).cast("int")

    def patch_quota(self, patches: Column) -> Column:
        """Patches that a binary policy raises to the high fidelity."""
        if self.quota is not None:
            return F.least(patches, F.lit(self.quota))
        if self.q_ratio is not None:
            return F.bround(F.lit(self.q_ratio) * patches).cast("int")
        extra = F.greatest(self.slots(patches) - patches * self.k_low, F.lit(0))
        return F.greatest(F.lit(0), F.least(patches, F.bround(extra / max(self.top - self.k_low, 1)))).cast("int")

    def of_grid(self, patches: int) -> Fidelity:
        """The same with the quota that its ratio gives a binary policy in a grid of so many patches: an image of which fewer are
        there keeps that quota, and may then exceed its own budget."""
        slots = max(patches * self.k_low, min(patches * self.bands, round((1.0 if self.ratio is None else self.ratio) * patches * self.bands)))
        return replace(self, quota=min(patches, round((slots - patches * self.k_low) / max(self.top - self.k_low, 1))))


def allocate(signal: DataFrame, fidelity: Fidelity, band_weights: DataFrame | None = None, patch_weights: DataFrame | None = None) -> DataFrame:
    """Rows (image_id, patch, k) from rows (image_id, patch, signal) of the visible patches.

    band_weights (band_id, weight) and patch_weights (patch, weight, and bucket_id if signal has it and buckets have weights of
    their own) default to ones; both are dimension tables. Ties go to
    the smaller patch, then the smaller band. A patch's k counts its slots, so it reads the prefix of k bands.
    """
    keys = ["patch"] if patch_weights is None else [c for c in ("bucket_id", "patch") if c in patch_weights.columns]
    rows = signal.select("image_id", "signal", *keys)
    rows = rows.join(F.broadcast(patch_weights.withColumnRenamed("weight", "pw")), keys) if patch_weights is not None else rows.withColumn("pw", F.lit(1.0))
    image = Window.partitionBy("image_id")
    rows = rows.withColumn("patches", F.count("*").over(image).cast("int"))
    if fidelity.policy == "greedy":
        return _greedy(rows, fidelity, band_weights)
    if fidelity.policy == "random":
        worth = uniform(F.lit(fidelity.seed), F.col("image_id"), F.col("patch"))
    else:
        worth = F.round(F.col("pw") * (F.col("signal") if fidelity.policy == "gradient" else F.lit(1.0)), DECIMALS)
    rank = F.row_number().over(image.orderBy(worth.desc(), "patch"))
    high = rank <= fidelity.patch_quota(F.col("patches"))
    return rows.select("image_id", "patch", F.when(high, fidelity.top).otherwise(fidelity.k_low).alias("k"))


def _greedy(rows: DataFrame, fidelity: Fidelity, band_weights: DataFrame | None) -> DataFrame:
    spark = rows.sparkSession
    weights = band_weights if band_weights is not None else spark.createDataFrame([(b, 1.0) for b in range(fidelity.bands)], "band_id int, weight double")
    weights = weights.where(F.col("band_id") >= fidelity.k_low).select("band_id", F.col("weight").alias("bw"))
    extra = fidelity.slots(F.col("patches")) - F.col("patches") * fidelity.k_low
    rows = rows.withColumn("extra", extra)
    slots = rows.crossJoin(F.broadcast(weights))  # each patch times the bands above the floor
    slots = slots.withColumn("worth", F.round(SCORES[fidelity.score](F.col("signal"), F.col("pw"), F.col("bw")), DECIMALS))
    order = Window.partitionBy("image_id").orderBy(F.desc("worth"), "patch", "band_id")
    slots = slots.withColumn("place", F.row_number().over(order))
    granted = F.col("place") <= F.col("extra")
    if fidelity.strict:  # only what is above the worth of the last slot in the budget
        count = (F.col("patches") * (fidelity.bands - fidelity.k_low)).cast("int")
        slots = slots.withColumn("last", F.max(F.when(F.col("place") == F.least("extra", count), F.col("worth"))).over(Window.partitionBy("image_id")))
        granted = F.col("worth") > F.col("last")
    k = F.least(F.lit(fidelity.bands), fidelity.k_low + F.coalesce(F.count_if(granted), F.lit(0))).cast("int")
    if fidelity.k_low >= fidelity.bands:
        return rows.select("image_id", "patch", F.lit(fidelity.bands).alias("k"))
    return slots.groupBy("image_id", "patch").agg(k.alias("k"))


def prefix_for_ratio(bands: int, ratio: float) -> int:
    """Uniform fidelity: the bands that a ratio buys, one at least."""
    return min(max(-int(-ratio * bands // 1), 1), bands)


def prefix_column(ratio: Column, bands: int) -> Column:
    """prefix_for_ratio() by row."""
    return F.least(F.greatest(F.ceil(F.round(ratio * bands, DECIMALS)), F.lit(1)), F.lit(bands)).cast("int")


def kq_ratio(k: Column | float, q: Column | float, bands: int, patches: int):
    """The served share of a low-pass base of k bands with q full patches."""
    f = k / bands
    return f + (1.0 - f) * (q / patches)


def match_lowpass(targets: DataFrame, bands: int) -> DataFrame:
    """Rows (target, k, ratio): the low-pass whose ratio is nearest to the target; the smaller k of equals."""
    spark = targets.sparkSession
    grid = spark.range(1, bands + 1).select(F.col("id").cast("int").alias("k")).withColumn("ratio", F.col("k") / float(bands))
    near = targets.crossJoin(F.broadcast(grid)).withColumn("off", F.round(F.abs(F.col("ratio") - F.col("target")), DECIMALS))
    return near.groupBy("target").agg(F.min_by(F.struct("k", "ratio"), F.struct("off", "k")).alias("m")).select("target", "m.k", "m.ratio")


def match_kq(targets: DataFrame, bands: int, patches: int) -> DataFrame:
    """Rows (target, k, q, ratio): the nearest pair; the smaller k, then the smaller q of equals."""
    spark = targets.sparkSession
    k = spark.range(1, bands + 1).select(F.col("id").cast("int").alias("k"))
    grid = k.crossJoin(spark.range(1, patches + 1).select(F.col("id").cast("int").alias("q"))).withColumn("ratio", kq_ratio(F.col("k"), F.col("q"), bands, patches))
    near = targets.crossJoin(F.broadcast(grid)).withColumn("off", F.round(F.abs(F.col("ratio") - F.col("target")), DECIMALS))
    return near.groupBy("target").agg(F.min_by(F.struct("k", "q", "ratio"), F.struct("off", "k", "q")).alias("m")).select("target", "m.k", "m.q", "m.ratio")
