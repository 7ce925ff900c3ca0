"""Small dimension tables: DCT basis, zig-zag order, bands, quantisation tables and tiles. Each is a DataFrame made by
expressions over spark.range(); its size depends on the block, never on the data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The luminance and chrominance quantisation tables of the JPEG standard (annex K), row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


@lru_cache
def basis(n: int) -> np.ndarray:
    """The orthonormal DCT-II matrix: row k, column i."""
    k, i = np.mgrid[:n, :n]
    c = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    c[0] *= np.sqrt(0.5)
    return c


def basis_table(spark: SparkSession, n: int = 8) -> DataFrame:
    """Rows (k, i, value)."""
    cell = spark.range(n * n).select((F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).cast("int").alias("i"))
    wave = F.cos(F.lit(np.pi) * F.col("k") * (2 * F.col("i") + 1) / (2.0 * n)) * F.sqrt(F.lit(2.0 / n))
    return cell.withColumn("value", wave * F.when(F.col("k") == 0, F.sqrt(F.lit(0.5))).otherwise(1.0))


@lru_cache
def zigzag(h: int, w: int) -> tuple[int, ...]:
    """Natural positions in zig-zag order: by anti-diagonal, upwards on even ones and downwards on odd ones."""
    cells = sorted((r + c, -r if (r + c) % 2 == 0 else r, r * w + c) for r in range(h) for c in range(w))
    return tuple(p for _, _, p in cells)


def zigzag_table(spark: SparkSession, h: int = 8, w: int = 8) -> DataFrame:
    """Rows (pos, row, col, natural)."""
    cell = spark.range(h * w).select((F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col"), F.col("id").cast("int").alias("natural"))
    diagonal = F.col("row") + F.col("col")
    order = Window.orderBy(diagonal, F.when(diagonal % 2 == 0, -F.col("row")).otherwise(F.col("row")))
    return cell.select((F.row_number().over(order) - 1).alias("pos"), "row", "col", "natural")


@dataclass(frozen=True)
class Bands:
    """Bands as half-open ranges of zig-zag positions; every position lies in exactly one."""

    edges: tuple[tuple[int, int], ...]

    @classmethod
    def even(cls, size: int, count: int) -> Bands:
        """`count` bands of equal width; the last takes the remainder."""
        if not 0 < count <= size:
            raise ValueError(f"{count} bands of {size} positions")
        width = size // count
        return cls(tuple((b * width, (b + 1) * width if b + 1 < count else size) for b in range(count)))

    @property
    def count(self) -> int:
        return len(self.edges)

    def of(self, pos: Column) -> Column:
        """The band of a position."""
        out = F.lit(0)
        for b, (start, _) in enumerate(self.edges[1:], 1):
            out = F.when(pos >= start, b).otherwise(out)
        return out

    def width(self, first: int) -> int:
        """Positions of the first `first` bands."""
        return self.edges[first - 1][1] if first > 0 else 0

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(b, lo, hi) for b, (lo, hi) in enumerate(self.edges)], "band_id int, b0 int, b1 int")


#: DC, and low, middle and high frequencies.
CROP_BANDS = Bands(((0, 1), (1, 6), (6, 21), (21, 64)))


@lru_cache
def quality_tables(quality: int) -> np.ndarray:
    """(3, 64) quantisers of the JPEG quality scale, natural order; chrominance twice."""
    q = min(max(int(quality), 1), 100)
    scale = 5000 / q if q < 50 else 200 - 2 * q
    base = np.array([LUMINANCE, CHROMINANCE, CHROMINANCE], dtype=np.float64)
    return np.clip(np.floor((base * scale + 50) / 100), 1, 255).astype(np.int64)


def quality_table(spark: SparkSession, quality: int = 95) -> DataFrame:
    """Rows (channel, natural, pos, q)."""
    place = {p: i for i, p in enumerate(zigzag(8, 8))}
    rows = [(c, p, place[p], int(q)) for c, table in enumerate(quality_tables(quality)) for p, q in enumerate(table)]
    return spark.createDataFrame(rows, "channel int, natural int, pos int, q int")


def tile_specs(grids: DataFrame, tile_blocks: int = 4) -> DataFrame:
    """Tiles of block grids (nph, npw): rows (nph, npw, tile_id, r0, c0, th, tw, block_ids), row-major."""
    t = F.lit(tile_blocks)
    rows, cols = F.ceil(F.col("nph") / t).cast("int"), F.ceil(F.col("npw") / t).cast("int")
    tiles = grids.select("nph", "npw", cols.alias("cols"), F.explode(F.sequence(F.lit(0), rows * cols - 1)).alias("tile_id"))
    r0, c0 = (F.floor(F.col("tile_id") / F.col("cols")) * t).cast("int"), ((F.col("tile_id") % F.col("cols")) * t).cast("int")
    tiles = tiles.select("nph", "npw", "tile_id", r0.alias("r0"), c0.alias("c0"))
    tiles = tiles.withColumn("th", F.least(t, F.col("nph") - F.col("r0"))).withColumn("tw", F.least(t, F.col("npw") - F.col("c0")))
    at = F.sequence(F.lit(0), F.col("th") * F.col("tw") - 1)
    ids = F.transform(at, lambda i: ((F.col("r0") + F.floor(i / F.col("tw"))) * F.col("npw") + F.col("c0") + i % F.col("tw")).cast("int"))
    return tiles.withColumn("block_ids", ids)


def nested_masks(spark: SparkSession, h: int, w: int, levels: int) -> DataFrame:
    """Rows (level, u, v, kept): masks of h x w coefficients, each within the next; the last one keeps all."""
    bands, order = Bands.even(h * w, levels), zigzag(h, w)
    place = {int(i): p for p, i in enumerate(order)}
    band = lambda p: next(b for b, (lo, hi) in enumerate(bands.edges) if lo <= p < hi)
    rows = [(level, i // w, i % w, band(place[i]) <= level) for level in range(levels) for i in range(h * w)]
    return spark.createDataFrame(rows, "level int, u int, v int, kept boolean")
