"""Keyed look-ups, completeness checks and run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted but not known."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def by_key(rows: DataFrame, wanted: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """rows of the wanted keys; with strict a missing key is an error."""
    if strict and (lost := missing_keys(wanted, rows, key).limit(5).collect()):
        raise KeyError(f"missing {key}: {', '.join(str(r[0]) for r in lost)}")
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def epoch_metrics(batches: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, loss, acc, n) of batches (loss, correct, n): means weighted by the rows of a batch."""
    n = F.sum("n")
    return batches.groupBy(*by).agg((F.sum(F.col("loss") * F.col("n")) / n).alias("loss"), (F.sum("correct") / n).alias("acc"), n.alias("n"))
