"""Run histories from JSON, whatever their age, and reports of trials and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SERIES = ("epoch", "test_acc", "train_loss", "io_ratio", "approx_ratio")
_PART = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in _SERIES])


def read_runs(spark: SparkSession, path: str, parts: tuple[str, ...] = ("adaptive", "baseline")) -> DataFrame:
    """Rows (run, epoch, acc, train_loss, io_ratio) of result files in folders named by their run.

    Series may lie in one of the parts, the first that has them, or at the top; files without an I/O ratio may have an approximate one, and files
    without either read everything.
    """
    schema = T.StructType([*(T.StructField(p, _PART) for p in parts), *_PART.fields])
    files = spark.read.option("multiLine", "true").schema(schema).json(path).withColumn("_folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1))

    def series(name: str):
        return F.coalesce(*(F.col(f"{part}.{name}") for part in parts), F.col(name))

    acc = series("test_acc")
    ratio = F.coalesce(series("io_ratio"), series("approx_ratio"), F.array_repeat(F.lit(1.0), F.size(acc)))
    loss = F.coalesce(series("train_loss"), F.array_repeat(F.lit(None).cast("double"), F.size(acc)))
    zipped = F.arrays_zip(acc.alias("acc"), loss.alias("train_loss"), ratio.alias("io_ratio"))
    rows = files.where(acc.isNotNull()).select(F.col("_folder").alias("run"), F.posexplode(zipped).alias("epoch", "p"))
    return rows.select("run", "epoch", "p.acc", "p.train_loss", "p.io_ratio")


def write_trials(trials: list[dict], spark: SparkSession, path: str) -> None:
    """Trials as JSON and as CSV."""
    rows = spark.createDataFrame(trials).coalesce(1)
    rows.write.mode("overwrite").json(f"{path}/json")
    rows.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def write_trial_rows(trials: DataFrame, path: str) -> None:
    """Trials, one for each row, as JSON and as CSV, written by the tasks that have them."""
    trials.write.mode("overwrite").json(f"{path}/json")
    trials.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def in_order(summary: DataFrame, wanted: list[str], run: str = "run") -> DataFrame:
    """The runs of a list, with their `place` in it; those without a history are left out, and others too."""
    names = summary.sparkSession.createDataFrame([(n, k) for k, n in enumerate(dict.fromkeys(wanted))], f"{run} string, place int")
    return summary.withColumn(run, F.col(run).cast("string")).join(F.broadcast(names), run)


def markdown_lines(summary: DataFrame, title: str = "run") -> DataFrame:
    """Rows (place, line) of a table of run_summary() as Markdown: a head of two lines, then a line for each run by name."""
    line = F.format_string("| %s | %.2f | %.2f | %.3f | %.1f %% |", F.col(title).cast("string"), "best", "final", "avg_io", "avg_saved")
    body = summary.select((F.row_number().over(Window.orderBy(title)) + 1).alias("place"), line.alias("line"))  # a row for each run
    head = summary.sparkSession.createDataFrame([(0, f"| {title} | best | final | I/O | saved |"), (1, "|---|---|---|---|---|")], "place int, line string")
    return head.unionAll(body)


def markdown(summary: DataFrame, title: str = "run") -> list[str]:
    """Lines of a table of run_summary(); a run is one line."""
    line = F.format_string("| %s | %.2f | %.2f | %.3f | %.1f %% |", F.col(title).cast("string"), "best", "final", "avg_io", "avg_saved")
    head = [f"| {title} | best | final | I/O | saved |", "|---|---|---|---|---|"]
    return head + [r[0] for r in summary.orderBy(title).select(line).collect()]
