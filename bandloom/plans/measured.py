"""Named queries of schedules, baselines, folders and reports whose parameters come from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions import dims
from bandloom.functions import transforms as tf
from bandloom.operators import allocate as al
from bandloom.operators import blocks as bl
from bandloom.operators import crops as cr
from bandloom.operators import metrics, schedule
from bandloom.plans.catalog import query, scratch
from bandloom.plans.stores import _samples
from bandloom.plans.substrate import BANDS, PATCHES, coefficients, r, shapes, table
from bandloom.sources import archives, folders, reports


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of user groups: length, warm-up, ramp and learning rate follow from their events."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 9).cast("int").alias("run")).agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))
    return e.select("run", (5 + F.col("n") % 30).cast("int").alias("total"), (F.col("n") % 4).cast("int").alias("warmup"), (0.3 + F.col("s") % 10 / 100.0).alias("start"), (0.7 + F.col("s") % 7 / 25.0).alias("end"), (1 + F.col("n") % 3 / 2.0).alias("gamma"), (4 + F.col("s") % 50).cast("int").alias("patches"), F.lit(16).alias("bands"), (0.1 + F.col("n") % 5 / 10.0).alias("base_lr"))


@query
def run_budgets(spark, sf_dir):
    """Budgets and learning rates of runs at all their epochs and five more."""
    out = schedule.run_schedules(_runs(spark, sf_dir), beyond=5)
    return out.select("run", "epoch", "budget", r("io_ratio", 9).alias("io_ratio"), r("lr", 9).alias("lr"))


@query
def run_budget_summary(spark, sf_dir):
    """First, last and mean share of each run's budget."""
    out = schedule.run_schedules(_runs(spark, sf_dir))
    return out.groupBy("run").agg(F.min_by("budget", "epoch").alias("first"), F.max_by("budget", "epoch").alias("last"), r(F.avg("io_ratio"), 9).alias("avg_io"))


@query
def nested_mask_energy(spark, sf_dir):
    """Energy of each image that five nested masks of its blocks keep."""
    masks = dims.nested_masks(spark, 8, 8, 5).where("kept").join(dims.zigzag_table(spark).selectExpr("pos", "row as u", "col as v"), ["u", "v"]).select("level", "pos")
    z = coefficients(spark, sf_dir).select("image_id", F.posexplode("z").alias("pos", "value"))
    e = z.groupBy("image_id", "pos").agg(F.sum(F.col("value") ** 2).alias("e"))
    return e.join(F.broadcast(masks), "pos").groupBy("image_id", "level").agg(r(F.sum("e")).alias("energy"))


@query
def uniform_fidelity(spark, sf_dir):
    """The band prefix that each block's ratio buys, and what serving it loses."""
    z = coefficients(spark, sf_dir).withColumn("ratio", F.col("label") / 9.0)
    z = z.withColumn("k", al.prefix_column(F.col("ratio"), BANDS.count))
    lost = F.aggregate(F.transform("z", lambda v, i: F.when(i >= F.col("k") * 4, v * v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return z.groupBy("label", "k").agg(F.count("*").alias("blocks"), r(F.sum(lost)).alias("sq_error"))


@query
def matched_fidelity(spark, sf_dir):
    """The low-pass and the (k, q) pair nearest to the share that each of 24 groups of events gives."""
    e = table(spark, sf_dir, "events").where("value is not null").groupBy((F.col("event_id") % 24).cast("int").alias("part")).agg(F.round(F.avg(F.abs("value") / (1 + F.abs("value"))), 6).alias("target"))
    targets = e.select("target").distinct()
    low, pair = al.match_lowpass(targets, BANDS.count), al.match_kq(targets, BANDS.count, PATCHES)
    both = low.select("target", F.col("k").alias("low_k"), r("ratio", 9).alias("low_ratio")).join(pair.select("target", "k", "q", r("ratio", 9).alias("ratio")), "target")
    return e.join(both, "target").select("part", "target", "low_k", "low_ratio", "k", "q", "ratio")


@query
def refoldered(spark, sf_dir):
    """Documents as images of one folder, put into folders of their classes by an annotation file and read as labelled classes."""
    path, d = scratch(spark), _samples(spark, sf_dir)
    name = F.concat(F.lit("v"), F.col("id"), F.lit(".jpg"))
    archives.write_files(d.select(name.alias("path"), "content"), f"{path}/flat").count()
    d.select(F.concat_ws("\t", name, F.concat(F.lit("n0"), F.col("label")), F.lit("0"))).write.text(f"{path}/val")
    archives.refolder(spark, f"{path}/flat/*.jpg", f"{path}/val", f"{path}/classes").count()
    rows = archives.read_image_folder(spark, f"{path}/classes")
    return rows.select(F.regexp_extract("path", r"v(\d+)\.jpg$", 1).cast("long").alias("id"), "class_name", "label", F.sha2("content", 256).alias("sha"))


@query
def artefact_sizes(spark, sf_dir):
    """Files and bytes of each folder of artefacts, and what a hundred thousand such folders would take."""
    path, d = scratch(spark), _samples(spark, sf_dir)
    folder = F.concat(F.lit("c"), F.coalesce(F.col("label").cast("string"), F.lit("none")))  # a null text has no label
    name = F.concat_ws("-", "id", F.monotonically_increasing_id())  # a file for each row, also of a repeated id
    archives.write_files(d.select(F.concat_ws("/", folder, F.concat(name, F.lit(".bin"))).alias("path"), "content"), path).count()
    each = folders.sizes(spark, path).select(F.regexp_extract("folder", r"c(\d+|none)$", 1).try_cast("int").alias("folder"), "files", "bytes")
    whole = folders.forecast(each, 100_000).select("n", r("mean_bytes", 3).alias("mean_bytes"), r("std_bytes", 3).alias("std_bytes"), r("forecast_bytes", 1).alias("forecast_bytes"))
    return each.crossJoin(F.broadcast(whole))


@query
def record_shards(spark, sf_dir):
    """All vectors as files of labelled records and as pairs of IDX files, a hundred in a file, written and read by tasks."""
    path = scratch(spark)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("place"), F.format_string("r%05d", F.floor(F.col("vec_id") / 100)).alias("file"), "label", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) / 2 * 255).cast("int")).alias("q"))
    hexed = F.array_join(F.transform("q", lambda x: F.lpad(F.hex(x), 2, "0")), "")
    label = F.lpad(F.hex("label"), 2, "0")
    archives.write_records(v.select("file", "place", F.unhex(F.concat(F.lit("07"), label, hexed)).alias("record")), f"{path}/labelled").count()
    rows = archives.read_labelled_records(spark, f"{path}/labelled", 2, 1, 8)
    return rows.select(F.regexp_extract("path", r"r(\d+)$", 1).cast("int").alias("file"), "position", "label", r(tf.array_sum(F.col("pixels"))).alias("total"))


@query
def braced_archives(spark, sf_dir):
    """Samples of the archives that two patterns with ranges name."""
    path = scratch(spark)
    archives.write_archives(_samples(spark, sf_dir), path, 20)
    rows = archives.read_archives(spark, [f"{path}/part-{{000000..000003}}.tar", f"{path}/part-00000{{6..7}}.tar"])
    return rows.groupBy(F.regexp_extract("shard", r"part-(\d+)", 1).cast("int").alias("shard")).agg(F.count("*").alias("samples"), F.sum(F.octet_length("content")).alias("bytes"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").groupBy((F.col("user_id") % 9).cast("string").alias("run"), (F.col("event_id") % 6).cast("int").alias("epoch"))
    return e.agg(F.round(F.avg(F.abs("value")), 6).alias("acc"), (0.25 + F.count("*") % 64 / 128.0).alias("io_ratio"))


@query
def summary_lines(spark, sf_dir):
    """The summary of all runs as lines of Markdown."""
    return reports.markdown_lines(metrics.run_summary(_history(spark, sf_dir)))


@query
def wanted_runs(spark, sf_dir):
    """The runs of a list in its order; one of them has no history."""
    rows = reports.in_order(metrics.run_summary(_history(spark, sf_dir)), ["7", "none", "2", "5", "2"])
    return rows.select("place", "run", r("best").alias("best"), r("avg_io", 9).alias("avg_io"))


@query
def trial_rows(spark, sf_dir):
    """Trials of all labels and bands written by tasks as JSON and CSV, and read back from both."""
    path = scratch(spark)
    z = coefficients(spark, sf_dir).select("label", F.posexplode("z").alias("pos", "v"))
    trials = z.groupBy("label", BANDS.of(F.col("pos")).cast("int").alias("band_id")).agg(r(F.sum(F.col("v") ** 2)).alias("energy"), F.count("*").alias("n"))
    reports.write_trial_rows(trials, path)
    schema = "label int, band_id int, energy double, n long"
    a, b = spark.read.schema(schema).json(f"{path}/json"), spark.read.schema(schema).option("header", "true").csv(f"{path}/csv")
    return a.withColumn("kind", F.lit("json")).unionByName(b.withColumn("kind", F.lit("csv")))


@query
def bucket_guard(spark, sf_dir):
    """Batches of images by bucket pass the guard; batches across buckets are refused."""
    placed = cr.exact_buckets(shapes(spark, sf_dir).where("image_id is not null"), 32)
    batch = (F.col("bucket_id") * 100_000 + F.floor(F.col("bucket_pos") / 4)).cast("int").alias("batch_no")
    good = cr.one_bucket(placed.select("image_id", batch), placed)
    try:
        cr.one_bucket(placed.select("image_id", F.floor(F.col("image_id") / 400).alias("batch_no")), placed).agg(F.sum("bucket_id")).collect()
    except Exception as e:  # noqa: BLE001
        if "one bucket" not in str(e):
            raise
    else:
        raise AssertionError("a batch across buckets has passed")
    return good.groupBy("batch_no", "bucket_id").agg(F.count("*").alias("images"))


@query
def source_mismatches(spark, sf_dir):
    """Documents as their table lists them, and as their texts and labels are: which of them agree in label and shape."""
    d, marks = table(spark, sf_dir, "documents").where("doc_id is not null"), table(spark, sf_dir, "labels")
    a = d.select(F.col("doc_id").alias("image_id"), F.lit(1).alias("label"), F.col("n_chars").cast("int").alias("height"), F.length("source").alias("width"))
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    b = d.join(marks, "doc_id").select(F.col("doc_id").alias("image_id"), F.col("quality").cast("int").alias("label"), F.length(F.coalesce("text", F.lit(""))).alias("height"), F.when(words > 40, F.length("source")).otherwise(F.length("lang")).alias("width"))
    return metrics.mismatches(a, b)
