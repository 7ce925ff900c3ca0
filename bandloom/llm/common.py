"""Helpers that the corpus operators share."""

from __future__ import annotations

import math
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.functions.batches import bounded_batches
from bandloom.sources.folders import shared_folder

__all__ = ["bounded_batches"]

#: Characters that the word rules call white space: \x20 and \x09-\x0D. bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of a table that may be sent to every task; larger ones are shuffled.
CARRIED_BYTES = 32 << 20
#: Where cut() has written what it returned.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: what follows survives lost executors and is not computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bandloom/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more: what was made from them has been written or collected."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_folders.pop(table))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def renamed(field: T.StructField, name: str) -> T.StructField:
    return T.StructField(name, field.dataType, True)


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the UTF-8 bytes of the text, so that other columns, whatever their names, never meet ours."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))


def carried(table: DataFrame, row_bytes: int) -> DataFrame:
    """table with a broadcast hint if its rows, counted, are few enough."""
    return F.broadcast(table) if table.count() * row_bytes <= CARRIED_BYTES else table
