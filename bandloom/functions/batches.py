"""Arrow batches bounded by bytes: rows of an image, or of a record of many blocks, are large, and ten thousand of them are a batch otherwise."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch at most, so that a batch of very long texts stays small.
ARROW_BATCH_BYTES = 8 << 20
#: The same for images, blocks and records, of which Python makes objects of several times their size.
IMAGE_BATCH_BYTES = 2 << 20
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes where the session has not been told otherwise."""
    if int(spark.conf.get(_BYTES_PER_BATCH, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(_BYTES_PER_BATCH, str(most))
