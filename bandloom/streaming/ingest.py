"""Structured Streaming ingestion: new image tables are packed into a chunk store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bandloom.operators.store import ChunkSpec, write_chunk_store, write_packed_store

IMAGE_SCHEMA = "image_id long, label int, height int, width int, pixels array<float>"


def ingest_images(spark: SparkSession, source: str, store: str, checkpoint: str, spec: ChunkSpec | None = None, records_per_shard: int = 1024, files_per_batch: int = 64) -> StreamingQuery:
    """Starts a query that adds the images of new Parquet files in `source` to the store, and stops when none are left.

    A batch that runs again after a failure adds only images that the store does not list, and chunks that the failed run has
    left are never read, so each image is stored once.
    """
    images = spark.readStream.schema(IMAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    spec = spec or ChunkSpec()

    def add(batch: DataFrame, batch_id: int) -> None:
        try:
            spark.read.parquet(f"{store}/images").limit(1).count()
            known = True
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = False
        write_chunk_store(batch.dropDuplicates(["image_id"]), store, spec, records_per_shard, resume=known)

    return images.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_packed(images: DataFrame, store: str, checkpoint: str, spec: ChunkSpec | None = None, records_per_shard: int = 1024) -> StreamingQuery:
    """Starts a query that adds a stream of images (image_id, label, height, width, pixels, source_key, source_url) to a packed
    store, and stops when none are left. A batch becomes shards of its own, listed with its number and the stream's checkpoint; one
    that runs again finds itself listed and adds nothing, so each image is stored once and nothing is looked up by image."""
    spec = spec or ChunkSpec()

    def add(batch: DataFrame, batch_id: int) -> None:
        write_packed_store(batch, store, spec, records_per_shard, contiguous=False, batch=f"{checkpoint}:{batch_id}", own_shards=True)

    return images.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
