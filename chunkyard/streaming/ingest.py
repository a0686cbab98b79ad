"""Pages that keep arriving: each micro-batch is chunked and upserted, so a collection follows its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chunkyard import schemas
from chunkyard.operators import chunking
from chunkyard.sources import collections


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Pages (source, page, text) from Parquet files as they appear in a folder."""
    return spark.readStream.schema(schemas.PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def follow(pages: DataFrame, root: str, name: str, checkpoint: str, strategy: str = "base") -> StreamingQuery:
    """Starts the stream. Chunk ids depend on content, so a batch that runs again after a failure changes nothing.

    A source must arrive whole within one batch: chunks are numbered within it.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        collections.write(chunking.split(batch, strategy), root, name, replace=False)

    return pages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
