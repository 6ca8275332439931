"""Incremental ingestion: new block files are folded into the store as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_blocks(spark: SparkSession, landing: str, schema: str, late: str = "30 days") -> DataFrame:
    """Blocks as they land; a redelivered block is let through once while it is within the watermark."""
    rows = spark.readStream.schema(schema).parquet(landing)
    return rows.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["document_id", "block_id"])


def page_counts(blocks: DataFrame, window: str = "1 day") -> DataFrame:
    """Blocks and documents per window of arrival; late rows count until the watermark has passed."""
    return blocks.groupBy(F.window("ingested_at", window)).agg(F.count("*").alias("blocks"), F.approx_count_distinct("document_id").alias("documents")).select(F.col("window.start").alias("start"), "blocks", "documents")


def write_blocks(blocks: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each batch to the store exactly once per batch number."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = blocks.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
