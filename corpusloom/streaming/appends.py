"""Record files that arrive one after another, ingested idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def ingest_stream(spark: SparkSession, source: str, schema, base_path: str, checkpoint: str, key: str = "record_id", digest: str = "content_hash", fmt: str = "parquet") -> StreamingQuery:
    """Every new file of the folder once; a batch that is run again inserts nothing."""

    def one(batch: DataFrame, _: int) -> None:
        ingest.ingest(base_path, batch, key, digest)

    stream = spark.readStream.format(fmt).schema(schema).load(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(stream: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and key; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
