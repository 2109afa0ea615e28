"""Continuous ingestion: a file stream of records, upserted batch by batch into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.plans.schemas import RECORD
from quillgraph.sources.store import Store, index


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Records from JSON files as they arrive."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).json(folder)


def start(stream: DataFrame, store: Store, checkpoint: str, as_of: str | None = None, once: bool = False) -> StreamingQuery:
    """Upserts each batch: late records (edited before what is held) are dropped by the upsert itself,
    so a batch that runs again after a failure changes nothing. as_of: by default the batch's latest edit."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        now = as_of or str(df.agg(F.coalesce(F.max("last_edited_time"), F.lit("1970-01-01").cast("timestamp")).cast("string")).first()[0])
        index(store, df, now)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def windowed_counts(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes in each window of time, with a watermark for late ones; the same on a stream and on a table."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
