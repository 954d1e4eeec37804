"""The daily diff on a stream of discovered documents (an addition: batch runs do the same from day to day)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tracker

DISCOVERED = "url string, title string, region string, year string, month string, publication_date string, date_source string, source_page string, seq long"


def follow(spark: SparkSession, folder: str, repo: tracker.Repository, checkpoint: str, on_new: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Reads JSON files of documents as they arrive; each batch is compared with the inventory and then goes into it.

    The inventory is the memory, so new means new forever and no watermark is needed. A batch that is run again finds its documents known
    and changes nothing but their last sighting.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        docs = tracker.archive_documents(df, ["seq"]).persist()
        try:
            new = tracker.unknown(docs, repo.documents())
            if on_new:
                on_new(new, batch_id)
            repo.upsert(docs, batch_id, datetime.now(UTC), ["seq"])
        finally:
            docs.unpersist()

    stream = spark.readStream.schema(DISCOVERED).json(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by type in tumbling windows of event time, late rows dropped after a while; for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
