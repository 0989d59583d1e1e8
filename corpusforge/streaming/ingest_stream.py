"""Structured Streaming around the batch operators: ingest by micro-batch, redaction, windowed latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusforge.functions.text import content_hash
from corpusforge.operators import chunking, ingest, pii


def redacted(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stream with log-safe texts; stateless."""
    return stream.withColumn(text, pii.log_redact(F.col(text)))


def latency_windows(events: DataFrame, time: str = "ts", value: str = "value", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Count and maximum by event type and window; rows later than the watermark are dropped."""
    timely = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type")
    return timely.agg(F.count("*").alias("n"), F.max(value).alias("most")).select("w.start", "w.end", "event_type", "n", "most")


def ingest_pages(pages: DataFrame, index: str, checkpoint: str, size: int = 200, overlap: int = 40, version: str = "fetched_at") -> StreamingQuery:
    """Chunks every micro-batch of (page_id, text) and replaces these pages' partitions.

    A batch that runs again writes the same partitions again, so each page is in the index once.  Of
    several versions of a page in a batch the one with the greatest ``version`` counts; of equal
    ones, or where there is no such column, the one with the greatest hash, so that a rerun agrees."""

    def put(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("page_id").agg(F.max_by("text", F.struct(*([version] if version in batch.columns else []), content_hash(F.col("text")))).alias("text"))
        ingest.write_index(chunking.chunk_documents(latest, size, overlap), index)

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
