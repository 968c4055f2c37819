"""Structured Streaming around the batch plans.  No computation crosses receipts, so a stream of
snapshots needs no state: each micro-batch is the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.plans import receipts


def process_stream(boxes: DataFrame, sink: Callable[[dict[str, DataFrame], int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run the receipt plan on every micro-batch of a stream of boxes.  All boxes of a receipt belong into one
    batch (one file): those that come later make a receipt of their own. ``sink`` gets its relations and the
    batch number, which makes rewriting a batch after a failure safe."""

    def each(batch: DataFrame, number: int) -> None:
        made = receipts.process(batch)
        try:
            sink(made, number)
        finally:
            for name in ("words", "lines", "placed", "pages"):
                made[name].unpersist()

    return boxes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling window, with late rows up to the watermark."""
    seen = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return seen.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files arriving in a folder, as a stream with event time as a timestamp."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
