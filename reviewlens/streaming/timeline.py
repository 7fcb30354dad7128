"""Structured Streaming variants of the time operators.

The reference reads whole files; every stateless operator here is ``DataFrame →
DataFrame`` and so also runs on a streaming frame. The stateful one is the daily
sentiment timeline: a tumbling one-day window per label with a watermark, so state for a
day is dropped once the watermark passes it and late rows within the delay still count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.temporal import parse_dates_col


def streaming_sentiment_timeline(stream: DataFrame, date_col: str, label_col: str = "sentiment",
                                 delay: str = "2 days", fmt: str | None = None) -> DataFrame:
    """Count per (day window, label) over a streaming frame; append mode emits a day once
    the watermark has passed it."""
    ts = parse_dates_col(F.col(date_col).cast("string"), fmt)
    return (stream.withColumn("_ts", ts).where(F.col("_ts").isNotNull())
            .withWatermark("_ts", delay)
            .groupBy(F.window("_ts", "1 day").alias("w"), F.col(label_col).alias("sentiment"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.to_date(F.col("w.start")).alias("day"), "sentiment", "count"))


def run_to_memory(query_df: DataFrame, name: str, output_mode: str = "append",
                  checkpoint: str | None = None):
    """Start ``query_df`` into the in-memory sink, drain everything available, stop."""
    w = query_df.writeStream.format("memory").queryName(name).outputMode(output_mode)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.processAllAvailable()
    q.stop()
    return query_df.sparkSession.table(name)
