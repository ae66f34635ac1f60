"""Transformations that take a batch or a stream of events alike, and how a stream of them is run.

A stream is watermarked before windows, so late data and state are bounded; its checkpoint is what a claim or lease is
in a polling worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_time(events: DataFrame, late: str | None = None) -> DataFrame:
    """Event time as a timestamp in UTC; with a watermark if late is given."""
    df = events.withColumn("at", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))
    return df if late is None else df.withWatermark("at", late)


def tumbling(events: DataFrame, length: str, step: str | None = None) -> DataFrame:
    """(event_type, start in microseconds, n, total) for windows, sliding if there is a step."""
    w = F.window("at", length, step) if step else F.window("at", length)
    df = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return df.select("event_type", F.unix_micros("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """A user's events with less than gap between neighbours."""
    df = events.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return df.select("user_id", F.unix_micros("w.start").alias("start"), "n")


def feedback(events: DataFrame) -> DataFrame:
    """Per record: how often it was retrieved and useful, and its precision from five retrievals on."""
    df = events.select(F.explode("result_ids").alias("id"), "useful").groupBy("id").agg(F.count("*").alias("retrieved"), F.count_if("useful").alias("useful"))
    return df.withColumn("precision", F.when(F.col("retrieved") >= 5, F.col("useful") / F.col("retrieved")))


def tool_counts(events: DataFrame, least: int) -> DataFrame:
    return events.groupBy("session", "tool").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def embed_backlog(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Vectors for chunks that arrive without one: every micro-batch is embedded by the hook and appended once."""

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own output.
        embed(batch.where("embedding is null")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_all(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Read what is there, into a table in memory of that name; for tests and small results."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
