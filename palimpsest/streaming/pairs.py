"""Pairs that arrive over time: an extension beside the batch comparison.

Each micro-batch of pairs goes through the batch plan as it is; late repeats of a page are dropped within a watermark, and
counts of events are kept by window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PAIRS = "pair_id bigint, doc_a bigint, doc_b bigint, arrived timestamp"


def pair_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """Pairs from Parquet files that are added to a folder."""
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def once_each(pairs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each pair once, though it may be announced again within the delay."""
    return pairs.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["pair_id"])


def compare_stream(pairs: DataFrame, compare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Run a batch comparison over each micro-batch and append its diffs under batch_id; a batch that runs again replaces its own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        compare(batch.drop("arrived")).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out)

    w = pairs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def event_counts(events: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and mean values of events(ts, event_type, value) by window; works on streams and tables."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "mean")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of users: runs of events without a longer gap."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    s = F.session_window("ts", gap)
    out = rows.groupBy("user_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
