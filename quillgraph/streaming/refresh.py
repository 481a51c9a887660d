"""Incremental refresh (an extension): what changed since the last run, in batch and as a stream of new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changes(now: DataFrame, before: DataFrame, key: str, content: str) -> DataFrame:
    """key, change (added, changed, removed): by a checksum of the content. Two columns of either side shuffle, no content."""
    new, old = (df.select(key, F.xxhash64(content).alias(f"sum_{n}"), F.lit(True).alias(f"in_{n}")) for df, n in ((now, "new"), (before, "old")))
    both = new.join(old, key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("sum_new") != F.col("sum_old"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def refresh(spark: SparkSession, incoming: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a stateless step to files that have come since the last run, once each, append the result to `out`, and stop."""
    rows = spark.readStream.schema(schema).parquet(incoming)
    return step(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and value; with a stream, state older than the watermark is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("span"), by).agg(F.count("*").alias("n")).select(F.col("span.start").alias("start"), by, "n")
