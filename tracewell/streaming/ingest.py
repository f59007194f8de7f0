"""X5, an extension: documents arrive as a stream and each distinct text is kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text


def first_seen(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """stream(ts, url, text) with fingerprints, without what repeats one seen within the watermark; state is bounded by it."""
    return stream.withWatermark("ts", delay).withColumn("fingerprint", text.content_fingerprint(F.col("text"))).dropDuplicatesWithinWatermark(["fingerprint"])


def windowed_counts(stream: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Arrivals per window and kind of stream(ts, kind)."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))
