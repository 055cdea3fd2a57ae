"""Sessions of events, for batches and streams alike (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, value): events of a user with less than ``gap`` between them.

    On a stream a session is final when the watermark, ``late`` behind the newest event, has passed its end.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    found = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
