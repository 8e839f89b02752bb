"""Gap segmentation of a stream: an entry ends when nothing follows within the gap, late rows up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_entries(events: DataFrame, gap: str = "1 hour", late: str = "2 hours", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, opened, closed, n of each entry; the same on a batch. State is one window for each open entry.

    ``closed`` is the last row's time plus the gap. Rows exactly a gap apart are in one entry, as in the batch operator: a session
    window, which would part them, is a microsecond longer, the least that times differ by.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(F.session_window(ts, f"{gap} 1 microsecond").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("opened"), (F.col("w.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("closed"), "n")


def matching_lines(documents: DataFrame, pattern: str) -> DataFrame:
    """Lines of a stream of documents that hold a pattern; stateless, so append mode needs no watermark."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "ln")).where(F.contains("ln", F.lit(pattern))).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "ln")
