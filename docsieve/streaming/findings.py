"""Detection on streams: the same stateless expressions, counted by windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.catalogs import PERSONAL
from docsieve.operators import pii


def finding_counts(stream: DataFrame, text_col: str, time_col: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window_start, window_end, pii_type, n): findings of a stream, or of a table, by type and tumbling window."""
    rows = F.array(*[F.struct(F.lit(p.name).alias("pii_type"), F.col(p.name).alias("n")) for p in PERSONAL])
    # a watermark takes time-zoned times only
    watched = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late) if stream.isStreaming else stream
    flat = pii.with_counts(watched, text_col, time_col).select(time_col, F.inline(rows)).where(F.col("n") > 0)
    return flat.groupBy(F.window(time_col, window).alias("w"), "pii_type").agg(F.sum("n").cast("long").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "pii_type", "n")


def redacted(stream: DataFrame, text_col: str, mode: str = "replace") -> DataFrame:
    """The stream with its text redacted; stateless, so it runs in any output mode."""
    return stream.withColumn(text_col, pii.redact(F.col(text_col), mode))
