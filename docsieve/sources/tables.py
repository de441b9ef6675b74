"""Reading tables for work that costs far more per byte than reading does."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, bytes_a_core: int = 16 << 20) -> DataFrame:
    """Deals a small input to all cores; a large one has splits enough and isn't shuffled.

    An input under ``bytes_a_core`` for each core comes as a few file splits, often a single row group, and scanning its
    text by patterns would keep one core busy. Its size is the optimizer's estimate for the files that are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_a_core and not df.isStreaming else df
