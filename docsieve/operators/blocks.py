"""Recognised words put together: blocks, layout, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsieve.functions.text import strip


def assemble(words: DataFrame, *image: str) -> DataFrame:
    """(image columns, block, text, confidence, words) from words with ``seq, block_num, text, conf``.

    Words with a confidence over 0 count; a block ends where the number of the block changes.
    """
    order = W.partitionBy(*image).orderBy("seq")
    valid = words.where((strip(F.col("text")) != "") & (F.col("conf") > 0))
    new = F.coalesce((F.col("block_num") != F.lag("block_num").over(order)).cast("long"), F.lit(0))
    run = valid.withColumn("__new", new).withColumn("block", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return run.groupBy(*image, "block").agg(said.alias("text"), F.avg("conf").alias("confidence"), F.count(F.lit(1)).alias("words"))


def summary(blocks: DataFrame, *image: str) -> DataFrame:
    """Words, lines and the mean confidence of an image's blocks."""
    return blocks.groupBy(*image).agg(F.sum("words").cast("long").alias("word_count"), F.count(F.lit(1)).alias("line_count"), F.avg("confidence").alias("average_confidence"))


def sure_confidence(words: DataFrame, *image: str, least: float = 60) -> DataFrame:
    """Mean confidence of the words over ``least``."""
    return words.where(F.col("conf") > least).groupBy(*image).agg(F.avg("conf").alias("confidence"))


def layout(words: DataFrame, *image: str) -> DataFrame:
    """(image columns, block, part, text) from words with ``seq, text, top, height``: a word whose top lies further from the
    last one's than it is high begins a block. A block is a title if it is one word and the next word is over 30 high, a
    header if that is over 20 high, otherwise body; so is the last block."""
    order = W.partitionBy(*image).orderBy("seq")
    said = words.where(strip(F.col("text")) != "")
    new = F.coalesce((F.abs(F.col("top") - F.lag("top").over(order)) > F.col("height")).cast("long"), F.lit(0))
    run = said.withColumn("__new", new).withColumn("block", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    grouped = run.groupBy(*image, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.count(F.lit(1)).alias("__n"),
        F.min_by("height", "seq").alias("__first"),
    )
    after = F.lead("__first").over(W.partitionBy(*image).orderBy("block"))
    part = F.when((F.col("__n") == 1) & (after > 30), "title").when(after > 20, "headers").otherwise("body")
    return grouped.select(*image, "block", part.alias("part"), "text")


def neighbours(rows: DataFrame, group: str, seq: str, text: str) -> DataFrame:
    """Each row with the texts of all others of its group, in order; a group is what one image holds."""
    whole = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(text).alias("text")))).alias("__all"))
    others = F.transform(F.filter("__all", lambda x: x["seq"] != F.col(seq)), lambda x: x["text"])
    return rows.join(whole, group).withColumn("neighbours", others).drop("__all")


def best_candidate(rows: DataFrame, *region: str) -> DataFrame:
    """The reading of each region to use: command-line readings first, then the highest confidence, then the first."""
    rank = F.struct(F.col("is_cli").cast("int").alias("a"), F.col("conf").alias("b"), (-F.col("seq")).alias("c"))
    return rows.groupBy(*region).agg(F.max_by(F.struct("text", "conf", "is_cli"), rank).alias("best")).select(*region, "best.*")


def word_lines(words: DataFrame, *image: str) -> DataFrame:
    """(image columns, text): a line ``[left, top] word`` for each recognised word, in order."""
    line = F.format_string("[%d, %d] %s", F.col("left"), F.col("top"), F.col("text"))
    said = words.where((strip(F.col("text")) != "") & (F.col("conf") > 0)).select(*image, F.struct("seq", line.alias("line")).alias("__l"))
    return said.groupBy(*image).agg(F.array_join(F.transform(F.array_sort(F.collect_list("__l")), lambda x: x["line"]), "\n").alias("text"))
