"""Aggregates over per-file results. All take the flat results schema of ``RESULTS``; absent values have their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RESULTS = (
    "file_name string, file_type string, file_description string, processing_timestamp string, success boolean, error string, text_length long, processing_time double, "
    "risk_level string, pii_count long, pii_types map<string,bigint>, total_findings long, confidence_score double, categories_found array<string>, key_findings array<string>, recommendations array<string>, "
    "categories array<struct<category:string,confidence:double,finding_count:bigint>>"
)
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def complete(results: DataFrame) -> DataFrame:
    """``results`` with nulls for the columns of RESULTS that its workflow didn't make."""
    schema = results.sparkSession.createDataFrame([], RESULTS).schema
    return results.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in results.columns})


def defaults(results: DataFrame) -> DataFrame:
    """Fills what a result lacks: success, unknown type, LOW risk, zero counts, empty lists."""
    empty = {"categories_found": "array<string>", "key_findings": "array<string>", "recommendations": "array<string>", "pii_types": "map<string,bigint>"}
    fill = {"success": F.lit(True), "file_type": F.lit("unknown"), "risk_level": F.lit("LOW"), "pii_count": F.lit(0), "total_findings": F.lit(0), "confidence_score": F.lit(0.0), "text_length": F.lit(0)}
    columns = {n: F.coalesce(F.col(n), v) for n, v in fill.items() if n in results.columns}
    columns |= {n: F.coalesce(F.col(n), (F.create_map() if "map" in t else F.array()).cast(t)) for n, t in empty.items() if n in results.columns}
    return results.withColumns(columns)


def overview(results: DataFrame) -> DataFrame:
    """One row, also for no results: totals, successes, errors, risk and security figures."""
    r = defaults(results)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return r.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("success").alias("successful_processing"),
        F.count_if(~F.col("success")).alias("files_with_errors"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("high_risk_files"),
        total("pii_count").alias("total_pii_items"),
        F.count_if(F.col("total_findings") > 0).alias("files_with_security_content"),
        total("total_findings").alias("total_findings"),
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"),
    )


def by_file_type(results: DataFrame) -> DataFrame:
    return defaults(results).groupBy("file_type").agg(F.count(F.lit(1)).alias("files"))


def risk_histogram(results: DataFrame) -> DataFrame:
    """Files by level of risk, with zeros for levels without files."""
    counted = defaults(results).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    levels = results.sparkSession.createDataFrame([(x,) for x in LEVELS], "risk_level string")
    return levels.join(counted, "risk_level", "full").select("risk_level", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def by_category(results: DataFrame) -> DataFrame:
    """Files in which a topic was found."""
    return defaults(results).select(F.explode("categories_found").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("files"))


def category_details(results: DataFrame) -> DataFrame:
    """For each topic: analysed files, mean confidence, findings."""
    flat = results.select(F.inline("categories"))
    return flat.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.avg("confidence").alias("avg_confidence"), F.sum("finding_count").cast("long").alias("total_findings"))


def pii_type_totals(results: DataFrame) -> DataFrame:
    return defaults(results).select(F.explode("pii_types").alias("pii_type", "n")).groupBy("pii_type").agg(F.sum("n").cast("long").alias("total"))


def distinct_values(results: DataFrame) -> DataFrame:
    """(kind, value): distinct key findings, topics, types of personal data, and key findings of files whose confidence is
    over 0.7. A row each, so that no group of them has to fit one task."""
    r = defaults(results)
    of = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), F.col("value"))
    high = r.where(F.col("confidence_score") > 0.7)
    rows = of("key_findings", r.select(F.explode("key_findings").alias("value")))
    rows = rows.union(of("security_categories", r.select(F.explode("categories_found").alias("value"))))
    rows = rows.union(of("pii_types", r.select(F.explode(F.map_keys("pii_types")).alias("value"))))
    return rows.union(of("high_confidence_findings", high.select(F.explode("key_findings").alias("value")))).distinct()


def recommendations(results: DataFrame, most: int = 15) -> DataFrame:
    """The first ``most`` distinct recommendations in alphabetical order."""
    return defaults(results).select(F.explode("recommendations").alias("recommendation")).distinct().orderBy("recommendation").limit(most)


def size_buckets(results: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("text_length"), F.lit(0))
    return results.agg(F.count_if(n < 1000).alias("small_files"), F.count_if((n >= 1000) & (n < 10000)).alias("medium_files"), F.count_if(n >= 10000).alias("large_files"))


def processing_times(results: DataFrame) -> DataFrame:
    t = F.col("processing_time")
    return results.agg(*[F.coalesce(f(t), F.lit(0.0)).alias(n) for n, f in (("total_time", F.sum), ("average_time", F.avg), ("min_time", F.min), ("max_time", F.max))])


def csv_rows(results: DataFrame) -> DataFrame:
    """The flat report: eleven columns, five key findings joined by bars, topics by commas."""
    text = lambda n: F.coalesce(F.col(n), F.lit("")).alias(n)
    r = results
    return r.select(
        text("file_name"),
        text("file_type"),
        text("file_description"),
        text("processing_timestamp"),
        F.coalesce("text_length", F.lit(0)).alias("text_length"),
        F.coalesce("risk_level", F.lit("")).alias("pii_risk_level"),
        F.coalesce("pii_count", F.lit(0)).alias("pii_items_found"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("security_confidence"),
        F.coalesce("total_findings", F.lit(0)).alias("total_security_findings"),
        F.array_join(F.slice(F.coalesce("key_findings", F.array().cast("array<string>")), 1, 5), " | ").alias("key_findings"),
        F.array_join(F.coalesce("categories_found", F.array().cast("array<string>")), ", ").alias("security_categories"),
    )


def pages(results: DataFrame, rows: int = 8, order: str = "file_name") -> DataFrame:
    """Table pages of a presentation: page and row numbers, cells cut to 100 characters, three key findings.

    Numbers come from per-range counts, so that the order needs no single task.
    """
    cell = lambda c: F.substring(c, 1, 100)
    listed = F.array_join(F.slice(F.coalesce("key_findings", F.array().cast("array<string>")), 1, 3), "; ")
    numbered = numbered_rows(results, order)
    return numbered.select(
        (F.floor((F.col("__row") - 1) / rows) + 1).cast("long").alias("page"),
        (F.pmod(F.col("__row") - 1, F.lit(rows)) + 1).cast("long").alias("row"),
        cell(F.coalesce("file_name", F.lit("Unknown"))).alias("file_name"),
        cell(F.coalesce("file_type", F.lit("Unknown"))).alias("file_type"),
        cell(F.coalesce("file_description", F.lit("No description"))).alias("description"),
        cell(F.when(listed == "", F.lit("None")).otherwise(listed)).alias("key_findings"),
    )


def numbered_rows(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``__row``, the place of each row in the order (from 1), counted in two steps: places within ranges of
    the order, and how many rows the ranges before hold. The ranges come from a sample, so both steps must see one dealing
    of the rows: it is persisted, and parts that are lost are computed again by the same ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__range", before.alias("__before")))  # a row a range
    within = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__in", within).join(offsets, "__range").withColumn("__row", F.col("__in") + F.col("__before")).drop("__in", "__before", "__range")


def bullets(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Display lines of a table of counts."""
    return counts.select(F.format_string("• %s: %d", F.col(key), F.col(value)).alias("line"))


def sheet_profile(df: DataFrame) -> DataFrame:
    """(column_name, column_type, position, total_rows, null_count, potentially_sensitive) from one aggregation."""
    from docsieve.functions.catalogs import SENSITIVE_NAMES

    kinds = dict(df.dtypes)
    counted = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"__{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(kinds[c]).alias("column_type"),
            F.lit(i).cast("long").alias("position"),
            F.col("__n").alias("total_rows"),
            F.col(f"__{i}").alias("null_count"),
            F.lit(any(w in c.lower() for w in SENSITIVE_NAMES)).alias("potentially_sensitive"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*rows))) if rows else df.sparkSession.createDataFrame([], "column_name string, column_type string, position long, total_rows long, null_count long, potentially_sensitive boolean")


def row_text(df: DataFrame, *columns: str) -> Column:
    """A sheet row as text: its non-null cells, joined by bars."""
    return F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in (columns or df.columns)])


def cell_lines(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """(id, position, line): ``column: value`` for each non-null cell, in row and column order."""
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")).alias("line")) for i, c in enumerate(columns)])
    return df.select(id_col, F.inline(cells)).where(F.col("line").isNotNull())
