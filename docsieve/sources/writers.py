"""Reports: JSON, CSV, statistics, Markdown, HTML, cleaned texts. Spark aggregates; what the driver writes is bounded."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators import pii, report
from docsieve.sources import office


def write_texts(results: DataFrame, path: str, text_col: str = "cleaned_text") -> None:
    """Cleaned texts by file name, one Parquet table (a file a text would be as many small files)."""
    results.select(F.concat(F.lit("cleaned_"), F.regexp_replace("file_name", r"\.\w+$", ""), F.lit(".txt")).alias("name"), F.col(text_col).alias("text")).write.mode("overwrite").parquet(path)


def put(spark, path: str, text: str | bytes) -> str:
    """Write one small file by the file system of the path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text, "utf-8") if isinstance(text, str) else bytearray(text))
    finally:
        out.close()
    return path


SHEET_ROWS = 1_048_575  # what a sheet of the format can hold below its header


def write_workbook(df: DataFrame, path: str, sensitive: dict[str, str], replacements: dict[str, str], mode: str = "replace") -> str:
    """The redacted sheet as a workbook with its redacted cells marked. Sheets beyond the format's size are an error; use a
    table for those."""
    rows = pii.redact_sheet(df, sensitive, replacements, mode)
    held = rows.select(*[F.col(f"`{c}`").cast("string") for c in rows.columns]).limit(SHEET_ROWS + 1).collect()
    if len(held) > SHEET_ROWS:
        raise ValueError(f"a sheet holds at most {SHEET_ROWS} rows")
    marked = {i for i, c in enumerate(df.columns) if c.lower() in sensitive}
    return put(df.sparkSession, path, office.workbook(df.columns, [list(r) for r in held], marked))


WORKFLOW = ("files", "extract text", "detect and redact personal data", "score risk", "analyse security content", "extract entities", "aggregate reports")


def write_workflow(spark, path: str) -> str:
    """The stages of the pipeline as a text diagram."""
    return put(spark, path, "\n   |\n   v\n".join(f"[{w}]" for w in WORKFLOW) + "\n")


def summary(results: DataFrame) -> dict:
    """The figures of ``overview`` with the histograms by type, level and topic; complete for no results, too."""
    return {
        **report.overview(results).first().asDict(),
        "file_types": {r[0]: r[1] for r in report.by_file_type(results).collect()},
        "risk_distribution": {r[0]: r[1] for r in report.risk_histogram(results).collect()},
        "categories_distribution": {r[0]: r[1] for r in report.by_category(results).collect()},
    }


def write_csv(results: DataFrame, path: str) -> str:
    """The flat report under its header, also for no results."""
    rows = report.csv_rows(results)
    if rows.isEmpty():
        return put(results.sparkSession, f"{path}/part-00000.csv", ",".join(rows.columns) + "\n")
    rows.write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def write_json(results: DataFrame, path: str) -> str:
    """Files as JSON lines, and a document with metadata, summary, distinct findings and recommendations."""
    results.write.mode("overwrite").json(f"{path}/files")
    found: dict[str, list[str]] = {}
    for kind, value in report.distinct_values(results).orderBy("kind", "value").toLocalIterator():
        found.setdefault(kind, []).append(value)
    body = {
        "metadata": {"generated_at": datetime.now(timezone.utc).isoformat(), "generator": "docsieve"},
        "summary": summary(results),
        "aggregated_findings": found,
        "recommendations": [r[0] for r in report.recommendations(results).collect()],
    }
    return put(results.sparkSession, f"{path}/report.json", json.dumps(body, indent=2, ensure_ascii=False))


def write_statistics(results: DataFrame, path: str) -> str:
    body = summary(results) | {
        "processing_times": report.processing_times(results).first().asDict(),
        "file_sizes": report.size_buckets(results).first().asDict(),
        "category_details": [r.asDict() for r in report.category_details(results).collect()],
        "pii_types": {r[0]: r[1] for r in report.pii_type_totals(results).collect()},
    }
    return put(results.sparkSession, f"{path}/statistics.json", json.dumps(body, indent=2, ensure_ascii=False))


def listing(results: DataFrame) -> DataFrame:
    """Four columns of an analysis report: name, type, description, findings."""
    r = report.defaults(results)
    return r.select(F.coalesce("file_name", F.lit("Unknown")).alias("file_name"), "file_type", F.coalesce("file_description", F.lit("No description")).alias("description"), "key_findings", "success")


def markdown_rows(results: DataFrame) -> DataFrame:
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    mark = F.when(F.col("success"), F.lit("✓")).otherwise(F.lit("⚠"))
    found = F.array_join(F.transform("key_findings", lambda f: F.concat(F.lit("• "), cell(f))), "<br>")
    return listing(results).select(F.concat_ws(" | ", F.lit(""), mark, cell(F.col("file_name")), F.col("file_type"), cell(F.col("description")), found, F.lit("")).alias("line"))


def html_rows(results: DataFrame) -> DataFrame:
    def safe(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    found = F.concat(F.lit("<ul>"), F.array_join(F.transform("key_findings", lambda f: F.concat(F.lit("<li>"), safe(f), F.lit("</li>"))), ""), F.lit("</ul>"))
    cells = [safe(F.col("file_name")), F.col("file_type"), safe(F.col("description")), found]
    return listing(results).select(F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>")).alias("line"))


def write_listing(results: DataFrame, path: str, kind: str) -> str:
    """The analysis report as ``csv``, ``html`` or ``md`` lines."""
    if kind == "csv":
        listing(results).select("file_name", "file_type", "description", F.array_join("key_findings", "; ").alias("key_findings")).write.mode("overwrite").csv(path, header=True, escape='"')
    elif kind in ("html", "md"):
        (html_rows if kind == "html" else markdown_rows)(results).write.mode("overwrite").text(path)
    else:
        raise ValueError("kind must be csv, html or md")
    return path


def write_all(results: DataFrame, folder: str) -> dict[str, str]:
    """All reports under one time-stamped name; the results are computed once."""
    base = f"{folder}/security_report_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    results = report.complete(results).persist()
    try:
        return {"json": write_json(results, f"{base}.json"), "csv": write_csv(results, f"{base}.csv"), "statistics": write_statistics(results, f"{base}_statistics"), "html": write_listing(results, f"{base}.html", "html"), "markdown": write_listing(results, f"{base}.md", "md")}
    finally:
        results.unpersist()
