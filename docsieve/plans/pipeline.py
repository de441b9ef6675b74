"""From files or texts to per-file results: cleanse, analyse or both, as one plan."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.text import let
from docsieve.operators import pii, report, security
from docsieve.sources import decks, files, writers

WORKFLOWS = ("cleanse", "analyze", "both")


def process(texts: DataFrame, workflow: str = "both", mode: str = "replace", client_names: Sequence[str] = ()) -> DataFrame:
    """Results by file from rows with ``file_name, file_type, text, success, error``, without a shuffle.

    Under ``both`` the cleaned text is analysed. Stages that the workflow leaves out aren't in the plan.
    """
    if workflow not in WORKFLOWS:
        raise ValueError(f"workflow must be one of {', '.join(WORKFLOWS)}")
    text = F.coalesce("text", F.lit(""))
    own = [c for c in ("path", "file_name", "file_type", "success", "error") if c in texts.columns]
    rows = texts.select(*own, F.current_timestamp().cast("string").alias("processing_timestamp"), F.lit(None).cast("double").alias("processing_time"), F.char_length("text").cast("long").alias("text_length"), text.alias("__text"))
    # explode keeps the optimizer from copying an expression to every column that is taken from it
    once = lambda value, name: F.explode(F.array(value)).alias(name)
    if workflow != "analyze":

        def clean(fs):
            level = pii.risk(fs)
            return F.struct(pii.redact(F.col("__text"), mode, findings=fs).alias("cleaned_text"), level["risk_level"].alias("risk_level"), level["risk_score"].alias("risk_score"), level["pii_count"].alias("pii_count"), pii.statistics(fs)["pattern_types"].alias("pii_types"), level["recommendations"].alias("pii_recommendations"))

        rows = rows.select("*", once(let(pii.detect(F.col("__text"), client_names), clean), "__pii")).select("*", "__pii.*").drop("__pii")
    if workflow != "cleanse":
        source = "cleaned_text" if workflow == "both" else "__text"
        rows = rows.select("*", once(security.analysis(F.col(source)), "__a")).select("*", "__a.*").drop("__a").withColumnRenamed("description", "file_description")
    return rows.drop("__text")


def run(spark: SparkSession, path: str, workflow: str = "both", mode: str = "replace", client_names: Sequence[str] = (), output: str | None = None, members: bool = False, presentation: bool = False) -> DataFrame:
    """Reads all supported files under ``path``, processes them and, with ``output``, writes the reports. With ``members``
    the archives there are batches: each of their members is a file of its own, and other files aren't read. With
    ``presentation`` the reports include one for slides, which lists a bounded number of files."""
    texts = files.archive_texts(spark, path) if members else files.read_texts(spark, path)
    results = process(texts, workflow, mode, client_names)
    if output:
        writers.write_all(results, output)
        if presentation:
            decks.write_presentation(report.complete(results), f"{output}/security_report.pptx")
    return results


def final_summary(results: DataFrame) -> DataFrame:
    """Files, successes and the rate of success in percent."""
    ok = F.count_if(F.coalesce("success", F.lit(True)))
    return results.agg(F.count(F.lit(1)).alias("total_files"), ok.alias("successful"), (ok * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("success_rate"))


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="docsieve", description="Cleanse and analyse documents.")
    parser.add_argument("path")
    parser.add_argument("--workflow", choices=WORKFLOWS, default="both")
    parser.add_argument("--mode", choices=pii.MODES, default="replace")
    parser.add_argument("--client-names")
    parser.add_argument("--output")
    parser.add_argument("--members", action="store_true", help="process the members of archives as files of their own")
    parser.add_argument("--presentation", action="store_true", help="write the report as a presentation, too")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("docsieve").getOrCreate()
    names = files.read_client_names(spark, args.client_names) if args.client_names else ()
    final_summary(run(spark, args.path, args.workflow, args.mode, names, args.output, args.members, args.presentation)).show(truncate=False)


if __name__ == "__main__":
    main()
