"""A training corpus from the documents table: quality, exact copies, near copies, benchmark leaks, token ids.

Each stage gets all documents that its predecessor kept and returns them with the columns of ``documents``; the last one
returns doc_id, n_tokens and ids. Stages are written as Parquet and read again, which cuts lineage between them; a stage's
working tables go once its result is written.

Defined results: null texts count as empty, and the classifier decides on them like on any text; further columns, of whatever
name, are passed through by all stages but the last; of rows alike in id and text one stays; rows of one id and different
texts are judged each on its own; a null doc_id is an id like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import decontam, exact_dedup, quality_gam, simhash, sp_codec
from docsieve.llm.queries import PIECES, table
from docsieve.llm.shared import Workspace


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # null texts count as empty
    return sp_codec.encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), PIECES).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: A fitted classifier, reachability and piece merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    before = tuple(Workspace.opened)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), f"stage{k}")
        Workspace.release(before)
        if k:
            space.drop(f"stage{k - 1}")
    return docs
