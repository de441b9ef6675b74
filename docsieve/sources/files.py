"""Files to text: enumeration, dispatch by suffix, archives. A file that can't be read gives a row with its error."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import images, office, providers

SUPPORTED = ("pdf", "jpg", "jpeg", "png", "xlsx", "pptx", "zip", "txt")
SCHEMA = "path string, file_name string, file_type string, text string, success boolean, is_scanned boolean, error string, extracted_files array<string>, size long"
Reader = Callable[[bytes], str]


def suffix(path: F.Column) -> F.Column:
    return F.regexp_extract(F.lower(path), r"\.(\w+)$", 1)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Supported files under a file or folder: path, file_type, length, content. The content of other files isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.where(suffix(F.col("path")).isin(*SUPPORTED)).select("path", suffix(F.col("path")).alias("file_type"), "length", "content")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Supported files under a file or folder, by path: path, file_type, length. Sorting moves no contents."""
    return contents(spark, path).drop("content").orderBy("path")


def plain_text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


READERS: dict[str, Reader] = {
    "txt": plain_text,
    "xlsx": office.workbook_text,
    "pptx": office.presentation_text,
    "pdf": providers.pdf_text,
    "jpg": providers.image_text,
    "jpeg": providers.image_text,
    "png": providers.image_text,
}


def members(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """Name, suffix and bytes of an archive's supported members, by name; archives inside aren't opened."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            kind = name.rpartition(".")[2].lower()
            if not name.endswith("/") and kind in SUPPORTED and kind != "zip":
                yield name, kind, z.read(name)


def _read(kind: str, data: bytes, readers: dict[str, Reader]) -> tuple[str | None, bool, str | None, list[str] | None]:
    try:
        if kind != "zip":
            return readers[kind](data), True, None, None
        parts, names = [], []
        for name, inner, content in members(data):
            text, ok, _, _ = _read(inner, content, readers)
            names.append(name)
            if ok:
                parts.append(f"--- File: {name.rpartition('/')[2]} ---\n{text}")
        return "\n\n".join(parts), True, None, names
    except Exception as e:  # one bad file doesn't end the batch; its row says why
        return None, False, f"{type(e).__name__}: {e}", None


def read_texts(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None, spread: int | None = None) -> DataFrame:
    """A row for each file: SCHEMA. ``readers`` replaces or adds readers by suffix; ``spread`` deals the files, which come in
    very different sizes, to that many tasks."""
    use = READERS | (readers or {})
    files = contents(spark, path)
    files = files.repartition(spread) if spread else files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, kind, n, data in zip(batch["path"], batch["file_type"], batch["length"], batch["content"], strict=True):
                text, ok, error, names = _read(kind, bytes(data), use)
                scanned = kind in ("jpg", "jpeg", "png")
                rows.append((p, p.rpartition("/")[2], kind, text, ok, scanned, error, names, n))
            yield pd.DataFrame(rows, columns=["path", "file_name", "file_type", "text", "success", "is_scanned", "error", "extracted_files", "size"])

    return files.mapInPandas(run, SCHEMA)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Text files without Python: UTF-8 where it is valid, else Latin-1."""
    files = contents(spark, path).where(F.col("file_type") == "txt")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "file_type", text.alias("text"), F.col("length").alias("size"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, file_type, content) of the supported members of all archives, as rows of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                for name, kind, content in members(bytes(data)):
                    yield pd.DataFrame([(p, name, kind, content)], columns=["path", "name", "file_type", "content"])

    return contents(spark, path).where(F.col("file_type") == "zip").select("path", "content").mapInPandas(run, "path string, name string, file_type string, content binary")


def archive_texts(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """A row for each supported member of the archives under ``path``, with the columns of ``read_texts``; its path is the
    archive's with the member's name behind a ``!``."""
    use = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, name, kind, data in zip(batch["path"], batch["name"], batch["file_type"], batch["content"], strict=True):
                text, ok, error, _ = _read(kind, bytes(data), use)
                rows.append((f"{p}!{name}", name.rpartition("/")[2], kind, text, ok, kind in ("jpg", "jpeg", "png"), error, None, len(data)))
            yield pd.DataFrame(rows, columns=["path", "file_name", "file_type", "text", "success", "is_scanned", "error", "extracted_files", "size"])

    return archive_members(spark, path).mapInPandas(run, SCHEMA)


def client_names(text: str) -> list[str]:
    """Names from JSON: a list, or a dict with ``client_names``; lower-cased, sorted."""
    data = json.loads(text)
    if isinstance(data, dict):
        data = data.get("client_names")
    if not isinstance(data, list):
        raise ValueError("expected a list or a dict with client_names")
    return sorted({str(n).lower() for n in data})


def read_client_names(spark: SparkSession, path: str) -> list[str]:
    return client_names(spark.read.text(path, wholetext=True).first()[0])


def read_workbook(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """The rows of one sheet as strings under its header."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    header, *rows = office.sheets(bytes(data))[sheet][1] or [[]]
    names = [n or f"column_{i}" for i, n in enumerate(header)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple((r + [None] * len(names))[: len(names)]) for r in rows], schema) if names else spark.createDataFrame([], "empty string")


def _profile(kind: str, data: bytes) -> dict[str, int]:
    if kind in ("png", "jpg", "jpeg"):
        return images.profile(data)
    if kind == "pptx":
        return office.presentation_profile(data)
    if kind == "xlsx":
        found = office.sheets(data)
        return {"sheets": len(found), "rows": sum(len(rows) for _, rows in found), "cells": sum(c is not None for _, rows in found for row in rows for c in row)}
    if kind == "zip":
        return {"members": sum(1 for _ in members(data))}
    return {"characters": len(plain_text(data))} if kind == "txt" else {}


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type, size, profile, error): counts that describe each file of a kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, kind, n, data in zip(batch["path"], batch["file_type"], batch["length"], batch["content"], strict=True):
                try:
                    rows.append((p, kind, n, _profile(kind, bytes(data)), None))
                except Exception as e:  # a row says what is wrong with its file
                    rows.append((p, kind, n, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "file_type", "size", "profile", "error"])

    return contents(spark, path).mapInPandas(run, "path string, file_type string, size long, profile map<string,bigint>, error string")
