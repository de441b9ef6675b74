"""Redacted presentations: a text body or table cell that holds personal data becomes one red run, all else stays.

Slides are taken apart and put together by Arrow functions; what is found and replaced in between is the redaction
as columns. A presentation is one row, so files are the unit of work and nothing is shuffled.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from io import BytesIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions.text import let
from docsieve.operators import pii

from . import files, writers
from .office import DRAW, _number

SHOW = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
BODIES = (f"{SHOW}txBody", f"{DRAW}txBody")
SHAPES = tuple(SHOW + x for x in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp"))
RED = "FF0000"
TEXTS = "slides int, shapes int, texts array<struct<slide:int,text:string>>, error string"


def _slide_parts(z: zipfile.ZipFile) -> list[str]:
    return sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)


def _bodies(slide: ET.Element) -> list[ET.Element]:
    return [x for x in slide.iter() if x.tag in BODIES]


def _said(body: ET.Element) -> str:
    return "\n".join("".join(t.text or "" for t in p.iter(f"{DRAW}t")) for p in body.findall(f"{DRAW}p"))


def body_texts(data: bytes) -> tuple[int, int, list[tuple[int, str]]]:
    """Numbers of slides and of their shapes, and (slide, text) of all text bodies in order, empty ones too."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        slides = [ET.fromstring(z.read(n)) for n in _slide_parts(z)]
    shapes = sum(sum(x.tag in SHAPES for x in tree) for slide in slides for tree in slide.iter(f"{SHOW}spTree"))
    return len(slides), shapes, [(k, _said(b)) for k, slide in enumerate(slides, 1) for b in _bodies(slide)]


def replaced(data: bytes, texts: list[str | None]) -> bytes:
    """The presentation with its text bodies, in the order of ``body_texts``, replaced where ``texts`` isn't None."""
    left, out = iter(texts), BytesIO()
    with zipfile.ZipFile(BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        changed = {}
        for part in _slide_parts(old):
            xml = old.read(part)
            for _, (prefix, uri) in ET.iterparse(BytesIO(xml), events=["start-ns"]):
                if prefix and not re.fullmatch(r"ns\d+", prefix):  # these are kept for the serialiser
                    ET.register_namespace(prefix, uri)
            slide = ET.fromstring(xml)
            todo = [(b, t) for b, t in ((b, next(left)) for b in _bodies(slide)) if t is not None]
            for body, text in todo:
                for p in body.findall(f"{DRAW}p"):
                    body.remove(p)
                run = ET.SubElement(ET.SubElement(body, f"{DRAW}p"), f"{DRAW}r")
                ET.SubElement(ET.SubElement(ET.SubElement(run, f"{DRAW}rPr"), f"{DRAW}solidFill"), f"{DRAW}srgbClr", val=RED)
                ET.SubElement(run, f"{DRAW}t").text = text
            if todo:
                changed[part] = ET.tostring(slide, encoding="UTF-8", xml_declaration=True)
        for info in old.infolist():
            new.writestr(info, changed.get(info.filename, old.read(info)))
    return out.getvalue()


def _take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for p, data in zip(batch["path"], batch["content"], strict=True):
            try:
                n, shapes, texts = body_texts(bytes(data))
                rows.append((p, data, n, shapes, [{"slide": k, "text": t} for k, t in texts], None))
            except Exception as e:  # a row says what is wrong with its file
                rows.append((p, data, 0, 0, [], f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "content", "slides", "shapes", "texts", "error"])


def _put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        new = [None if e is not None else replaced(bytes(d), list(t)) for d, t, e in zip(batch["content"], batch["new"], batch["error"], strict=True)]
        yield batch.drop(columns="new").assign(content=new)


def redact_presentations(spark: SparkSession, path: str, mode: str = "replace", client_names: Sequence[str] = ()) -> DataFrame:
    """A row for each presentation under ``path``: path, total_slides, total_shapes, slides_with_pii, shapes_with_pii,
    total_pii_instances, pii_by_type (entities and patterns), content (the redacted file; null where ``error`` says why)."""
    found = files.contents(spark, path).where(F.col("file_type") == "pptx").select("path", "content")
    apart = found.mapInPandas(_take_apart, f"path string, content binary, {TEXTS}")

    def clean(x):
        new = lambda fs: F.struct(x["slide"].alias("slide"), pii.redact(x["text"], mode, findings=fs).alias("text"), F.transform(fs, lambda f: f["type"]).alias("types"))
        return let(pii.detect(x["text"], client_names), new)

    # explode keeps the optimizer from copying the redaction to every column taken from it
    done = apart.select("*", F.explode(F.array(F.transform("texts", clean))).alias("done")).drop("texts")
    hit = F.filter("done", lambda x: F.size(x["types"]) > 0)
    types = F.flatten(hit["types"])
    by_type = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)).cast("long"))))
    counted = done.select(
        "path",
        F.col("slides").alias("total_slides"),
        F.col("shapes").alias("total_shapes"),
        F.size(F.array_distinct(hit["slide"])).alias("slides_with_pii"),
        F.size(hit).alias("shapes_with_pii"),
        F.size(types).alias("total_pii_instances"),
        F.to_json(by_type).alias("pii_by_type"),
        "error",
        "content",
        F.transform("done", lambda x: F.when(F.size(x["types"]) > 0, x["text"])).alias("new"),
    )
    rows = counted.mapInPandas(_put_together, counted.drop("new").schema)
    return rows.withColumn("pii_by_type", F.from_json("pii_by_type", "map<string,bigint>"))


def write_redacted(spark: SparkSession, path: str, target: str, mode: str = "replace", client_names: Sequence[str] = ()) -> str:
    """One presentation, redacted, as a file."""
    row = redact_presentations(spark, path, mode, client_names).first()
    if row is None or row["error"]:
        raise ValueError(row["error"] if row else f"no presentation at {path}")
    return writers.put(spark, target, bytes(row["content"]))
