"""Pluggable recognisers. Libraries that aren't installed are reported as errors of the file, never as its text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib.util import find_spec
from io import BytesIO
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "array<struct<kind:string,type:string,text:string,start:int,end:int,confidence:double>>"


class NerProvider(Protocol):
    """Loads a model once a Python worker and yields, for each text, tuples (label, start, end, confidence)."""

    def __call__(self) -> Callable[[str], list[tuple[str, int, int, float]]]: ...


def entities(provider: NerProvider, text: Column, labels: tuple[str, ...] = ("PERSON", "ORG", "GPE")) -> Column:
    """A recogniser's findings as a column for ``detect`` and ``redact``."""

    @F.pandas_udf(ENTITY)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = provider()
        for s in texts:
            yield pd.Series([[{"kind": "entity", "type": label, "text": t[a:b], "start": a, "end": b, "confidence": c} for label, a, b, c in find(t) if label in labels] if t else [] for t in s])

    return run(text)


class Gazetteer:
    """A recogniser of fixed names: {name: label}; whole words, longest first."""

    def __init__(self, names: dict[str, str]):
        self.names = names

    def __call__(self) -> Callable[[str], list[tuple[str, int, int, float]]]:
        import re

        names = {k.lower(): v for k, v in self.names.items()}
        pattern = re.compile(r"\b(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\b", re.I) if names else None
        return lambda text: [(names[m[0].lower()], m.start(), m.end(), 1.0) for m in pattern.finditer(text)] if pattern else []


def pdf_text(data: bytes) -> str:
    """Text of all pages of a PDF by the first library that is installed."""
    if find_spec("pdfplumber"):
        import pdfplumber

        with pdfplumber.open(BytesIO(data)) as pdf:
            return "\n".join(p.extract_text() or "" for p in pdf.pages)
    if find_spec("PyPDF2"):
        from PyPDF2 import PdfReader

        return "\n".join(p.extract_text() or "" for p in PdfReader(BytesIO(data)).pages)
    raise RuntimeError("no PDF library is installed")


def image_text(data: bytes) -> str:
    """Recognised text of an image."""
    if not (find_spec("pytesseract") and find_spec("PIL")):
        raise RuntimeError("no text recognition library is installed")
    import pytesseract
    from PIL import Image

    return pytesseract.image_to_string(Image.open(BytesIO(data)).convert("L"), config="--oem 3 --psm 6")
