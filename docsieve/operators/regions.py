"""Classifier of text regions: direct patterns, context, fuzzy keywords."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsieve.functions import catalogs as C


def indel_ratio(a: str, b: str) -> float:
    """Share of characters, in percent, that insertions and deletions leave: 200 LCS / (len a + len b)."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def _match_masks(codes: np.ndarray, word: str) -> np.ndarray:
    """For each character of a text, the places of ``word`` that hold it, as bits."""
    masks = np.zeros(len(codes), np.uint64)
    for c in set(word):
        masks[codes == ord(c)] = sum(1 << i for i, x in enumerate(word) if x == c)
    return masks


def _likeness(windows: np.ndarray, word: str) -> np.ndarray:
    """The indel ratios of equally long stretches (rows of masks) to ``word``, all in one pass over their columns."""
    full = np.uint64((1 << len(word)) - 1)
    state = np.full(len(windows), full)
    for column in windows.T:
        hit = state & column
        state = ((state + hit) | (state - hit)) & full
    return 200.0 * (len(word) - np.bitwise_count(state).astype(int)) / (windows.shape[1] + len(word))


def fuzzy_keyword(text: str | None, threshold: float = 80.0) -> tuple[str, float] | None:
    """The first keyword, in the catalog's order, that the whole text is like (else a stretch of the keyword's length), and
    the likeness. Keywords that share too few letters with the text are passed over, which loses none."""
    codes = np.frombuffer((text or "").lower().strip().encode("utf-32-le", "surrogatepass"), np.uint32)
    have = Counter(codes.tolist())
    for word in C.REGION_KEYWORDS:
        m, n = len(word), len(codes)
        letters = sum(min(have[ord(c)], k) for c, k in Counter(word).items())
        if 200.0 * letters < threshold * 2 * min(m, n) or not n:
            continue
        masks = _match_masks(codes, word)
        candidates = [("fuzzy_keyword", masks[None])] if 200.0 * letters >= threshold * (n + m) else []
        if n > m:
            candidates.append(("partial_keyword", sliding_window_view(masks, m)))
        for kind, windows in candidates:
            ratios = _likeness(windows, word)
            if (ratios >= threshold).any():
                return kind, float(ratios[np.argmax(ratios >= threshold)])
    return None


@F.pandas_udf(T.StructType().add("type", T.StringType()).add("confidence", T.DoubleType()))
def _fuzzy(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        got = [None if x is None else fuzzy_keyword(x) for x in s]
        got = [x or (None, None) for x in got]
        yield pd.DataFrame(got, columns=["type", "confidence"]).astype({"confidence": "float64"})


def is_cli(text: Column) -> Column:
    out = F.lit(False)
    for m in C.CLI_MARKERS:
        out = out | F.contains(text, F.lit(m))
    return out


def _first(text: Column, prefix: str = "") -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(C.REGIONS):
        out = F.when(text.rlike(p.regex), F.lit(prefix + p.name)).otherwise(out)
    return out


def classify(text: Column, neighbours: Column | None = None, fuzzy: bool = True) -> Column:
    """type and confidence of what a region holds, or null: a pattern of its own text (95), one of the text together with
    its neighbours (85), a keyword it resembles (the likeness). Only the fuzzy step runs Python."""
    t = F.coalesce(text, F.lit(""))
    direct = _first(t)
    kind, sure = direct, F.when(direct.isNotNull(), F.lit(95.0))
    if neighbours is not None:
        near = F.when(F.size(neighbours) > 0, _first(F.array_join(F.concat(F.array(t), neighbours), " "), "contextual_"))
        sure = F.coalesce(sure, F.when(near.isNotNull(), F.lit(85.0)))
        kind = F.coalesce(kind, near)
    if fuzzy:
        like = _fuzzy(F.when(kind.isNull(), t))  # decided regions send nothing to Python
        sure = F.coalesce(sure, like["confidence"])
        kind = F.coalesce(kind, like["type"])
    return F.struct(kind.alias("type"), sure.alias("confidence"))


#: What texts of page kinds hold.
CODE_WORDS = ("function", "class", "def", "return", "import")
FORM_WORDS = ("name:", "date:", "signature:", "address:", "phone:", "email:")
CERTIFICATE_WORDS = ("CERTIFICATE", "CERTIFICATION", "DIPLOMA")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def content_type(text: Column, h_lines: Column | int = 0, v_lines: Column | int = 0, shapes: Column | int = 0, variance: Column | float = 0.0) -> Column:
    """What an image shows, by its recognised text and by counts of lines and shapes that an image provider measures."""
    h_lines, v_lines, shapes, variance = (x if isinstance(x, Column) else F.lit(x) for x in (h_lines, v_lines, shapes, variance))
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike(r"\d{2}:\d{2}:\d{2}") | t.rlike(r"\d{2}/\d{2}/\d{4}"), "surveillance")
        .when(_any(t, CODE_WORDS), "code")
        .when((h_lines > 3) & (v_lines > 3), "form")
        .when(shapes > 3, "diagram")
        .when(variance > 500, "handwriting")
        .otherwise("standard")
    )


def page_type(text: Column, h_lines: Column | int = 0, v_lines: Column | int = 0, variance: Column | float = 0.0) -> Column:
    """What a page of a document holds."""
    h_lines, v_lines, variance = (x if isinstance(x, Column) else F.lit(x) for x in (h_lines, v_lines, variance))
    t = F.coalesce(text, F.lit(""))
    return (
        F.when((h_lines > 3) & (v_lines > 3), "table")
        .when(_any(F.lower(t), FORM_WORDS), "form")
        .when(_any(t, ("{", "}", *CODE_WORDS, "from")), "code")
        .when(variance > 500, "handwriting")
        .otherwise("standard")
    )


def document_type(text: Column, h_lines: Column | int = 0, v_lines: Column | int = 0) -> Column:
    h_lines, v_lines = (x if isinstance(x, Column) else F.lit(x) for x in (h_lines, v_lines))
    t = F.coalesce(text, F.lit(""))
    return F.when((h_lines > 5) & (v_lines > 5), "table").when(_any(F.upper(t), CERTIFICATE_WORDS), "certificate").when(_any(t, ("{", "}", "function", "class", "def")), "code").otherwise("default")
