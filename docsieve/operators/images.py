"""Images: logos found, suppressed and masked, boxes of text masked, measures. An image is one row and nothing is shuffled;
Arrow functions handle pixels, while choosing among boxes is expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import pixels

from . import geometry

METHODS = ("template", "color", "contour")
FOUND = "array<struct<method:string,x:int,y:int,w:int,h:int,confidence:double,area:double,circularity:double>>"


def _by_image(df: DataFrame, f: Callable[[bytes, object], object], result: str, kind: str, extra: str | None = None) -> DataFrame:
    """``df`` with ``result``: f(content, extra) of each row; null, and why in ``error``, where it fails or there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, errors = [], []
            for data, more in zip(batch["content"], batch[extra] if extra else batch["content"], strict=True):
                try:
                    values.append(f(bytes(data), more))
                    errors.append(None)
                except Exception as e:  # a row says what is wrong with its image
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.drop(columns=[c for c in (result, "error") if c in batch]).assign(**{result: pd.Series(values, batch.index, object), "error": pd.Series(errors, batch.index, object)})

    kept = [f"`{n}` {t}" for n, t in df.dtypes if n not in (result, "error")]
    return df.mapInPandas(run, ", ".join([*kept, f"`{result}` {kind}", "error string"]))


def detect_logos(images: DataFrame, methods: Sequence[str] = METHODS, templates: Sequence[bytes] = (), threshold: float = 0.5) -> DataFrame:
    """``images`` (with ``content``) with ``detections``: what the methods find, without boxes that overlap a surer one by more
    than ``threshold``. A contour's confidence is its circularity, 1 at most. Templates are files of images; they are sent to
    the tasks, so there should be few. Keypoint matching isn't offered."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}")
    patterns = [pixels.decode(t) for t in templates] if "template" in methods else []

    def find(data: bytes, _) -> list[dict]:
        image = pixels.decode(data)
        found = [m for t in patterns for m in pixels.match(image, t)]
        if "color" in methods:
            found += pixels.color_regions(image)
        if "contour" in methods:
            found += [{"method": "contour", **s, "confidence": min(s["circularity"], 1.0)} for s in pixels.dark_shapes(image)]
        return [{"circularity": None, **f} for f in found]

    rows = _by_image(images, find, "found", FOUND)
    shaped = F.filter("found", lambda f: (f["method"] != "contour") | geometry.logo_shape(f["area"], f, f["circularity"]))
    box = lambda f: F.struct(*[f[n].alias(n) for n in ("x", "y", "w", "h", "confidence")])
    kept = geometry.suppress(F.transform("shaped", box), threshold)
    whole = F.transform(kept, lambda k: F.element_at(F.filter("shaped", lambda f: box(f) == k), 1))
    return rows.withColumn("shaped", shaped).withColumn("detections", whole).drop("found", "shaped")


def logo_regions(images: DataFrame) -> DataFrame:
    """``images`` with ``regions``: dark parts of more than 1000 pixels, from half to twice as wide as high."""
    rows = _by_image(images, lambda data, _: [{"method": "dark", "confidence": None, **s} for s in pixels.dark_shapes(pixels.decode(data))], "found", FOUND)
    fits = F.filter("found", lambda f: (f["area"] > 1000) & (f["w"] / f["h"]).between(0.5, 2.0))
    return rows.withColumn("regions", F.transform(fits, lambda f: F.struct(f["x"].alias("x"), f["y"].alias("y"), f["w"].alias("w"), f["h"].alias("h")))).drop("found")


def mask(images: DataFrame, boxes: str = "detections", mode: str = "blur") -> DataFrame:
    """``images`` with ``masked``: a PNG in which the boxes of that column are hidden. Images without boxes are copied."""
    if mode not in pixels.MASKS:
        raise ValueError(f"mode must be one of {', '.join(pixels.MASKS)}")

    def hide(data: bytes, found) -> bytes:
        image = pixels.decode(data)
        for b in [] if found is None else found:
            pixels.mask_box(image, b["x"], b["y"], b["w"], b["h"], mode)
        return pixels.encode_png(image)

    return _by_image(images, hide, "masked", "binary", boxes)


def sensitive_boxes(words: Column, found: Callable[[Column], Column], share: float = 0.15) -> Column:
    """The boxes, with a margin, of recognised words (text, x, y, w, h) that hold something by ``found``, which makes a
    condition of a text. The margin may leave the image; masks are cut to it."""
    hit = F.filter(words, lambda w: found(w["text"]))
    edge = F.lit(2**30)
    return F.transform(hit, lambda w: geometry.pad(w, share, edge, edge))


def preprocess(images: DataFrame, steps: Sequence[str] = ("denoise", "contrast", "threshold")) -> DataFrame:
    """``images`` with ``ready``: a grey PNG for text recognition (steps: ``pixels.preprocess``)."""
    return _by_image(images, lambda data, _: pixels.encode_png(pixels.preprocess(pixels.decode(data), tuple(steps))), "ready", "binary")


def measures(images: DataFrame) -> DataFrame:
    """``images`` with ``measures``: width, height, blur_score, contrast, brightness, skew."""

    def measure(data: bytes, _) -> dict[str, float]:
        image = pixels.decode(data)
        return {"width": float(image.shape[1]), "height": float(image.shape[0]), **pixels.measures(image), "skew": pixels.skew(image)}

    return _by_image(images, measure, "measures", "map<string,double>")


def batch_statistics(detected: DataFrame) -> DataFrame:
    """Images, those without an error, and all detections."""
    return detected.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("detections"))), F.lit(0)).alias("total_detections"),
    )


def blank(height: int, width: int) -> np.ndarray:
    """A white image."""
    return np.full((height, width, 3), 255, np.uint8)
