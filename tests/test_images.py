import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.functions import pixels
from docsieve.operators import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered_png(image):
    """A PNG whose rows use the five filters in turn, by their definitions."""
    h, w, n = image.shape
    flat = image.reshape(h, w * n).astype(int)
    raw = bytearray()
    for y in range(h):
        raw.append(y % 5)
        for x in range(w * n):
            a = flat[y, x - n] if x >= n else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - n] if y and x >= n else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[y % 5]) % 256)
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return pixels.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


def flooded(mask):
    """Boxes and areas of the connected parts, pixel by pixel."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        part, todo = [], [left.pop()]
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        ys, xs = zip(*part, strict=True)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    return sorted(out)


def scene():
    image = images.blank(120, 160)
    image[20:60, 30:80] = (220, 20, 20)
    image[80:110, 100:140] = (20, 20, 220)
    return image


def test_png_round_trip_and_filters():
    noise = np.random.default_rng(1).integers(0, 256, (23, 17, 3), dtype=np.uint8)
    assert (pixels.decode_png(pixels.encode_png(noise)) == noise).all()
    assert (pixels.decode_png(filtered_png(noise)) == noise).all()
    with pytest.raises(ValueError):
        pixels.decode_png(b"GIF89a")


def test_png_of_few_bits():
    head = struct.pack(">IIBBBBB", 3, 1, 1, 0, 0, 0, 0)
    data = pixels.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\x00\xa0")) + chunk(b"IEND", b"")
    assert pixels.decode_png(data)[0, :, 0].tolist() == [255, 0, 255]


def test_shapes_equal_flood_fill():
    rng = np.random.default_rng(2)
    for share in (0.1, 0.4, 0.6):
        mask = rng.random((40, 50)) < share
        found = sorted((s["x"], s["y"], s["w"], s["h"], int(s["area"])) for s in pixels.shapes(mask))
        assert found == flooded(mask)
    assert pixels.shapes(np.zeros((3, 3), bool)) == []


def test_template_and_skew():
    image, logo = images.blank(90, 100), images.blank(20, 24)
    logo[4:16, 4:10] = 0
    logo[8:12, 10:20] = 90
    image[50:70, 40:64] = logo
    best = max(pixels.match(image, logo), key=lambda m: m["confidence"])
    assert (best["x"], best["y"], best["w"], best["h"]) == (40, 50, 24, 20) and best["confidence"] > 0.99
    lines = images.blank(200, 200)
    lines[40:160:20, 30:170] = 0
    lines[41:160:20, 30:170] = 0
    assert pixels.skew(lines) == 0.0
    assert abs(pixels.skew(pixels.rotate(lines, 5)) - 5) <= 1
    assert pixels.skew(images.blank(5, 5)) == 0.0


@pytest.mark.parametrize("mode", pixels.MASKS)
def test_masks_change_the_box_only(mode):
    image = np.random.default_rng(3).integers(0, 256, (60, 70, 3), dtype=np.uint8)
    before = image.copy()
    pixels.mask_box(image, 10, 10, 30, 25, mode)
    pixels.mask_box(image, 500, 500, 9, 9, mode)
    outside = np.ones((60, 70), bool)
    outside[10:35, 10:40] = False
    assert (image[outside] == before[outside]).all() and (image != before).any()


@pytest.mark.parametrize("steps", [("denoise", "contrast", "threshold"), ("sharpen", "adaptive"), ("deskew",)])
def test_preprocessing_keeps_the_size(steps):
    assert pixels.preprocess(scene(), steps).shape == (120, 160)


def test_images_as_rows(spark):
    rows = [("a", pixels.encode_png(scene())), ("b", pixels.encode_png(images.blank(10, 10))), ("c", b"no image")]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = images.detect_logos(df, ("color", "contour"))
    by = {r.path: r for r in found.collect()}
    assert sorted((d.x, d.y, d.w, d.h) for d in by["a"].detections) == [(30, 20, 50, 40), (100, 80, 40, 30)]
    assert by["b"].detections == [] and by["c"].detections is None and by["c"].error
    assert tuple(images.batch_statistics(found).first()) == (3, 2, 2)
    masked = {r.path: r for r in images.mask(found.where("path < 'c'"), mode="remove").collect()}
    assert (pixels.decode_png(bytes(masked["a"].masked)) == 255).all()
    regions = images.logo_regions(df.where("path = 'a'")).first().regions
    assert sorted(tuple(r) for r in regions) == [(30, 20, 50, 40), (100, 80, 40, 30)]
    measured = images.measures(df.where("path = 'b'")).first().measures
    assert measured["brightness"] == 255 and measured["contrast"] == 0
    assert images.preprocess(df.where("path = 'a'")).first().error is None


def test_sensitive_words_are_masked(spark):
    word = "array<struct<text:string,x:int,y:int,w:int,h:int>>"
    df = spark.createDataFrame([(pixels.encode_png(scene()), [("a@b.org", 30, 20, 20, 20), ("plain", 100, 80, 40, 30)])], f"content binary, words {word}")
    boxes = df.withColumn("boxes", images.sensitive_boxes(F.col("words"), lambda t: t.contains("@")))
    out = pixels.decode_png(bytes(images.mask(boxes, "boxes", "remove").first().masked))
    assert (out[17:43, 27:53] == 255).all() and (out[80:110, 100:140] == scene()[80:110, 100:140]).all()
