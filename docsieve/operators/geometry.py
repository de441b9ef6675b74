"""Boxes: overlap, greedy suppression, grouping and merging, as expressions on arrays of boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,w:int,h:int,confidence:double>"


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't meet or have no area."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def suppress(boxes: Column, threshold: float = 0.5) -> Column:
    """Boxes by descending confidence, without those that overlap a kept one by more than ``threshold``. Ties: the earlier."""
    seeded = F.transform(boxes, lambda b, i: F.struct((-b["confidence"]).alias("down"), i.alias("seq"), b.cast(BOX).alias("box")))
    order = F.transform(F.array_sort(seeded), lambda s: s["box"])
    return F.aggregate(order, F.array().cast(f"array<{BOX}>"), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > threshold), kept).otherwise(F.concat(kept, F.array(b))))


def near(a: Column, b: Column) -> Column:
    """Whether the centres lie within the larger width and height."""
    dx = F.abs((a["x"] + a["w"] / 2) - (b["x"] + b["w"] / 2))
    dy = F.abs((a["y"] + a["h"] / 2) - (b["y"] + b["h"] / 2))
    return (dx < F.greatest(a["w"], b["w"])) & (dy < F.greatest(a["h"], b["h"]))


def group_near(boxes: Column) -> Column:
    """Groups of boxes: each box joins the first group with a member near it, or starts one. Groups never merge."""
    kind = f"array<struct<members:array<{BOX}>>>"

    def step(groups: Column, b: Column) -> Column:
        fits = F.transform(groups, lambda g: F.exists(g["members"], lambda m: near(b, m)))
        first = F.array_position(fits, F.lit(True))
        joined = F.transform(groups, lambda g, i: F.when(i + 1 == first, F.struct(F.concat(g["members"], F.array(b)).alias("members"))).otherwise(g))
        return F.when(first > 0, joined).otherwise(F.concat(groups, F.array(F.struct(F.array(b).alias("members")))))

    plain = F.transform(boxes, lambda b: b.cast(BOX))
    return F.aggregate(plain, F.array().cast(kind), lambda g, b: step(g, b).cast(kind))


def bounds(boxes: Column) -> Column:
    """The box around all boxes."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    x2, y2 = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    return F.struct(x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"))


def merge_overlapping(boxes: Column, gap: int = 10) -> Column:
    """Sweeps boxes by x (ties in order); a box that begins no further than ``gap`` beyond the current one's right and lower
    edges stretches it, another one becomes the current."""
    kind = "struct<x:int,y:int,w:int,h:int>"
    state = f"struct<done:array<{kind}>,now:{kind}>"
    seeded = F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["x"].alias("at"), i.alias("seq"), F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")).cast(kind).alias("box"))))

    def step(s: Column, b: Column) -> Column:
        c = s["now"]
        touch = (b["x"] <= c["x"] + c["w"] + gap) & (b["y"] <= c["y"] + c["h"] + gap)
        w = F.greatest(c["x"] + c["w"], b["x"] + b["w"]) - c["x"]
        h = F.greatest(c["y"] + c["h"], b["y"] + b["h"]) - c["y"]
        stretched = F.struct(s["done"].alias("done"), F.struct(c["x"].alias("x"), c["y"].alias("y"), w.alias("w"), h.alias("h")).alias("now"))
        moved = F.struct(F.concat(s["done"], F.array(c)).alias("done"), b.alias("now"))
        first = F.struct(s["done"].alias("done"), b.alias("now"))
        return F.when(c.isNull(), first.cast(state)).when(touch, stretched.cast(state)).otherwise(moved.cast(state))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now")).cast(state)
    return F.aggregate(F.transform(seeded, lambda x: x["box"]), start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def pad(box: Column, share: float, width: Column, height: Column) -> Column:
    """The box with a margin of ``share`` of its sides, kept inside the image."""
    px, py = (box["w"] * share).cast("int"), (box["h"] * share).cast("int")
    x, y = F.greatest(F.lit(0), box["x"] - px), F.greatest(F.lit(0), box["y"] - py)
    return F.struct(x.alias("x"), y.alias("y"), (F.least(width, box["x"] + box["w"] + px) - x).alias("w"), (F.least(height, box["y"] + box["h"] + py) - y).alias("h"))


def logo_shape(area: Column, box: Column, circularity: Column) -> Column:
    """Whether a contour looks like a logo."""
    aspect = box["w"] / F.nullif(box["h"], F.lit(0))
    return (area > 1000) & (aspect > 0.2) & (aspect < 5.0) & (circularity > 0.1) & (circularity < 1.2) & (box["w"] > 20) & (box["h"] > 20)
