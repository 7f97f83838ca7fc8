"""Boxes, crops and quality scores. Boxes are given as column names or columns x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_box(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> dict[str, Column]:
    """Rounded and clipped to the frame; at least one pixel."""

    def axis(a: Column, size: Column, limit: Column) -> tuple[Column, Column]:
        first = F.greatest(F.lit(0), F.least(F.bround(a).cast("int"), limit - 1))
        last = F.greatest(first + 1, F.least(limit, F.bround(a + size).cast("int")))
        return first, last - first

    (x1, width), (y1, height) = axis(x, w, frame_w), axis(y, h, frame_h)
    return {"x": x1, "y": y1, "width": width, "height": height}


def padding(kind: Column, w: Column, h: Column) -> Column:
    """Pixels around a box: more for a face, and for the plain kind `face` alone."""
    return F.when(kind == "face", F.greatest(F.lit(12), F.floor(F.greatest(w, h) * F.lit(0.18)).cast("int"))).otherwise(10)


def expanded(x: Column, y: Column, w: Column, h: Column, pad: Column, frame_w: Column, frame_h: Column) -> dict[str, Column]:
    """Half-open corners of the padded box within the frame."""
    return {"x1": F.greatest(F.lit(0), x - pad), "y1": F.greatest(F.lit(0), y - pad), "x2": F.least(frame_w, x + w + pad), "y2": F.least(frame_h, y + h + pad)}


def polygon_box(points: Column) -> Column:
    """Bounding box of an array of (x, y); null if empty or without an area."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    x1, y1, x2, y2 = F.floor(F.array_min(xs)), F.floor(F.array_min(ys)), F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys))
    box = F.struct(x1.cast("int").alias("x"), y1.cast("int").alias("y"), (x2 - x1).cast("int").alias("width"), (y2 - y1).cast("int").alias("height"))
    return F.when((F.size(points) > 0) & (x2 > x1) & (y2 > y1), box)


def square_crop(x: Column, y: Column, w: Column, h: Column, margin: float, frame_w: Column, frame_h: Column) -> dict[str, Column]:
    side = F.greatest(w, h) * F.lit(1.0 + 2.0 * margin)
    cx, cy = x + w / 2, y + h / 2
    edge = lambda v, limit: F.greatest(F.lit(0), F.least(limit, F.bround(v).cast("int")))
    return {"x1": edge(cx - side / 2, frame_w), "y1": edge(cy - side / 2, frame_h), "x2": edge(cx + side / 2, frame_w), "y2": edge(cy + side / 2, frame_h)}


def person_crop(x: Column, y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> dict[str, Column]:
    """The surroundings of a face that should hold the whole person."""
    edge = lambda v, limit: F.greatest(F.lit(0), F.least(limit, F.bround(v).cast("int")))
    return {"x1": edge(x - w * 2.25, frame_w), "y1": edge(y - h * 0.75, frame_h), "x2": edge(x + w + w * 2.25, frame_w), "y2": edge(y + h * 7.25, frame_h)}


def resized(w: Column, h: Column, most: int) -> dict[str, Column]:
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    return {"width": F.greatest(F.lit(1), F.bround(w * scale).cast("int")), "height": F.greatest(F.lit(1), F.bround(h * scale).cast("int"))}


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 without a union."""
    side = lambda p, s: F.greatest(F.lit(0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    both = side("x", "width") * side("y", "height")
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centre_distance(a: dict[str, Column], b: dict[str, Column], frame_w: Column, frame_h: Column) -> Column:
    """Distance of the centres, as a share of the frame's diagonal."""
    d = lambda p, s: (a[p] + a[s] / 2) - (b[p] + b[s] / 2)
    return F.sqrt(d("x", "width") * d("x", "width") + d("y", "height") * d("y", "height")) / F.greatest(F.lit(1.0), F.sqrt((frame_w * frame_w + frame_h * frame_h).cast("double")))


def size_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    one, two = (F.greatest(F.lit(1), c["width"] * c["height"]) for c in (a, b))
    return F.greatest(one, two) / F.least(one, two)


def portrait_quality(w: Column, h: Column, sharpness: Column, confidence: Column) -> Column:
    one = lambda c: F.least(F.lit(1.0), c)
    return F.lit(0.40) * one(F.least(w, h) / 96.0) + F.lit(0.38) * one(sharpness / 150.0) + F.lit(0.22) * F.greatest(F.lit(0.0), one(confidence))


def evidence_quality(w: Column, h: Column, sharpness: Column, confidence: Column) -> tuple[Column, Column]:
    """Score, and good / limited / poor."""
    one = lambda c: F.least(F.lit(1.0), c)
    edge = F.least(w, h)
    score = F.lit(0.48) * one(edge / 112.0) + F.lit(0.24) * one(sharpness / 100.0) + F.lit(0.28) * confidence
    hint = F.when((edge >= 96) & (sharpness >= 60) & (confidence >= 0.80), "good").when((edge >= 40) & (sharpness >= 20) & (confidence >= 0.70), "limited").otherwise("poor")
    return score, hint
