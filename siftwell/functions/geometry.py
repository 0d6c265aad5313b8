"""Boxes on pages, top-origin, as column expressions over structs (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return w * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def inside_ratio(inner: Column, outer: Column) -> Column:
    """The share of a box that lies in another; 0 for an empty box."""
    return F.when(area(inner) > 0, overlap(inner, outer) / area(inner)).otherwise(0.0)


def max_overlap(a: Column, b: Column) -> Column:
    return F.greatest(inside_ratio(a, b), inside_ratio(b, a))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(0.0)


def x_iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes' horizontal extents, of what both cover."""
    both = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    every = F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"])
    return F.when(every > 0, both / every).otherwise(0.0)


def center_distance(a: Column, b: Column) -> Column:
    dx = (a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2
    dy = (a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def flip(b: Column, height: Column) -> Column:
    """A bottom-origin box as a top-origin one."""
    return F.struct(b["x0"].alias("x0"), (height - b["y1"]).alias("y0"), b["x1"].alias("x1"), (height - b["y0"]).alias("y1"))


def drawing_page(strokes: Column, width: Column, height: Column) -> Column:
    """Whether a page is a drawing: many strokes, and dense or on a wide sheet."""
    dense = strokes / (width * height / 1000.0) > 1.0
    return (strokes >= 300) & (dense | ((width / height > 1.3) & (strokes > 500)))
