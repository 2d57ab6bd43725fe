"""Geometry as Column functions. Coordinates are pixels, x to the right, y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS, Settings


def padded_sides(h: Column, w: Column, s: Settings = DEFAULTS) -> tuple[Column, Column]:
    """Sides after a tiny image got its zero border."""
    tiny = h + w < s.tiny_sum
    return F.when(tiny, F.greatest(h, F.lit(s.tiny_side))).otherwise(h), F.when(tiny, F.greatest(w, F.lit(s.tiny_side))).otherwise(w)


def detector_sides(h: Column, w: Column, s: Settings = DEFAULTS) -> tuple[Column, Column]:
    """The detector's input size for sides that are padded already: scaled up to the least side, down to the
    largest, cut to whole pixels each time, then to the next multiple of the step (halves to even)."""
    least = F.least(h, w)
    ratio = F.when(least < s.limit_side, F.lit(float(s.limit_side)) / least).otherwise(F.lit(1.0))
    first = [(side * ratio).cast("int") for side in (h, w)]
    most = F.greatest(*first)
    shrink = F.lit(float(s.max_side)) / F.greatest(most, F.lit(1))
    return tuple(F.greatest((F.rint(F.when(most > s.max_side, (side * shrink).cast("int")).otherwise(side) / s.side_step) * s.side_step).cast("int"), F.lit(s.side_step)) for side in first)


def unclip_distance(w: Column, h: Column, s: Settings = DEFAULTS) -> Column:
    """How far each side of a rotated rectangle moves outwards; 0 for a degenerate one."""
    flat = (w < 1e-6) | (h < 1e-6)
    return F.when(flat, F.lit(0.0)).otherwise(w * h * s.unclip_ratio / (2 * (w + h)) * s.unclip_extra)


def passes_gates(short: Column, score: Column, short_after: Column, s: Settings = DEFAULTS) -> Column:
    """Whether a box counts: its short side, its score, and its short side after it has grown."""
    return (short >= s.short_side) & (score >= s.box_score) & (short_after >= s.short_side_after)


def to_image(value: Column, map_side: Column, image_side: Column) -> Column:
    """A coordinate of a probability map in the image; the far edge itself is allowed."""
    return F.least(F.greatest(F.rint(value / map_side * image_side), F.lit(0.0)), image_side.cast("double")).cast("int")


def translate(polygon: Column, dx: Column, dy: Column) -> Column:
    return F.transform(polygon, lambda p: F.array(p[0] + dx, p[1] + dy))


def centroid(polygon: Column) -> tuple[Column, Column]:
    def mean(axis: int) -> Column:
        return F.aggregate(polygon, F.lit(0.0), lambda total, p: total + p[axis]) / F.size(polygon)

    return mean(0), mean(1)


def aabb(polygon: Column) -> Column:
    """struct<x1, y1, x2, y2> of a polygon."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x1, y1, x2, y2; 0 where the union is empty."""

    def area(box: Column) -> Column:
        return (box["x2"] - box["x1"]).cast("long") * (box["y2"] - box["y1"])

    zero = F.lit(0)
    width = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = width.cast("long") * height
    union = area(a) + area(b) - inter
    return F.when(union < 1e-6, F.lit(0.0)).otherwise(inter / union)


def crop_sides(polygon: Column) -> tuple[Column, Column]:
    """Width and height of the straightened crop."""

    def length(i: int, j: int) -> Column:
        p, q = polygon[i], polygon[j]
        return F.sqrt(F.pow((p[0] - q[0]).cast("double"), 2) + F.pow((p[1] - q[1]).cast("double"), 2))

    def side(a: Column, b: Column) -> Column:
        return F.greatest(F.greatest(a, b).cast("int"), F.lit(1))

    return side(length(0, 1), length(2, 3)), side(length(0, 3), length(1, 2))


def is_upright(w: Column, h: Column, s: Settings = DEFAULTS) -> Column:
    """Whether a crop is so tall that it is turned by a quarter."""
    return h > s.upright_ratio * w


def corner_order(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: the two left ones and the two right ones by y.

    Equal x keep their order; of equal y the later point goes to the top.
    """
    placed = F.transform(points, lambda p, i: F.struct(p[0].alias("x"), i.alias("i"), p.alias("p")))
    by_x = F.transform(F.array_sort(placed), lambda s: s["p"])

    def pair(a: Column, b: Column) -> tuple[Column, Column]:
        lower = b[1] > a[1]
        return F.when(lower, a).otherwise(b), F.when(lower, b).otherwise(a)

    tl, bl = pair(by_x[0], by_x[1])
    tr, br = pair(by_x[2], by_x[3])
    return F.array(tl, tr, br, bl)


def recogniser_width(ratio: Column, widest: Column, s: Settings = DEFAULTS) -> tuple[Column, Column]:
    """The batch's input width and the width that an image with this w/h takes of it; ``widest`` is the batch's largest w/h."""
    _, h, w = s.rec_shape
    whole = (F.lit(h) * F.greatest(F.lit(w / h), widest)).cast("int")
    return whole, F.least(whole, F.ceil(F.lit(h) * ratio).cast("int"))
