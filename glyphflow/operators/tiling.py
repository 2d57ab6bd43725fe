"""Overlapping tiles of large images, and the part of a tile whose boxes count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS, Settings
from glyphflow.functions.geometry import centroid


def tiles_along(side: Column, s: Settings = DEFAULTS) -> Column:
    """Number of tiles on one axis: the last one is cut at the edge, not moved back."""
    return F.when(side <= 0, 0).when(side <= s.tile, 1).otherwise(F.ceil((side - s.tile) / s.stride).cast("int") + 1)


def with_tiles(images: DataFrame, height: str = "h", width: str = "w", s: Settings = DEFAULTS) -> DataFrame:
    """A row per tile, row by row, with y1, x1, y2, x2 and tile_no; an image without area has none. No shuffle."""

    def starts(side: Column) -> Column:
        n = tiles_along(side, s)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k * s.stride)).otherwise(F.array().cast("array<int>"))

    h, w = F.col(height), F.col(width)
    ys, xs = starts(h), starts(w)
    pairs = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y1"), x.alias("x1")))))
    found = images.select("*", F.posexplode(pairs).alias("tile_no", "at"))
    return found.select(*images.columns, "tile_no", F.col("at.y1"), F.col("at.x1"), F.least(F.col("at.y1") + s.tile, h).alias("y2"), F.least(F.col("at.x1") + s.tile, w).alias("x2"))


def in_core(x: Column, y: Column, tile: Column, height: Column, width: Column, s: Settings = DEFAULTS) -> Column:
    """Whether a point lies in a tile (struct y1, x1, y2, x2) less half an overlap on sides within the image, edges included."""
    margin = s.overlap / 2

    def low(at: Column) -> Column:
        return F.when(at > 0, at + margin).otherwise(at.cast("double"))

    def high(at: Column, side: Column) -> Column:
        return F.when(at < side, at - margin).otherwise(at.cast("double"))

    return x.between(low(tile["x1"]), high(tile["x2"], width)) & y.between(low(tile["y1"]), high(tile["y2"], height))


def keep_core(boxes: DataFrame, polygon: str = "polygon", tile: str = "tile", height: str = "h", width: str = "w", s: Settings = DEFAULTS) -> DataFrame:
    x, y = centroid(F.col(polygon))
    return boxes.where(in_core(x, y, F.col(tile), F.col(height), F.col(width), s))
