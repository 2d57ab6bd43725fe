"""Overlap suppression: of overlapping boxes of a page the one with the higher score stays.

Scores go down; of equal ones the larger id comes first.  A box stays if its
IoU with no box that stays before it is above the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS
from glyphflow.functions.geometry import iou
from glyphflow.storage import drop, materialise

#: Boxes of a page up to which the fold over arrays is the faster one.
FOLD = 16


def suppress_array(boxes: Column, limit: float = DEFAULTS.overlap_iou) -> Column:
    """Of an array<struct<score, id, x1, y1, x2, y2, ...>> the ones that stay, best first."""
    order = F.array_sort(boxes, lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["id"] > b["id"], -1).when(a["id"] < b["id"], 1).otherwise(0))
    none = F.filter(boxes, lambda b: F.lit(False))
    return F.aggregate(order, none, lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > limit), kept).otherwise(F.concat(kept, F.array(b))))


def _shares(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, a: slice, b: slice) -> np.ndarray:
    """IoU of boxes ``a`` (rows) and ``b`` (columns)."""
    width = np.minimum(x2[a, None], x2[None, b]) - np.maximum(x1[a, None], x1[None, b])
    height = np.minimum(y2[a, None], y2[None, b]) - np.maximum(y1[a, None], y1[None, b])
    inter = np.maximum(width, 0) * np.maximum(height, 0)
    area = (x2 - x1) * (y2 - y1)
    union = area[a, None] + area[None, b] - inter
    return np.where(union < 1e-6, 0.0, inter / np.maximum(union, 1))


def suppress_rows(score: np.ndarray, ids: np.ndarray, box: np.ndarray, limit: float = DEFAULTS.overlap_iou, block: int = 512) -> np.ndarray:
    """Rows that stay, best first; ``box``: x1, y1, x2, y2 per row.

    Boxes are compared a block at a time: within it one after the other, then
    those of the block that stay rule out later ones together.
    """
    order = np.lexsort((-ids, -score))
    x1, y1, x2, y2 = box[order].T.astype(np.int64)
    alive = np.ones(len(order), bool)
    for at in range(0, len(order), block):
        to = min(at + block, len(order))
        over = _shares(x1, y1, x2, y2, slice(at, to), slice(at, to)) > limit
        for i in range(to - at):
            if alive[at + i]:
                alive[at + i + 1 : to] &= ~over[i, i + 1 :]
        for later in range(to, len(order), block):
            rest = slice(later, min(later + block, len(order)))
            alive[rest] &= ~(_shares(x1, y1, x2, y2, slice(at, to), rest) > limit)[alive[at:to]].any(axis=0)
    return order[alive]


def _by_rows(groups: DataFrame, limit: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("boxes")
            out = []
            for i in range(batch.num_rows):
                own = batch.column(at)[i].values
                box = np.stack([own.field(n).to_numpy(zero_copy_only=False) for n in ("x1", "y1", "x2", "y2")], axis=1)
                keep = suppress_rows(own.field("score").to_numpy(zero_copy_only=False), own.field("id").to_numpy(zero_copy_only=False), box, limit)
                out.append(own.take(pa.array(keep)))
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32))
            values = pa.concat_arrays(out) if out else batch.column(at).values
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.ListArray.from_arrays(offsets, values), *batch.columns[at + 1 :]], batch.schema.names)

    return groups.mapInArrow(run, groups.schema)


def suppress(boxes: DataFrame, page: str = "page", limit: float = DEFAULTS.overlap_iou, fold: int = FOLD) -> DataFrame:
    """The rows of ``boxes`` (page, id, score, x1, y1, x2, y2, ...) that stay.

    One shuffle by page, of boxes alone.  Small pages are folded in the JVM,
    large ones go to numpy; both give the same rows.
    """
    rest = [c for c in boxes.columns if c not in (page, "score", "id", "x1", "y1", "x2", "y2")]
    packed = F.struct("score", "id", "x1", "y1", "x2", "y2", *rest)
    pages = boxes.groupBy(page).agg(F.collect_list(packed).alias("boxes"))
    small = pages.where(F.size("boxes") <= fold).withColumn("boxes", suppress_array(F.col("boxes"), limit))
    large = _by_rows(pages.where(F.size("boxes") > fold), limit)
    return small.unionByName(large).select(page, F.explode("boxes").alias("b")).select(page, "b.*").select(*boxes.columns)


def suppressed(boxes: DataFrame, page: str = "page", limit: float = DEFAULTS.overlap_iou) -> DataFrame:
    """The rows that do not stay."""
    return boxes.join(suppress(boxes, page, limit).select(page, "id"), [page, "id"], "left_anti")


def overlapping_pairs(boxes: DataFrame, page: str = "page", above: float = DEFAULTS.overlap_iou, cell: int = 128) -> DataFrame:
    """(page, a, b, iou) for pairs a < b of a page's boxes with an IoU above ``above`` >= 0.

    Boxes meet in the grid cells that they touch, so a crowded page is spread
    over many tasks; a pair counts in the cell of its intersection's corner only.
    """

    def cells(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / cell), F.floor(high / cell))

    own = boxes.select(page, "id", "x1", "y1", "x2", "y2").withColumn("cx", F.explode(cells(F.col("x1"), F.col("x2")))).withColumn("cy", F.explode(cells(F.col("y1"), F.col("y2"))))
    a, b = own.alias("a"), own.alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (page, "cx", "cy")]
    near = [F.col("a.id") < F.col("b.id"), F.col("a.x1") < F.col("b.x2"), F.col("b.x1") < F.col("a.x2"), F.col("a.y1") < F.col("b.y2"), F.col("b.y1") < F.col("a.y2")]
    corner = [F.floor(F.greatest("a.x1", "b.x1") / cell) == F.col("a.cx"), F.floor(F.greatest("a.y1", "b.y1") / cell) == F.col("a.cy")]
    joined = a.join(b, [*keys, *near, *corner])
    share = iou(F.struct("a.x1", "a.y1", "a.x2", "a.y2"), F.struct("b.x1", "b.y1", "b.x2", "b.y2"))
    return joined.select(F.col(f"a.{page}").alias(page), F.col("a.id").alias("a"), F.col("b.id").alias("b"), share.alias("iou")).where(F.col("iou") > above)


def suppress_spread(boxes: DataFrame, page: str = "page", limit: float = DEFAULTS.overlap_iou) -> DataFrame:
    """The same rows as ``suppress``, for pages with more boxes than one task should hold.

    Overlapping pairs come from grid cells.  In each round the boxes without an
    undecided better neighbour stay, and their neighbours go; what is left comes
    to the next round, by way of shared storage.
    """
    pairs = overlapping_pairs(boxes, page, limit)
    ranked = boxes.select(page, "id", "score")
    a, b = (ranked.select(page, F.col("id").alias(n), F.col("score").alias(f"s{n}")) for n in ("a", "b"))
    pairs = pairs.join(a, [page, "a"]).join(b, [page, "b"])
    first = (F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") > F.col("b")))
    edges = pairs.select(page, F.when(first, F.col("a")).otherwise(F.col("b")).alias("better"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("worse"))
    edges, gone = materialise(edges), None
    while not edges.isEmpty():
        waiting = edges.select(page, F.col("worse").alias("better")).distinct()
        losing = materialise(edges.join(waiting, [page, "better"], "left_anti").select(page, "worse").distinct())
        gone = losing if gone is None else gone.union(losing)
        lost = losing.select(page, F.col("worse").alias("better"))
        # Edges of boxes that stay are settled: their worse ends have just gone.
        before, edges = edges, materialise(edges.join(losing, [page, "worse"], "left_anti").join(lost, [page, "better"], "left_anti"))
        drop(before)
    return boxes if gone is None else boxes.join(gone.withColumnRenamed("worse", "id"), [page, "id"], "left_anti").select(*boxes.columns)
