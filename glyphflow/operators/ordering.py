"""Reading order of a page's boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS

#: Boxes of a page up to which the fold over arrays is used; it copies the array for each box.
FOLD = 16


def order_array(boxes: Column, line: int = DEFAULTS.same_line) -> Column:
    """An array<struct<y, x, ord, ...>> in reading order.

    Boxes come by (y, x, ord).  Each is put right behind the last one before it
    that it must not pass; it may pass one on the same line (less than ``line``
    apart in y) that lies farther right.  The relation is not transitive, so
    this cannot be a sort by rows of text.
    """

    def place(done: Column, b: Column) -> Column:
        stops = F.transform(done, lambda e, i: F.when((F.abs(b["y"] - e["y"]) < line) & (b["x"] < e["x"]), 0).otherwise(i + 1))
        # Bound once: the position would otherwise be computed in each use.
        at = F.transform(F.array(F.coalesce(F.array_max(stops), F.lit(0))), lambda p: F.concat(F.slice(done, 1, p), F.array(b), F.slice(done, p + 1, F.size(done))))
        return at[0]

    return F.aggregate(F.array_sort(boxes), F.filter(boxes, lambda b: F.lit(False)), place)


def order_rows(x: np.ndarray, y: np.ndarray, order: np.ndarray, line: int = DEFAULTS.same_line) -> list[int]:
    """Rows in the order that ``order_array`` gives."""
    done: list[int] = []
    for k in np.lexsort((order, x, y)).tolist():
        at = len(done)
        while at and abs(y[k] - y[done[at - 1]]) < line and x[k] < x[done[at - 1]]:
            at -= 1
        done.insert(at, k)
    return done


def _by_rows(pages: DataFrame, line: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                own = batch.column(0)[i].values
                x, y, order = (own.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "ord"))
                out.append(own.take(pa.array(order_rows(x, y, order, line))))
            if out:
                offsets = pa.array(np.append(0, np.cumsum([len(o) for o in out])).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.concat_arrays(out))], ["boxes"])

    return pages.mapInArrow(run, pages.schema)


def reading_order(boxes: DataFrame, page: str = "page", x: str = "x1", y: str = "y1", order: str = "id", line: int = DEFAULTS.same_line, fold: int = FOLD) -> DataFrame:
    """``boxes`` with box_idx, its place (from 0) on the page; ties of corner go by ``order``. One shuffle by page.

    The order within a page is sequential by definition, so a page is one task's work.
    """
    packed = F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.col(order).alias("ord"), F.struct(*boxes.columns).alias("row"))
    pages = boxes.groupBy(page).agg(F.collect_list(packed).alias("boxes")).select("boxes")
    small = pages.where(F.size("boxes") <= fold).select(order_array(F.col("boxes"), line).alias("boxes"))
    large = _by_rows(pages.where(F.size("boxes") > fold), line)
    return small.unionByName(large).select(F.posexplode("boxes").alias("box_idx", "b")).select("b.row.*", "box_idx")
