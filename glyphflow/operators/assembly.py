"""Batches of crops, result rows per image, and agreement of two results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS, Settings
from glyphflow.functions.geometry import recogniser_width
from glyphflow.functions.text import is_blank, passes_score
from glyphflow.schema import ITEM


def recogniser_batches(crops: DataFrame, page: str = "page", order: str = "box_idx", ratio: str = "ratio", s: Settings = DEFAULTS) -> DataFrame:
    """``crops`` with batch_no, img_w and resized_w: batches of a page's crops in order share the width of the widest."""
    numbered = crops.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(page).orderBy(order)) - 1) / s.rec_batch).cast("int"))
    widest = F.max(ratio).over(Window.partitionBy(page, "batch_no"))
    whole, own = recogniser_width(F.col(ratio), widest, s)
    return numbered.withColumns({"img_w": whole, "resized_w": own})


def text_filter(items: DataFrame, text: str = "text", score: str = "score", least: float = DEFAULTS.drop_score) -> DataFrame:
    return items.where(passes_score(F.col(score), least) & ~is_blank(F.col(text)))


def assemble(images: DataFrame, boxes: DataFrame, texts: DataFrame, angles: DataFrame | None = None, page: str = "page", least: float = DEFAULTS.drop_score) -> DataFrame:
    """One row per image: page, text_count, items in reading order; an image without text has an empty list.

    boxes: page, box_idx, polygon; texts: page, box_idx, text, score; angles:
    page, box_idx, angle (0 where there is none).
    """
    keys = [page, "box_idx"]
    rows = boxes.select(*keys, "polygon").join(text_filter(texts, least=least).select(*keys, "text", "score"), keys)
    rows = rows.join(angles.select(*keys, "angle"), keys, "left") if angles is not None else rows.withColumn("angle", F.lit(0))
    item = F.struct("box_idx", F.struct("text", F.col("score").cast("double").alias("score"), F.col("polygon").cast("array<array<int>>").alias("polygon"), F.coalesce("angle", F.lit(0)).cast("int").alias("angle")).alias("item"))
    lists = rows.groupBy(page).agg(F.array_sort(F.collect_list(item)).alias("_i")).select(page, F.transform("_i", lambda x: x["item"]).alias("items"))
    empty = F.array().cast(f"array<{ITEM.simpleString()}>")
    found = images.select(page).distinct().join(lists, page, "left").withColumn("items", F.coalesce("items", empty))
    return found.select(page, F.size("items").alias("text_count"), "items")


def token_jaccard(left: DataFrame, right: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, common, either, jaccard) of the distinct words of two tables' texts of a key; 1 if neither has any."""

    def words(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key), F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n]+"), lambda w: w != "")).alias(name))

    both = words(left, "a").join(words(right, "b"), key)
    common = F.size(F.array_intersect("a", "b")).cast("long")
    sized = both.select(key, common.alias("common"), (F.size("a") + F.size("b") - common).cast("long").alias("either"))
    return sized.withColumn("jaccard", F.when(F.col("either") > 0, F.col("common") / F.col("either")).otherwise(F.lit(1.0)))
