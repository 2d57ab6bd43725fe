"""Progress and totals of a run, without another pass over the results."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

R = TypeVar("R")


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """Results that count themselves as they are written: images, texts, empty_images in the observation's ``get``."""
    totals = Observation(f"totals_{uuid.uuid4().hex}")
    empty = F.count_if(F.col("text_count") == 0)
    return results.observe(totals, F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("text_count"), F.lit(0)).alias("texts"), empty.alias("empty_images")), totals


def progress_line(place: int, number: int, path: str, texts: int) -> str:
    return f"[{place}/{number}] {path.rsplit('/', 1)[-1]}: {texts} texts"


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with i, the place in its group from 1, and n, the group's number of rows, as progress lines show them."""
    own = Window.partitionBy(group)
    return rows.withColumns({"i": F.row_number().over(own.orderBy(order)).cast("long"), "n": F.count(F.lit(1)).over(own).cast("long")})


def watched(spark: SparkSession, action: Callable[[], R], report: Callable[[int, int], None], seconds: float = 1.0) -> R:
    """Runs ``action`` and calls ``report(tasks done, tasks known)`` meanwhile and at its end.

    Tasks take the place of images here: they are what a cluster finishes, in no
    particular order.
    """
    group, over = f"run_{uuid.uuid4().hex}", threading.Event()
    spark.sparkContext.setJobGroup(group, "glyphflow")
    tracker = spark.sparkContext.statusTracker()

    def state() -> tuple[int, int]:
        done = known = 0
        for job in tracker.getJobIdsForGroup(group):
            found = tracker.getJobInfo(job)
            for stage in found.stageIds if found else ():
                info = tracker.getStageInfo(stage)
                if info:
                    done, known = done + info.numCompletedTasks, known + info.numTasks
        return done, known

    def loop() -> None:
        while not over.wait(seconds):
            report(*state())

    thread = threading.Thread(target=loop, daemon=True)
    thread.start()
    try:
        return action()
    finally:
        over.set()
        thread.join()
        report(*state())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
