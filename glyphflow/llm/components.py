"""Connected components of links, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, drop, materialise, spread

#: Links from which the hub of a star is spread over this many times SALTS tasks.
MANY, TIMES = 10_000_000, 16


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of ``links`` (two columns of ids); component is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris and others, 2014):
    every step points nodes at the smallest neighbour, and the edges become
    stars.  A node's smallest neighbour is aggregated before the shuffle, and
    only nodes that have a smaller one send it on, to several tasks by the other
    end of the link, so the links of a star's centre are spread over these.
    Each round is written to shared storage, the round before it is deleted, and
    the driver sees a count and a checksum only.  Links with a null end and
    links of a node with itself count for nothing.
    """
    a, b = links.columns
    now = materialise(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    salts = SALTS * (TIMES if seen[0] > MANY else 1)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        smaller = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
        large = spread(both.where("v > u"), smaller, "u", ["v"], "left", salts).select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
        nearest = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        found = nearest.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        last, before = now, seen
        now = materialise(found.select("e.*").where("u != v").distinct())
        seen = mark(now)
        drop(last)
        if before == seen:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
