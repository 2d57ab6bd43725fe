"""Character dictionaries and allowed sets: text files with a character per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.text import strip


def character_dictionary(spark: SparkSession, path: str) -> list[str]:
    """"blank", then each line, stripped; empty lines keep their places, since a line's number is its class.

    The file is read whole: a dictionary has some ten thousand lines, and their order counts.
    """
    rows = spark.read.text(path, wholetext=True).collect()
    if not rows:
        return ["blank"]
    lines = rows[0][0].split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return ["blank", *(line.strip() for line in lines)]


def distinct_stripped(lines: DataFrame, line: str = "value") -> DataFrame:
    """(ch): the lines, stripped, each once, without empty ones."""
    return lines.select(strip(F.col(line)).alias("ch")).where("ch <> ''").distinct()


def allowed_characters(spark: SparkSession, path: str) -> DataFrame:
    """(ch): distinct stripped lines of a file that are not empty."""
    return distinct_stripped(spark.read.text(path))
