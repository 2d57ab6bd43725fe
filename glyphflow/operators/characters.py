"""Characters of texts, counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_CODES = 0x110000
_SLICE = 1 << 20  # characters that are numbers at a time


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """The texts of the first column, joined or cut to slices of bounded length."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py() or ""
            for at in range(0, len(text), _SLICE):
                held.append(text[at : at + _SLICE])
                size += len(held[-1])
                if size >= _SLICE:
                    yield "".join(held)
                    held, size = [], 0
    yield "".join(held)


def character_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(ch, n): every character of the texts and how often it occurs; a task holds a slice of its texts and a number per character, and a row per different character is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CODES, np.int64)
        for part in _slices(batches):
            total += np.bincount(np.frombuffer(part.encode("utf-32-le"), np.uint32), minlength=_CODES)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in codes], pa.string()), pa.array(total[codes], pa.int64())], ["ch", "n"])

    return df.select(text).mapInArrow(count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))
