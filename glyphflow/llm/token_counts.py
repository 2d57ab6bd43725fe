"""Token counts by rank-synchronous array merging.

A batch's distinct pre-tokens are held as ragged numpy arrays of symbol ids.
In each round every sequence applies its lowest-rank pair at the same time,
whatever its length; what survives is counted.  Nothing is shuffled: a
document's count depends on its own text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import merge_ragged
from .common import chunks, kept, slices, tidy
from .pieces import Pieces, irregular, marked, runs


class Counter:
    """Counts tokens with one vocabulary."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.pairs = self.pieces.pairs()
        top = max(map(ord, (p for p in self.pieces.id if len(p) == 1))) + 1
        self.char = np.full(top + 1, -1, np.int32)
        for p, i in self.pieces.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def merged(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, from their code points; a character outside the vocabulary counts as its UTF-8 bytes."""
        ids = self.char[np.minimum(points, len(self.char) - 1)]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        lost = ids < 0
        size = 1 + (points[lost] >= 0x80) + (points[lost] >= 0x800) + (points[lost] >= 0x10000)
        extra = np.bincount(owner[lost], weights=size - 1, minlength=len(lengths)).astype(np.int64)
        return merge_ragged(ids, lengths, self.pairs)[1] + extra

    def documents(self, texts: pa.Array) -> np.ndarray:
        offsets, codes, distinct = chunks(texts)
        total = np.zeros(len(texts), np.int64)
        if not len(codes):
            return total
        ends = np.append(0, np.cumsum(self.merged(*marked(distinct))[codes]))
        total = ends[offsets[1:]] - ends[offsets[:-1]]
        odd = irregular(distinct)
        if odd.any():
            held = np.append(0, np.cumsum(odd[codes]))
            for i in np.flatnonzero(held[offsets[1:]] > held[offsets[:-1]]):
                cut = runs(texts[i].as_py())
                own = np.frombuffer("".join(cut).encode("utf-32-le"), np.uint32)
                total[i] = int(self.merged(own, np.fromiter(map(len, cut), np.int64, len(cut))).sum())
        return total


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``df``: the key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text is taken as empty: 0 bytes, 0 tokens.  Whole texts are counted
    however long; repeated rows are counted each.  Other columns are not read.
    ``path``: a merge-type SentencePiece vocabulary, at the same place on all executors.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                counter = kept(("counter", path), lambda: Counter(path))
                lengths = pa.compute.binary_length(part.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), lengths, pa.array(counter.documents(part.column(1)))], ["k", "n_bytes", "n_tokens"])

    kind = dict(rows.dtypes)["k"]
    out = rows.mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
