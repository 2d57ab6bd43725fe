"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

What a sequence holds depends on lengths alone, so the plan is made from the
histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus):
each bin is filled greedily, then its smallest document is replaced by two
unpacked ones that fit the expanded gap more tightly.  A bin that repeats is
planned once with its multiplicity.  Every piece then finds its place by its
rank among the pieces of its length; ranks come from counts per block, so no
task sees more than one block of a length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialise, slices, tidy
from .word_tokenizer import WordTokenizer

#: Pieces of one length that a task ranks, about.
BLOCK = 200_000


def _tight_pair(counts: np.ndarray, below: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum of at most ``room``."""
    first = np.flatnonzero(counts[: room + 1])
    if not len(first):
        return None
    other = below[room - first]
    same = (other == first) & (counts[first] < 2)
    other = np.where(same, below[np.maximum(first - 1, 0)], other)
    total = np.where(other > 0, first + other, 0)
    best = int(np.argmax(total))
    return (int(first[best]), int(other[best])) if total[best] else None


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: copies in each}) for ``counts[length]`` pieces of each length up to ``capacity``."""
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    left[0] = 0
    plan = []
    index = np.arange(capacity + 1)

    def largest(now: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(now > 0, index, 0))

    def fill(held: Counter, gap: int, now: np.ndarray, below: np.ndarray) -> tuple[int, np.ndarray]:
        while gap and (size := int(below[gap])):
            copies = min(int(now[size]), gap // size)
            held[size] += copies
            now[size] -= copies
            gap -= copies * size
            if not now[size]:
                below = largest(now)
        return gap, below

    while left.any():
        now, held = left.copy(), Counter()
        gap, below = fill(held, capacity, now, largest(left))
        if gap and (pair := _tight_pair(now, below, gap + (small := min(held)))) and sum(pair) > small:
            held[small] -= 1
            now[small] += 1
            for size in pair:
                held[size] += 1
                now[size] -= 1
            gap, _ = fill(held, gap + small - sum(pair), now, largest(now))
        held = {size: n for size, n in held.items() if n}
        times = min(int(left[size]) // n for size, n in held.items())
        for size, n in held.items():
            left[size] -= times * n
        plan.append((times, held))
    return plan


def _slots(plan: list[tuple[int, dict[int, int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """The plan by length: keys (length * 2^40 + first rank), sorted; first sequence, copies in each bin, first offset."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for times, held in plan:
        offset = 0
        for size in sorted(held, reverse=True):
            rows.append((size << 40 | int(used[size]), sequence, held[size], offset))
            used[size] += times * held[size]
            offset += size * held[size]
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True))


def document_pieces(df: DataFrame, path: str, capacity: int, key: str, text: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces of at most ``capacity``: key, piece, start, length, ids_crc32[, ids]."""
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    tail = np.array([end_id], "<u4").tobytes()
    names = ["k", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                tokens = kept(("words", path), lambda: WordTokenizer(path))
                data, ends = tokens.documents(part.column(1))
                whole, owner, piece, start, length, crc, ids = ends.tolist(), [], [], [], [], [], []
                for r in range(part.num_rows):
                    begin, n = whole[r], whole[r + 1] - whole[r] + 1
                    for k, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        own = data[4 * (begin + at) : 4 * (begin + min(at + size, n - 1))]
                        own = own if at + size < n else bytes(own) + tail
                        owner.append(r), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], names)

    kind = dict(rows.dtypes)["k"]
    return rows.mapInArrow(cut, f"k {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A document is its ids and ``end_id``; only one of over ``capacity`` ids is
    cut.  A null text is taken as empty and is packed as its end id alone;
    repeated rows are packed each; an empty table gives no rows.  Other columns
    are not read.
    """
    spark = df.sparkSession
    pieces = materialise(document_pieces(df, path, capacity, key, text, end_id, with_ids))
    histogram = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["count"]
    plan = plan_bins(counts, capacity)
    slots = spark.sparkContext.broadcast(_slots(plan, capacity) if plan else ())

    blocks = int(max(64, counts.max() // BLOCK + 1))
    pieces = pieces.withColumn("b", F.pmod(F.xxhash64("k", "piece"), F.lit(blocks)).cast("int"))
    per_block = pieces.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select("length", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "b").orderBy("k", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(within)).join(bases, ["length", "b"])
    extra = ["ids"] * with_ids
    ranked = ranked.select("k", "piece", "start", "length", "ids_crc32", *extra, (F.col("base") + F.col("r") - 1).alias("r"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, first, copies, offset = slots.value
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "r"))
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            bin_of, slot = np.divmod(rank - (keys[at] & (1 << 40) - 1), copies[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[at] + bin_of), pa.array(offset[at] + slot * length)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in ranked.drop("r").dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").withColumnRenamed("k", key)
