"""What the operators of this subpackage share: tables, shared storage, batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from glyphflow.storage import drop, materialise  # noqa: F401 (for the operators)

#: Bytes of text that a Python worker handles at once, so that its memory
#: doesn't depend on how many rows Spark puts into an Arrow batch.
SLICE_BYTES = 3 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Tasks over which a hot key of a join is spread.
SALTS = 16


def spread(left: DataFrame, right: DataFrame, on: str, by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right``, which has each key once; a key's rows in ``left`` go to ``salts`` tasks, by the columns ``by``.

    ``right`` is sent ``salts`` times, so it should be the smaller by far.
    """
    from pyspark.sql import functions as F

    (salt,) = fresh(left.limit(0).join(right.limit(0), on), "salt")
    many = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(many, [on, salt], how).drop(salt)


def kept(name: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives; a Python worker keeps one such thing between its tasks, until another name is asked for.

    Functions come to workers by value, so a module of the worker's own holds it.
    """
    held = sys.modules.setdefault("_held_by_this_worker", types.ModuleType("_held_by_this_worker"))
    if getattr(held, "name", None) != name:
        held.name = held.thing = None
        held.thing = make()
        held.name = name
    return held.thing


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes in the string column number ``text``, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def one_thread() -> None:
    """A task has one core: more threads in its linear algebra would only wait for each other."""
    try:
        with open("/proc/self/maps") as f:
            libraries = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in libraries:
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            setter = getattr(ctypes.CDLL(path), name, None)
            if setter is not None:
                setter(1)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task's function that uses one core, and gives freed memory back to the system at its end: a Python worker outlives its tasks."""

    @wraps(run)
    def whole(*args, **kwargs):
        one_thread()
        try:
            yield from run(*args, **kwargs)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts cut at U+0020: offsets of each text's chunks, each chunk's code, and the distinct chunks by code."""
    cut = pc.split_pattern(texts, " ")
    offsets = cut.offsets.to_numpy()
    coded = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns (integers, no nulls), from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(columns[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that cut no run of rows that agree in the first ``keys`` columns."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_numpy() for k in range(keys)]
        last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        if len(last):
            at = int(last[-1]) + 1
            yield table.slice(0, at)
            held, n = table.slice(at).to_batches(), n - at
    if n:
        yield pa.Table.from_batches(held)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Slices of batches whose rows agree in the first ``keys`` columns, with those values; a long run comes in several slices."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(columns[a].tolist()), batch.slice(a, b - a)


def dimension(df: DataFrame, column: str) -> int:
    """The most frequent length of an array column, the smallest of several; 0 if there is none."""
    from pyspark.sql import functions as F

    found = df.where(F.size(column) > 0).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as float64 rows, and which of them are usable: ``dim`` finite numbers, not all zero; others are zero rows."""
    out = np.zeros((len(column), dim))
    right = pc.equal(pc.list_value_length(column), dim).fill_null(False).to_numpy(zero_copy_only=False)
    if right.any():
        values = column.filter(pa.array(right)).flatten()
        out[right] = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore"):
        norm = np.einsum("ij,ij->i", out, out)
    good = np.isfinite(norm) & (norm > 0)
    out[~good] = 0
    return out, good


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision; a pair's value depends on its own numbers alone."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
