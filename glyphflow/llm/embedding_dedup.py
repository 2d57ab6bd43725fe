"""Embedding near-duplicates by product quantisation.

Vectors of a label go to coarse inverted lists; a stored vector is its list and
a code per subspace of its residual.  Of two lists the vectors of the one with
the larger number probe the other, and only where a vector that is close enough
may lie (see ``probes``).  Asymmetric table look-ups give the distance from a
probe to each code; what the code's own error cannot explain is dropped, and
exact cosines decide on the rest.

Equal vectors of a label are one class with a weight.  A task holds a block of
one list and streams the probes; it returns counts per vector and links that
join what it met, at most one per vector and probe, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cosines, dimension, materialise, matrix, runs, spread, tidy
from .components import connected_components
from .kmeans import kmeans, nearest

#: Vectors that lists and codes are fitted on, those with the smallest hashes; all vectors are indexed.
SAMPLE, CODE_SAMPLE = 65_536, 16_384
#: Standard deviations that a difference of vectors may have along one direction.
SURE = 5.0
#: Stored vectors of a list that a task holds, and so about what a list should have.
BLOCK = 2048
SUBSPACES, CODES = 8, 256


@dataclass
class Quantiser:
    centres: np.ndarray
    books: np.ndarray  # subspace, code, part of the dimension
    reach: float  # largest distance of unit vectors that are to be linked
    margin: float  # how far beyond the plane between two lists vectors are looked for

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, cosine: float, exact: bool) -> Quantiser:
        """``x``: unit vectors, their dimension padded to a multiple of SUBSPACES."""
        centres = kmeans(x, lists)
        residual = x[:CODE_SAMPLE] - centres[nearest(x[:CODE_SAMPLE], centres)]
        parts = residual.reshape(len(residual), SUBSPACES, -1)
        books = np.stack([kmeans(np.ascontiguousarray(parts[:, s]), CODES, 6) for s in range(SUBSPACES)])
        reach = float(np.sqrt(2 - 2 * cosine))
        return cls(centres, books, reach, reach if exact else reach * min(1.0, SURE / x.shape[1] ** 0.5))

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector from what its code stands for."""
        parts = (x - self.centres[home]).reshape(len(x), SUBSPACES, -1)
        codes = np.stack([nearest(parts[:, s], self.books[s]) for s in range(SUBSPACES)], axis=1)
        back = np.stack([self.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
        return codes, np.sqrt(((parts - back) ** 2).sum(axis=(1, 2)))

    def probes(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which lists up to its own each vector has to probe.

        A vector y of list c is no farther from c's centre than from x's own, so
        y lies beyond the plane half-way between the two.  It can be within reach
        of x only if x's distance from that plane is at most the part of y - x
        that is at right angles to it: the reach at most, and if y - x points
        anywhere, in d dimensions no more than SURE / sqrt(d) of it but with a
        probability of 6e-7.
        """
        d = (x * x).sum(axis=1)[:, None] + (self.centres * self.centres).sum(axis=1) - 2 * (x @ self.centres.T)
        apart = np.sqrt(np.maximum(((self.centres[home][:, None] - self.centres) ** 2).sum(axis=2), 1e-12))
        near = (d - d[np.arange(len(x)), home][:, None]) / (2 * apart) <= self.margin + 1e-6
        return near & (np.arange(len(self.centres)) <= home[:, None])

    def tables(self, x: np.ndarray, home: int) -> np.ndarray:
        """Squared distances from each probe's residual to each code: probe, subspace, code."""
        parts = (x - self.centres[home]).reshape(len(x), SUBSPACES, 1, -1)
        return ((parts - self.books[None]) ** 2).sum(axis=3)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))


class _Block:
    """The stored vectors of one block of a list."""

    def __init__(self, quantiser: Quantiser, home: int, cosine: float, dim: int):
        self.q, self.home, self.cosine, self.dim = quantiser, home, cosine, dim
        self.held: list[pa.RecordBatch] = []
        self.ready = False

    def close(self) -> None:
        table = pa.Table.from_batches(self.held)
        self.ids, self.weight = table["id"].to_numpy(), table["weight"].to_numpy()
        self.x = matrix(table["v"].combine_chunks(), self.dim)[0]
        self.codes, self.error = self.q.encode(_unit(self.x), np.full(len(self.ids), self.home))
        self.counts = np.zeros(len(self.ids), np.int64)
        self.up = np.arange(len(self.ids))
        self.ready = True

    def _join(self, p: np.ndarray, s: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Join stored vectors that meet the same probe; returns the roots that ceased to be, and the root that each probe meets."""
        before = self.up
        while True:
            low = np.full(probes, len(self.up))
            np.minimum.at(low, p, self.up[s])
            up = self.up.copy()
            np.minimum.at(up, self.up[s], low[p])
            while (up[up] != up).any():
                up = up[up]
            if (up == self.up).all():
                return np.flatnonzero((before == np.arange(len(up))) & (up != before)), low
            self.up = up

    def probe(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, n): numbers n of links of a, where b is a; and links, where n is 0.  A vector of this list meets larger ids only."""
        ids, weight, other = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("id", "weight", "home"))
        x = matrix(batch.column(batch.schema.get_field_index("v")), self.dim)[0]
        unit = _unit(x)
        for at in range(0, len(ids), 256):
            part = slice(at, at + 256)
            tables = self.q.tables(unit[part], self.home)
            d = np.zeros((len(tables), len(self.ids)))
            for s in range(SUBSPACES):
                d += tables[:, s, :][:, self.codes[:, s]]
            near = np.sqrt(d) <= self.q.reach + self.error + 1e-6
            near &= (other[part] != self.home)[:, None] | (ids[part][:, None] < self.ids[None])
            p, s = np.nonzero(near)
            if not len(p):
                continue
            linked = np.concatenate([cosines(x[part][p[k : k + 100_000]], self.x[s[k : k + 100_000]]) for k in range(0, len(p), 100_000)]) >= self.cosine
            p, s = p[linked], s[linked]
            if not len(p):
                continue
            self.counts += np.bincount(s, weight[part][p], len(self.ids)).astype(np.int64)
            own = np.bincount(p, self.weight[s], len(tables)).astype(np.int64)
            gone, low = self._join(p, s, len(tables))
            met = np.flatnonzero(own)
            yield ids[part][met], ids[part][met], own[met]
            yield ids[part][met], self.ids[low[met]], np.zeros(len(met), np.int64)
            yield self.ids[gone], self.ids[self.up[gone]], np.zeros(len(gone), np.int64)

    def totals(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.ready:
            own = np.flatnonzero(self.counts)
            yield self.ids[own], self.ids[own], self.counts[own]


def embedding_near_duplicates(df: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", exact: bool = False) -> DataFrame:
    """One row per row of ``df``: the key (an integer), n_links, component_id, kept.

    Vectors are compared if their labels (integers) are equal and not null, and
    linked at a cosine of at least ``cosine`` (above 0).  n_links: other rows
    linked directly; component_id: the smallest key reachable over links, itself
    included; kept: whether that is its own.  Vectors that are null, zero, of
    another length than most, or hold null or non-finite numbers link with
    nothing, and rows with a null key, whose component_id is null.  Rows that
    repeat a key are judged each by its own vector.  Other columns are not read.
    Codes lose no link; probes lose one that points straight from one list's
    centre to another's, and none with ``exact``, which probes more lists.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<float>" if "float" in dict(df.dtypes)[vector] else "array<double>").alias("v"))
    dim = dimension(rows, "v")
    usable = F.col("k").isNotNull() & F.col("label").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    taking = rows.withColumn("h", F.when(F.coalesce(usable, F.lit(False)), F.struct("label", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    classes = taking.where("h is not null").groupBy("h").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("id"), "h", "h.label", "k", "weight", "v"))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    if not most:
        return df.select(F.col(key), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))

    sample = classes.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").toArrow()  # bounded
    unit = _unit(matrix(sample["v"].combine_chunks(), dim)[0])
    lists = int(np.clip(most // BLOCK, 1, SAMPLE // 16))
    fitted = Quantiser.fit(unit, lists, cosine, exact)
    shared = spark.sparkContext.broadcast((fitted.centres, fitted.books, fitted.reach, fitted.margin))  # plain arrays, bounded by lists and codes
    element = dict(classes.dtypes)["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(*shared.value)
        for batch in batches:
            x = _unit(matrix(batch.column(3), dim)[0])
            home = nearest(x, q.centres)
            probed = [np.flatnonzero(p).astype(np.int32) for p in q.probes(x, home)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(probed, pa.list_(pa.int32()))], [*batch.schema.names, "home", "probed"])

    listed = materialise(classes.select("label", "id", "weight", "v").mapInArrow(assign, f"label long, id long, weight long, v {element}, home int, probed array<int>"))
    sizes = listed.groupBy("label", "home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    columns = ["label", "list", "block", "side", "id", "weight", "v", "home"]
    stored = listed.join(sizes, ["label", "home"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumns({"list": F.col("home"), "side": F.lit(0)})
    # Every block of a probed list is probed. The sizes' rows are label and list pairs, far fewer than vectors.
    probing = listed.withColumn("list", F.explode("probed")).join(sizes.withColumnRenamed("home", "list"), ["label", "list"])
    probing = probing.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    both = stored.select(columns).union(probing.select(columns)).repartition("label", "list", "block").sortWithinPartitions("label", "list", "block", "side")

    @tidy
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = None, None

        def out(found):
            found = list(found)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype(np.int64)) for k in range(3)], ["a", "b", "n"])

        for (lab, home, number, side), part in runs(batches, 4):
            if (lab, home, number) != now:
                if block:
                    yield out(block.totals())
                block, now = _Block(Quantiser(*shared.value), home, cosine, dim), (lab, home, number)
            if side == 0:
                block.held.append(part)
                continue
            if not block.ready:
                if not block.held:
                    continue
                block.close()
            yield out(block.probe(part))
        if block:
            yield out(block.totals())

    found = materialise(both.mapInArrow(search, "a long, b long, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("n = 0").select("a", "b"))
    groups = classes.select("id", "h", "k", "weight").join(components, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = groups.where("component is not null").groupBy("c").agg(F.min("k").alias("least"))
    # Classes of one row that is linked with none need no join.
    of = spread(groups.where("component is not null or weight > 1"), least, "c", ["id"], "left").join(counts, "id", "left")
    of = of.select("h", F.coalesce("least", "k").alias("least"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"))
    member = spread(taking.where("h is not null").select("k", "h"), of, "h", ["k"], "left").select("k", "n", "least")
    member = member.union(taking.where("h is null").select("k", F.lit(None).cast("long"), F.lit(None).cast(dict(rows.dtypes)["k"])))
    out = member.select(F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "k").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(key)))
