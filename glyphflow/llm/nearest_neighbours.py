"""Approximate nearest neighbours by stable projections in kd-trees.

Unit vectors are projected to PROJECTED dimensions with Gaussian directions, so
a pair's squared projected distance is its squared distance times a chi-square
variable of that many degrees.  A query takes the projected points one after the
other, nearest first, and verifies their vectors; it stops as soon as a vector
nearer than its k-th best so far would have a projection this far away with a
probability of 1 - CONFIDENCE at most.

The top of one kd-tree, fitted on a bounded sample, cuts the projected space
into cells; a cell's vectors, in blocks of bounded size, have trees of their own.
A query is first answered in a block of its own cell.  With the k-th best that it
finds there it goes on only to the cells, and within them to the points, that
the same test doesn't rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cosines, dimension, materialise, matrix, ragged, runs, spread, tidy

PROJECTED = 24
CONFIDENCE = 0.9
LEAF = 128
#: Numbers in the vectors that a task indexes, and in those that the top tree is fitted on.
BLOCK = 1 << 22
#: Sampled vectors to a cell, at least.
FINEST = 64
#: Projected points that are verified before the first test; between later tests there are twice as many.
STEP = 64


def chi_square(x: float, degrees: int) -> float:
    """The distribution function, for an even number of degrees."""
    term = total = 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


class Cells:
    """The top of a kd-tree: a region of projected space for each cell."""

    def __init__(self, points: np.ndarray, cells: int):
        self.low = np.full((1, PROJECTED), -np.inf)
        self.high = np.full((1, PROJECTED), np.inf)
        self.splits: list[tuple[int, int, float]] = []  # cell, axis, value: what is above goes to a new cell
        rows = [np.arange(len(points))]
        while len(rows) < cells:
            cell = max(range(len(rows)), key=lambda c: len(rows[c]))
            own = points[rows[cell]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            value = float(np.median(own[:, axis])) if len(own) else 0.0
            above = own[:, axis] > value
            if not above.any():  # all alike
                break
            self.splits.append((cell, axis, value))
            rows.append(rows[cell][above])
            rows[cell] = rows[cell][~above]
            self.low, self.high = np.vstack([self.low, self.low[cell]]), np.vstack([self.high, self.high[cell]])
            self.high[cell, axis] = self.low[-1, axis] = value

    def __len__(self) -> int:
        return len(self.low)

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for k, (cell, axis, value) in enumerate(self.splits):
            out[(out == cell) & (points[:, axis] > value)] = k + 1
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point from each cell's region."""
        return np.stack([(np.maximum(0, np.maximum(low - points, points - high)) ** 2).sum(axis=1) for low, high in zip(self.low, self.high)], axis=1)


class Tree:
    """A kd-tree over projections: rows in the order of its leaves, and each leaf's box."""

    def __init__(self, points: np.ndarray):
        self.rows = np.arange(len(points))
        cuts = [(0, len(points))]
        leaves = []
        while cuts:
            a, b = cuts.pop()
            own = points[self.rows[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            axis = int(np.argmax(high - low))
            if b - a <= LEAF or high[axis] <= low[axis]:
                leaves.append((a, b, low, high))
                continue
            middle = (b - a) // 2
            self.rows[a:b] = self.rows[a:b][np.argpartition(own[:, axis], middle)]
            cuts += [(a, a + middle), (a + middle, b)]
        self.begin, self.end = (np.array([leaf[k] for leaf in leaves]) for k in (0, 1))
        self.low, self.high = (np.stack([leaf[k] for leaf in leaves]) for k in (2, 3))
        self.points = np.ascontiguousarray(points[self.rows])
        self.squares = np.einsum("ij,ij->i", self.points, self.points)

    def nearer(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows and their squared distances from ``q``, in portions each of which is nearer than the next; and a distance below which none is left.

        Leaves are opened in the order of their boxes' distances, ever more at
        once; a point comes out when no unopened leaf can hold a nearer one.
        """
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        far = (gap * gap).sum(axis=1)
        order = np.argsort(far, kind="stable")
        at, d, opened, more = np.zeros(0, np.int64), np.zeros(0), 0, 8
        while opened < len(order):
            some = order[opened : opened + more]
            opened, more = opened + more, more * 4
            own = ragged(self.begin[some], self.end[some] - self.begin[some])
            at, d = np.append(at, own), np.append(d, self.squares[own] - 2 * (self.points[own] @ q) + q @ q)
            frontier = float(far[order[opened]]) if opened < len(order) else np.inf
            out = d <= frontier
            if out.any():
                yield self.rows[at[out]], d[out], frontier
                at, d = at[~out], d[~out]


class Index:
    """The vectors of a block: equal ones are one, with their smallest ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, directions: np.ndarray):
        """``ids``: a row of ids for each vector, smallest first, filled up with -1."""
        order = np.argsort(ids[:, 0], kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.unit = self.x / np.sqrt((self.x * self.x).sum(axis=1))[:, None]
        self.tree = Tree(self.unit @ directions) if len(self.ids) else None
        self.directions = directions

    def search(self, x: np.ndarray, k: int, most: float, worst: float = -2.0) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest of this block whose cosine is at least ``worst``, nearest first, ties by id; ids, cosines, vectors verified."""
        best_ids, best, verified = np.zeros(0, np.int64), np.zeros(0), 0
        if self.tree is None:
            return best_ids, best, 0
        unit = x / np.sqrt(x @ x)
        step = STEP
        for rows, d, frontier in self.tree.nearer(unit @ self.directions):
            while len(rows):
                within = d <= most * max(0.0, 2 - 2 * worst) + 1e-9
                rows, d = rows[within], d[within]
                cut = np.argpartition(d, step) if len(d) > step else np.arange(len(d))
                some, rows, d = rows[cut[:step]], rows[cut[step:]], d[cut[step:]]
                step = min(2 * step, 4096)
                verified += len(some)
                near = some[(self.unit[some] @ unit) >= worst - 1e-9]
                if not len(near):
                    continue
                score = np.repeat(cosines(self.x[near], np.broadcast_to(x, (len(near), len(x)))), self.ids.shape[1])
                ids = self.ids[near].ravel()
                ids, score = np.append(best_ids, ids[ids >= 0]), np.append(best, score[ids >= 0])
                order = np.lexsort((ids, -score))[:k]
                best_ids, best = ids[order], score[order]
                if len(best) == k:
                    worst = max(worst, best[-1])
            if frontier > most * max(0.0, 2 - 2 * worst):
                break
        return best_ids, best, verified


def _usable(vector: str, dim: int) -> Column:
    right = (F.size(vector) == dim) & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(vector, lambda e: e != 0)
    return F.coalesce(right, F.lit(False))


def _equal(rows: DataFrame, most: int) -> DataFrame:
    """(h, h2, ids, v): the smallest ``most`` ids of each vector; what lies beyond them is cut before the shuffle."""
    order = Window.partitionBy("h", "h2").orderBy("id")
    first = rows.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return first.groupBy("h", "h2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row of ``queries`` its k nearest rows of ``df`` by cosine, less those with its own key.

    Both tables have the key (an integer, not negative) and the vector.  Rows
    with a null key and vectors that are null, zero, of another length than most
    of ``df``'s, or hold null or non-finite numbers take no part, as queries or
    as neighbours.  Equal scores go by key.  A query gets fewer than k rows if
    there are no more.  Keys may repeat: of a key's equal rows one counts, and a
    query's own key is never its neighbour; a key that queries repeat with other
    vectors gets the nearest of all of them.  Equal vectors are searched, and are
    searched for, once.  Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    dim = dimension(rows, "v")
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    directions = np.random.default_rng(seed).standard_normal((dim, PROJECTED))
    most, block = chi_square_quantile(CONFIDENCE, PROJECTED), max(FINEST, BLOCK // dim)
    # One more than k, for a query's own key is among the nearest.
    stored = materialise(_equal(rows.where(_usable("v", dim)), k + 1).select("ids", "v"))
    shown = asked.where(_usable("v", dim)).withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    groups = materialise(_equal(asked.where(_usable("v", dim)), 1).select(F.monotonically_increasing_id().alias("q"), "h", "h2", "v"))

    vectors = stored.count()
    sample = stored.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(block).select("v").toArrow()  # bounded
    x = matrix(sample["v"].combine_chunks(), dim)[0]
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    cells = Cells(x @ directions, min(-(-vectors // block), max(1, len(x) // FINEST)))
    element = dict(stored.dtypes)["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)[0]
            unit = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(cells.home(unit @ directions).astype(np.int32)), *batch.columns], ["cell", *batch.schema.names])

    placed = stored.mapInArrow(assign, f"cell int, ids array<long>, v {element}")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()} if len(cells) > 1 else {0: vectors}  # a row per cell
    parts = np.array([-(-sizes.get(c, 0) // block) for c in range(len(cells))])
    of = F.array(*map(F.lit, np.maximum(parts, 1).tolist()))
    columns = ["cell", "part", "side", "q", "worst", "ids", "v"]
    held = placed.select("cell", F.pmod(F.xxhash64(F.col("ids")[0]), F.get(of, "cell")).cast("int").alias("part"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("q"), F.lit(-2.0).alias("worst"), "ids", "v")

    def ask(sent: DataFrame) -> DataFrame:
        """(q, ids, scores) of queries (cell, part, q, worst, v) in their blocks."""
        nothing = F.array().cast("array<long>").alias("ids")
        both = held.union(sent.select("cell", "part", F.lit(1).alias("side"), "q", "worst", nothing, "v"))
        both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "side")

        @tidy
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data, now, index = [], None, None
            for (cell, part, side), own in runs(batches, 3):
                if (cell, part) != now:
                    data, now, index = [], (cell, part), None
                if side == 0:
                    data.append(own.select(["ids", "v"]))
                    continue
                if not data:
                    continue
                if index is None:
                    table = pa.Table.from_batches(data)
                    lists = table["ids"].combine_chunks()
                    many = np.diff(lists.offsets.to_numpy())
                    ids = np.full((len(lists), k + 1), -1, np.int64)
                    ids[np.arange(k + 1) < many[:, None]] = lists.flatten().to_numpy()
                    index = Index(ids, matrix(table["v"].combine_chunks(), dim)[0], directions)
                    data = [data[0].slice(0, 0)]
                x = matrix(own.column(6), dim)[0]
                worst = own.column(4).to_numpy()
                found = [index.search(x[i], k + 1, most, worst[i])[:2] for i in range(own.num_rows)]
                yield pa.RecordBatch.from_arrays([own.column(3), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())), own.column(6)], ["q", "ids", "scores", "v"])

        return both.select(*columns).mapInArrow(search, f"q long, ids array<long>, scores array<double>, v {element}")

    homes = groups.select("q", "v").mapInArrow(assign, f"cell int, q long, v {element}")
    first = ask(homes.select("cell", F.pmod(F.xxhash64("q"), F.get(of, "cell")).cast("int").alias("part"), "q", F.lit(-2.0).alias("worst"), "v"))
    found = first
    if parts.sum() > 1:
        first = materialise(first)

        def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(3), dim)[0]
                points = (x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]) @ directions
                home, far = cells.home(points), cells.distances(points)
                worst = np.array([s[k] if len(s) > k else -2.0 for s in batch.column(2).to_pylist()])
                row, cell = np.nonzero((far <= (most * np.maximum(0, 2 - 2 * worst))[:, None]) & (parts > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), *(batch.column(c).take(pa.array(row)) for c in (0, 3)), pa.array(worst[row])], ["cell", "home", "q", "v", "worst"]
                )

        sent = first.mapInArrow(further, f"cell int, home boolean, q long, v {element}, worst double")
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(of, "cell") - 1)))
        seen = F.col("home") & (F.col("part") == F.pmod(F.xxhash64("q"), F.get(of, "cell")))
        found = first.union(ask(sent.where(~seen)))
    each = found.select("q", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("q", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = [F.desc("score"), "vec_id"]
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1)
    nearest = each.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("nearest"))
    named = groups.select("q", "h", "h2").join(nearest, "q").withColumn("hash", F.struct("h", "h2")).select("hash", "nearest")
    answers = spread(shown.select("id", F.struct("h", "h2").alias("hash")), named, "hash", ["id"])
    answers = answers.select(F.col("id").alias("query_id"), F.explode("nearest").alias("n")).select("query_id", "n.vec_id", "n.score").where("vec_id <> query_id").distinct()
    best = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
