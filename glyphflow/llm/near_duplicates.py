"""Near-duplicate documents by HyperMinHash.

1. One pass over the texts gives each document the digest of its shingle set,
   its HyperMinHash registers and the keys of its bands.  Documents with equal
   sets become one class.
2. Members of a key are paired with its first class.  Pairs whose
   collision-corrected estimate is not surely below the threshold (see
   ``floors``) join a cluster.  Where all members of a key join its first, no
   other pair of it is needed; where any is rejected, blocks of the key's
   members meet in tasks of their own, and every pair that is not in one cluster
   yet is estimated.
3. Within a cluster, full shingle sets decide.  Members meet in blocks, each
   with the cluster's leader; a pair that is linked already through others is
   passed over, so a task's links are at most as many as its members.  Of a
   cluster of several blocks, only members that this did not link to the leader
   meet the other blocks.
4. Connected components of the links.

Sets of up to SMALL shingles, for which a sketch says little, also meet through
their first shingles in hash order: two sets at the threshold share one of them
(prefix filtering).  Larger ones at the threshold share no band with a
probability of about 1e-7.  All pairs of a key are candidates, so beyond that a
pair is missed only if its estimate is five standard errors off.  n members of a
key that are all unlike cost n * n / 2 estimates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, grouped, materialise, slices, spread, tidy, whole_groups
from .components import connected_components
from .hyperminhash import ROWS, band_keys, bands_for, corrected, digest, mix, registers, shares, shingle_sets

SMALL = 32
#: Standard errors that an estimate may be off.
SURE = 5.0
#: Members of a cluster, and shingles, that a task holds of either side, about.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Members of a key that a task holds of either side; only registers are held of these.
KEY_BLOCK = 1024
#: Rows of keys' members that are compared together.
GATHER = 4096
#: Links of a cluster that one task joins.
MOST = 500_000


def floors(held: np.ndarray, threshold: float) -> np.ndarray:
    """The least estimate, from so many registers in use, of a pair that may be at the threshold."""
    return threshold - SURE * np.sqrt(threshold * (1 - threshold) / np.maximum(held, 1))


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of sketches that are not surely below the threshold."""
    share, held = shares(a, b)
    floor = floors(held, threshold)
    out = (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9) & (share >= floor)
    some = np.flatnonzero(out)  # the estimate is never above the share
    out[some] = corrected(share[some], na[some], nb[some], a.shape[1]) >= floor[some]
    return out


def _signatures(rows: DataFrame, words: int, over: int, under: int) -> DataFrame:
    bands = bands_for(over / under)
    reach = SMALL * under // over

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                hashes, sizes = shingle_sets(part.column(2), words)
                regs = registers(hashes, sizes, bands * ROWS)
                keys = band_keys(regs).astype(np.int64)
                ends = np.cumsum(sizes)
                digests, joined = [], []
                for i, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                    own = hashes[end - n : end]
                    digests.append(digest(own))
                    of = keys[i][keys[i] != 0] if n > SMALL else keys[i][:0]
                    if 0 < n <= reach:
                        first = mix(own[: n - -(-over * n // under) + 1] ^ np.uint64(0x5555555555555555)).astype(np.int64)
                        of = np.concatenate([of, first])
                    joined.append(of)
                data = [r.tobytes() for r in regs]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(data, pa.binary()), pa.array(joined, pa.list_(pa.int64()))],
                    ["k", "x", "n", "h", "regs", "keys"],
                )

    return rows.mapInArrow(sign, f"k {dict(rows.dtypes)['k']}, x long, n long, h binary, regs binary, keys array<long>")


def _stacked(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _cluster_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that join the members of a key that may be in one cluster."""
    # A hot key's rows are numbers only; Spark splits such joins where they are large.
    keys = classes.select("id", F.explode("keys").alias("key")).distinct()
    leads = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1")
    led = materialise(spread(keys, leads, "key", ["id"]).where("id != lead").select("key", "lead", "id", "members"))
    of = classes.select("id", "n", "regs")
    first = led.select("lead").distinct().join(of.select(F.col("id").alias("lead"), F.col("n").alias("n2"), F.col("regs").alias("regs2")), "lead")
    both = spread(led.select("lead", "id").distinct().join(of, "id"), first, "lead", ["id"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_stacked(batch.column(k).to_pylist()) for k in (3, 5))
            near = may_link(a, b, batch.column(2).to_numpy(), batch.column(4).to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], ["a", "b", "near"])

    met = materialise(both.select("lead", "id", "n", "regs", "n2", "regs2").mapInArrow(close, "a long, b long, near boolean"))
    rejected = met.where("not near").select(F.col("a").alias("lead"), F.col("b").alias("id"))
    mixed = led.join(rejected, ["lead", "id"], "left_semi").select("key").distinct()
    return met.where("near").select("a", "b").union(_mixed_edges(spread(led, mixed, "key", ["id"]), of, threshold))


def _mixed_edges(led: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that join the members of keys whose first rejects some; every pair of a key meets in a task."""
    blocks = F.ceil(F.col("members") / KEY_BLOCK).cast("int").alias("blocks")
    members = led.select("key", "id", blocks).union(led.select("key", F.col("lead").alias("id"), blocks).distinct())
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = members.join(of, "id").withColumn("x", mine).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("side"), "id", "n", "regs")
    held = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")

    @tidy
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3, GATHER):
            keys, i, j, side, ids, n = (table[c].to_numpy() for c in ("key", "i", "j", "side", "id", "n"))
            regs = _stacked(table["regs"].to_pylist())
            found = coarse_links(np.stack([keys, i, j]), ids, np.where(i == j, -1, side), n, regs, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return held.mapInArrow(pair, "a long, b long")


def coarse_links(group: np.ndarray, ids: np.ndarray, side: np.ndarray, n: np.ndarray, regs: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join what may be linked among rows of one group (a column of ``group``; rows lie together).

    ``side``: 0 or 1, then only rows of different sides are compared; -1 for all pairs.
    """
    ends = np.flatnonzero(np.append((group[:, 1:] != group[:, :-1]).any(axis=0), True)) + 1
    end = np.repeat(ends, np.diff(ends, prepend=0))
    number, own = np.unique(ids, return_inverse=True)  # one number per id: rows of several groups are one member
    joined, found = Joined(len(number)), []
    at = np.arange(len(ids))
    for apart in range(1, int((end - at).max(initial=0))):
        at = at[at + apart < end[at]]
        i = at[((side[at] < 0) | (side[at] != side[at + apart])) & (own[at] != own[at + apart])]
        roots = joined.roots()
        i = i[roots[own[i]] != roots[own[i + apart]]]
        for some in np.array_split(i, max(1, -(-len(i) // GATHER))):
            if len(some):
                near = some[may_link(regs[some], regs[some + apart], n[some], n[some + apart], threshold)]
                for a, b in zip(own[near].tolist(), own[near + apart].tolist(), strict=True):
                    if joined.join(a, b):
                        found.append((int(number[a]), int(number[b])))
    return found


class Joined:
    """Which of a task's members are linked by now."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return int(i)

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def block_links(ids: np.ndarray, side: np.ndarray, known: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], over: int, under: int) -> tuple[list[tuple[int, int]], Joined]:
    """Links (pairs of rows) that join members, by full sets; ``side``: 0 or 1, then rows of different sides are compared; all 0 for all pairs.

    Rows with the same value in ``known`` are joined already.
    """
    n, found = np.fromiter(map(len, sets), np.int64, len(sets)), []
    joined = Joined(len(ids))
    _, first, number = np.unique(known, return_index=True, return_inverse=True)
    joined.up = first[number]
    rest = np.flatnonzero(side)
    for i in np.flatnonzero(side == 0).tolist():
        second = rest if len(rest) else np.arange(i + 1, len(ids))
        other = second[(under * np.minimum(n[second], n[i]) >= over * np.maximum(n[second], n[i]))]
        if len(other):
            other = other[joined.roots()[other] != joined.root(i)]
        if len(other) > 8:
            other = other[may_link(regs[other], np.broadcast_to(regs[i], (len(other), regs.shape[1])), n[other], np.full(len(other), n[i]), over / under)]
        own = sets[i]
        for j in other.tolist():
            if joined.root(i) == joined.root(j):
                continue
            at = np.searchsorted(own, sets[j])
            common = int((own[np.minimum(at, len(own) - 1)] == sets[j]).sum())
            if under * common >= over * (n[i] + n[j] - common):
                joined.join(i, j)
                found.append((i, j))
    return found, joined


def _sets(rows: DataFrame, members: DataFrame, words: int, m: int) -> DataFrame:
    """``members`` (k, x, id, c, blocks) with registers and the sorted shingle hashes of their texts."""
    # The same plan at every size: ids are the build side, texts stream past them unsorted.
    met = rows.join(members.hint("shuffle_hash"), ["k", "x"]).select("t", "id", "c", "blocks")

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                hashes, size = shingle_sets(part.column(0), words)
                regs = registers(hashes, size, m)
                ends = np.cumsum(size)
                own = [hashes[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
                made = pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(own, pa.binary())], ["id", "c", "blocks", "regs", "own"])
                # Of equal rows one is enough.
                yield made.take(pa.array(np.unique(made.column(0).to_numpy(), return_index=True)[1]))

    return met.mapInArrow(gather, "id long, c long, blocks int, regs binary, own binary")


def _meeting(held: DataFrame, keys: list[str], over: int, under: int, stars: bool) -> DataFrame:
    """(c, blocks, a, b): what is linked within groups of rows, as links or as (smallest id of what is joined, other id); see ``block_links``."""
    held = held.repartition(*keys).sortWithinPartitions(*keys, "side", "id")

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, len(keys)):
            if group.num_rows < 2:
                continue
            ids, side, known = (group[c].to_numpy() for c in ("id", "side", "known"))
            sets = [np.frombuffer(x, np.uint64) for x in group["own"].to_pylist()]
            found, joined = block_links(ids, side, known, _stacked(group["regs"].to_pylist()), sets, over, under)
            if stars:  # all rows are of side 0 and in the order of ids
                a, b = ids[joined.roots()], ids
            else:
                a, b = (ids[[f[k] for f in found]] if found else ids[:0] for k in (0, 1))
            apart = np.flatnonzero(a != b)
            if len(apart):
                c, blocks = (np.full(len(apart), group[x][0].as_py(), t) for x, t in (("c", np.int64), ("blocks", np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(blocks), pa.array(a[apart]), pa.array(b[apart])], ["c", "blocks", "a", "b"])

    return held.select(*keys, "side", "id", "known", "regs", "own").mapInArrow(compare, "c long, blocks int, a long, b long")


def _by_cluster(links: DataFrame) -> DataFrame:
    """(id, component) from links (c, a, b) of clusters with up to MOST links each; a cluster is one task's work."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 1):
            number, own = np.unique(np.concatenate([group["a"].to_numpy(), group["b"].to_numpy()]), return_inverse=True)
            joined, half = Joined(len(number)), group.num_rows
            for a, b in zip(own[:half].tolist(), own[half:].tolist(), strict=True):
                joined.join(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(number[joined.roots()])], ["id", "component"])

    return links.select("c", "a", "b").repartition("c").sortWithinPartitions("c").mapInArrow(join, "id long, component long")


def _components(rows: DataFrame, classes: DataFrame, clusters: DataFrame, words: int, over: int, under: int) -> DataFrame:
    """(id, component) for classes that are linked with others."""
    many = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    of = classes.select("id", "n", "k", "x").join(clusters.select("id", F.col("component").alias("c")), "id")
    wanted = spread(of, of.groupBy("c").agg(many.alias("blocks")), "c", ["id"])
    sets = materialise(_sets(rows, wanted.select("k", "x", "id", "c", "blocks"), words, bands_for(over / under) * ROWS))
    # Blocks, each with its cluster's leader, whose id is the cluster's number.
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = sets.withColumn("b", mine)
    leaders = sets.where("id = c and blocks > 1").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("b") != mine)
    everyone = placed.unionByName(leaders).withColumns({"side": F.lit(0), "known": F.col("id")})
    found = materialise(_meeting(everyone, ["c", "blocks", "b"], over, under, True))
    whole = found.where("blocks = 1")
    alone = whole.select(F.col("b").alias("id"), F.col("a").alias("component")).union(whole.select("a", "a").distinct())
    if sets.where("blocks > 1").isEmpty():
        return alone
    # What its block did not link to the leader meets the other blocks.
    linked = found.where("blocks > 1").select(F.col("b").alias("id"), F.col("a").alias("root"))
    large = placed.where("blocks > 1").join(linked, "id", "left").withColumn("known", F.coalesce("root", "id")).drop("root")
    groups = large.where("known != c").groupBy("c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups"))
    large = materialise(spread(large, groups, "c", ["id"]))
    left = large.where("known != c").withColumns({"g": F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int"), "side": F.lit(0)})
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = large.withColumns({"g": F.explode(F.sequence(F.lit(0), F.col("groups") - 1)), "side": F.lit(1)})
    columns = ["c", "blocks", "g", "b", "side", "id", "known", "regs", "own"]
    across = _meeting(left.select(columns).union(right.select(columns)), ["c", "blocks", "g", "b"], over, under, False)
    links = materialise(found.where("blocks > 1").union(across))
    counts = links.groupBy("c").agg(F.count(F.lit(1)).alias("links"))
    most = counts.where(F.col("links") > MOST)
    out = alone.union(_by_cluster(spread(links, counts.where(F.col("links") <= MOST), "c", ["a", "b"])))
    return out if most.isEmpty() else out.union(connected_components(spread(links, most, "c", ["a", "b"]).select("a", "b")))


def _decided(df: DataFrame, words: int, over: int, under: int, key: str, text: str) -> DataFrame:
    """Per row: k, x (its text's hash), n, and k and x of the first row of its group, ``first``; null for a row that takes no part."""
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("k", F.xxhash64("t").alias("x"), "t")
    signed = materialise(_signatures(rows, words, over, under))
    taking = F.col("k").isNotNull() & (F.col("n") > 0)
    first = F.min(F.struct("k", "x"))
    classes = signed.where(taking).groupBy("h").agg(first.alias("r"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("id"), "h", "r.k", "r.x", "rows", "n", "regs", "keys"))
    clusters = materialise(connected_components(_cluster_edges(classes, over / under)))
    components = _components(rows.where(F.col("k").isNotNull()), classes, clusters, words, over, under)
    linked = classes.select("id", "h", "k", "x").join(components, "id")
    groups = linked.groupBy("component").agg(first.alias("first"))
    named = spread(linked.select("h", "component"), groups, "component", ["h"]).select("h", "first")
    # Classes of one document that is linked with none need no join.
    copies = classes.where("rows > 1").select("h", F.struct("k", "x").alias("own"))
    of = materialise(copies.join(named, "h", "full").select("h", F.coalesce("first", "own").alias("first")))
    shown = signed.select("k", "x", "n", "h")
    met = spread(shown.where(taking), of, "h", ["k", "x"], "left").select("k", "x", "n", F.coalesce("first", F.struct("k", "x")).alias("first"))
    none = F.lit(None).cast(met.schema["first"].dataType)
    return met.union(shown.where(~taking).select("k", "x", "n", none.alias("first")))


def near_duplicates(df: DataFrame, words: int = 5, over: int = 80, under: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key (an integer), n_shingles, component_id, kept.

    Documents are linked if ``under`` * (size of the intersection of their
    shingle sets) >= ``over`` * (size of the union).  component_id is the
    smallest key reachable over links, kept tells whether that is the document's
    own.  A null or empty text, or one without words, has no shingles and is
    linked with nothing; so is a row with a null key, whose component_id is null
    and which is kept.  Rows are judged by their own text: of rows that repeat a
    key, those with other texts are in groups of their own, and equal rows get
    equal results.  Whole texts are read; other columns are not.
    """
    found = _decided(df, words, over, under, key, text)
    component = F.coalesce(F.col("first.k"), F.col("k"))
    return found.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("k")).alias("kept"))


def keep_one(df: DataFrame, words: int = 5, over: int = 80, under: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, less all but one of each group of near-duplicates.

    The one with the smallest key stays; of several such rows with different
    texts that with the smallest hash of its text, of several equal ones any.
    Rows with a null key, and rows without words, all stay.
    """
    names = fresh(df, "k", "x")
    found = materialise(_decided(df, words, over, under, key, text))
    first = (F.col("k") == F.col("first.k")) & (F.col("x") == F.col("first.x"))
    gone = found.where(~first).select(F.col("k").alias(names[0]), F.col("x").alias(names[1])).distinct()
    marked = df.withColumns({names[0]: F.col(key), names[1]: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    stay = marked.join(gone.hint("shuffle_hash"), names, "left_anti")
    repeated = found.where(first).groupBy(F.col("k").alias(names[0]), F.col("x").alias(names[1])).count().where("count > 1").drop("count")
    if not repeated.isEmpty():
        stay = stay.join(repeated, names, "left_anti").unionByName(stay.join(repeated, names, "left_semi").dropDuplicates(names))
    return stay.select(*df.columns)
