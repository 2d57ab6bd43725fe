"""Merging symbol pairs by rank: one sequence with an agenda, many with ragged arrays.

Both give what the usual definition gives: again and again, the pair of lowest
rank is merged, the leftmost one of several.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)


def agenda(symbols: list, lookup) -> list:
    """Merge one sequence. ``lookup(a, b)`` gives (rank, merged symbol) or None.

    The agenda is a heap of adjacent pairs by (rank, place); a pair whose sides
    have changed since is passed over.  n log n for n symbols.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = lookup(symbols[i], symbols[i + 1])
        if found is not None:
            heap.append((found[0], i, i + 1, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, j, a, b, merged = heapq.heappop(heap)
        if symbols[i] != a or symbols[j] != b or after[i] != j:
            continue
        symbols[i], symbols[j] = merged, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = lookup(merged, symbols[k])
            if found is not None:
                heapq.heappush(heap, (found[0], i, k, merged, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = lookup(symbols[h], merged)
            if found is not None:
                heapq.heappush(heap, (found[0], h, i, symbols[h], merged, found[1]))
    return [s for s in symbols if s is not None]


class PairTable:
    """(left id, right id) -> (rank, merged id), as sorted arrays."""

    def __init__(self, left, right, rank, merged):
        left, right, rank, merged = (np.asarray(x, np.int64) for x in (left, right, rank, merged))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        # Where every pair with the merged symbol has a higher rank, merging all places of a pair at once is the same as one after the other.
        least = np.full(max(map(int, (left.max(initial=0), right.max(initial=0), merged.max(initial=0)))) + 1, NONE, np.int64)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self.together = np.append((least[merged] > rank)[order], False)
        self.keys = keys[order]
        self.rank = np.append(rank.astype(np.int32)[order], NONE)
        self.merged = np.append(merged.astype(np.int32)[order], np.int32(-1))

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in ``rank`` and ``merged``; the last place stands for no such pair. Negative ids have no pairs."""
        want = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.searchsorted(self.keys, want)
        miss = (at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != want)
        return np.where(miss, len(self.keys), at)

    def one(self, left: int, right: int):
        if left < 0 or right < 0:
            return None
        want = left << 32 | right
        at = int(np.searchsorted(self.keys, want))
        if at == len(self.keys) or self.keys[at] != want:
            return None
        return int(self.rank[at]), int(self.merged[at])


def _lower_follows(sym, last, begin, hit, owner, merged, some, low, pairs: PairTable) -> np.ndarray:
    """Of the places ``some`` of ``hit``: whether merging there, after those to its left, brings a pair of at most the row's lowest rank."""
    at, own = hit[some], merged[some]
    risky = np.zeros(len(some), bool)
    right = np.flatnonzero(~last[at + 1])
    risky[right] = pairs.rank[pairs.find(own[right], sym[at[right] + 2])] <= low[owner[some[right]]]
    left = np.flatnonzero(at > begin[owner[some]])
    beside = sym[at[left] - 1]
    touches = (some[left] > 0) & (hit[some[left] - 1] == at[left] - 2)
    beside[touches] = merged[some[left[touches]] - 1]
    risky[left] |= pairs.rank[pairs.find(beside, own[left])] <= low[owner[some[left]]]
    return risky


def merge_ragged(ids: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge many sequences at once; returns the surviving ids and each sequence's number of them.

    In every round each sequence applies its own lowest-rank pair, all sequences
    at the same time, and within a sequence at all places that do not overlap,
    from the left; where that could differ from one place after the other (see
    ``PairTable.together``), up to the first place that brings a pair of lower
    rank.  A sequence without a pair leaves.
    """
    lengths = np.asarray(lengths, np.int64)
    out_rows, out_ids = [], []
    rows = np.flatnonzero(lengths)
    sizes = lengths[rows]
    sym = ids.astype(np.int32)

    def ranks(s, last):
        at = np.full(len(s), len(pairs.keys))
        inner = np.flatnonzero(~last)
        at[inner] = pairs.find(s[inner], s[inner + 1])
        return at

    last = np.zeros(len(sym), bool)
    last[np.cumsum(sizes) - 1] = True
    at = ranks(sym, last)
    while len(rows):
        rank = pairs.rank[at]
        begin = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(rank, begin)
        ended = low == NONE
        if ended.any():
            gone = np.repeat(ended, sizes)
            out_ids.append(sym[gone])
            out_rows.append(np.repeat(rows[ended], sizes[ended]))
            stay = ~gone
            sym, at, last, rank = sym[stay], at[stay], last[stay], rank[stay]
            rows, sizes, low = rows[~ended], sizes[~ended], low[~ended]
            if not len(rows):
                break
        row = np.repeat(np.arange(len(rows)), sizes)
        hit = np.flatnonzero(rank == low[row])
        owner = row[hit]
        # Of places that follow one another every second one is free, counted from the first.
        begins = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
        free = (np.arange(len(hit)) - np.repeat(begins, np.diff(begins, append=len(hit)))) % 2 == 0
        hit, owner = hit[free], owner[free]
        lone = ~pairs.together[at[hit]]
        if lone.any():
            single = np.zeros(len(rows), bool)
            single[owner[lone]] = True
            some = np.flatnonzero(single[owner])
            risky = _lower_follows(sym, last, begin, hit, owner, pairs.merged[at[hit]], some, low, pairs)
            # The first such place of a sequence is its last one in this round.
            past = np.cumsum(risky) - risky
            first = np.searchsorted(owner[some], owner[some])
            stay = np.ones(len(hit), bool)
            stay[some] = past == past[first]
            hit, owner = hit[stay], owner[stay]
        sym[hit] = pairs.merged[at[hit]]
        last[hit] = last[hit + 1]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sizes = sizes - np.bincount(owner, minlength=len(rows))
        now = hit - np.arange(len(hit))  # the places after the right sides are gone
        sym, at, last = sym[keep], at[keep], last[keep]
        at[now] = len(pairs.keys)
        right = now[~last[now]]
        at[right] = pairs.find(sym[right], sym[right + 1])
        left = now[now > 0] - 1
        left = left[~last[left]]
        at[left] = pairs.find(sym[left], sym[left + 1])
    if not out_ids:
        return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
    of = np.concatenate(out_rows)
    order = np.argsort(of, kind="stable")
    return np.concatenate(out_ids)[order], np.bincount(of, minlength=len(lengths))
