"""A bidirectional window network over tokens, in numpy.

Each of the four neighbours (two on either side) adds a row of its position's
table to a hidden layer.  The token is predicted in two steps: the layer gives
the distribution of the token's group, and the layer, weighted cell by cell by
the group, that of the token within it.  So a vocabulary of GROUPS * SIDE tokens
costs GROUPS + SIDE outputs a token.
"""

from __future__ import annotations

import numpy as np

from .common import ragged

GROUPS, SIDE, HIDDEN = 64, 64, 24
TOKENS = GROUPS * SIDE
PLACES = (-2, -1, 1, 2)
#: What is above this would overflow as a power of e in single precision.
MOST = 80
#: The token outside a document.
PAD = TOKENS
_SHAPES = ((len(PLACES), TOKENS + 1, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN), (HIDDEN, SIDE), (GROUPS, SIDE))
_TABLES = len(PLACES) * (TOKENS + 1) * HIDDEN
SIZE = sum(int(np.prod(s)) for s in _SHAPES)


def views(flat: np.ndarray) -> list[np.ndarray]:
    """tables, hidden, groups' weights and bias, gates, weights within a group, tokens' bias."""
    out, at = [], 0
    for shape in _SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def start(counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """First parameters: small weights, open gates, and the tokens' frequencies as bias."""
    flat = (np.random.default_rng(seed).standard_normal(SIZE) * 0.1).astype(np.float32)
    _, hidden, _, bias, gates, _, inner = views(flat)
    of = (counts + 0.5).reshape(GROUPS, SIDE)
    hidden[:], gates[:] = 0, 1
    bias[:] = np.log(of.sum(axis=1) / of.sum())
    inner[:] = np.log(of / of.sum(axis=1, keepdims=True))
    return flat


def neighbours(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([padded[at + p] for p in PLACES])


class Room:
    """Arrays that batch after batch writes to: fresh ones of that size would be given back to the system each time."""

    def __init__(self):
        self.held: dict[tuple, np.ndarray] = {}

    def of(self, name: str, n: int, width: int, kind: np.dtype) -> np.ndarray:
        """``n`` rows, with what was there before; valid until the name is asked for again."""
        key = name, width, kind
        if key not in self.held or len(self.held[key]) < n:
            self.held[key] = np.empty((n, width), kind)
        return self.held[key][:n]


def _rows(table: np.ndarray, index: np.ndarray, out: np.ndarray) -> np.ndarray:
    # All indexes are within the table: "clip" only spares numpy a copy.
    return np.take(table, index, axis=0, out=out, mode="clip")


def _exp(logits: np.ndarray) -> np.ndarray:
    """In place; returns the sums.  Inputs count as MOST at most, far above what weights give."""
    if logits.size and logits.max() > MOST:
        np.minimum(logits, MOST, out=logits)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def _forward(params: list[np.ndarray], around: np.ndarray, group: np.ndarray, room: Room) -> tuple[np.ndarray, ...]:
    tables, hidden, weights, bias, gates, within, inner = params
    n, kind = len(group), tables.dtype
    h, other = room.of("h", n, HIDDEN, kind), room.of("other", n, HIDDEN, kind)
    _rows(tables[0], around[0], h)
    for place in range(1, len(PLACES)):
        h += _rows(tables[place], around[place], other)
    h += hidden
    np.tanh(h, out=h)
    gate = _rows(gates, group, room.of("gate", n, HIDDEN, kind))
    gated = np.multiply(h, gate, out=room.of("gated", n, HIDDEN, kind))
    first = np.matmul(h, weights, out=room.of("first", n, GROUPS, kind))
    second = np.matmul(gated, within, out=room.of("second", n, SIDE, kind))
    first += bias
    second += _rows(inner, group, room.of("inner", n, SIDE, kind))
    return h, gate, gated, first, second


def log_probabilities(flat: np.ndarray, padded: np.ndarray, at: np.ndarray, batch: int = 4096) -> np.ndarray:
    """log p(token | neighbours) at the places ``at``."""
    params, result, room = views(flat), np.empty(len(at), np.float64), Room()
    for k in range(0, len(at), batch):
        own = at[k : k + batch]
        group, member = np.divmod(padded[own].astype(np.int64), SIDE)
        _, _, _, first, second = _forward(params, neighbours(padded, own), group, room)
        rows = np.arange(len(own))
        hit = first.ravel()[rows * GROUPS + group].astype(np.float64) + second.ravel()[rows * SIDE + member]
        for logits in (first, second):
            hit -= np.log(_exp(logits))
        result[k : k + batch] = hit
    return result


#: So many rows of a number are added number by number side by side, the others of its rows one after the other.
FEW = 8


def _summed(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``index``, and the sums of their rows; row k of ``values`` is that of index k, k + len(values), and so on."""
    order = np.argsort(index, kind="stable")
    own = index[order]
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    counts = np.append(begins[1:], len(own)) - begins
    row = np.tile(np.arange(len(values)), len(index) // len(values))[order]
    # The numbers with the most rows first: those with more than k rows are the first ones for every k up to FEW.
    some = np.minimum(counts, FEW + 1).astype(np.uint8)
    by = np.argsort(FEW + 1 - some, kind="stable")
    at = begins[by]
    more = len(by) - np.cumsum(np.bincount(some, minlength=FEW + 2))
    sums = values.take(row[at], axis=0)
    for k in range(1, FEW):
        if not more[k]:
            break
        sums[: more[k]] += values.take(row[at[: more[k]] + k], axis=0)
    if many := more[FEW]:
        left = counts[by[:many]] - FEW
        sums[:many] += np.add.reduceat(values.take(row[ragged(at[:many] + FEW, left)], axis=0), np.cumsum(left) - left, axis=0)
    back = np.empty_like(by)
    back[by] = np.arange(len(by))
    return own[begins], sums.take(back, axis=0)


def gradient(params: list[np.ndarray], around: np.ndarray, token: np.ndarray, room: Room | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Of the mean of -log p(token | around): (rows, their gradients) for each place's table, and those of the other parameters."""
    room = Room() if room is None else room
    # By groups, so that a group's rows lie together.
    order = np.argsort((token // SIDE).astype(np.uint8), kind="stable")
    around, token = around[:, order], token[order]
    n, rows, ones = len(token), np.arange(len(token)), np.ones(len(token), params[0].dtype)
    group, member = np.divmod(token.astype(np.int64), SIDE)
    _, _, weights, _, gates, within, _ = params
    h, opened, gated, first, second = _forward(params, around, group, room)
    for logits, hit in ((first, rows * GROUPS + group), (second, rows * SIDE + member)):
        logits *= (1 / (n * _exp(logits)))[:, None]
        logits.ravel()[hit] -= 1 / n
    back = np.matmul(second, within.T, out=room.of("back", n, HIDDEN, h.dtype))
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    gate, inner = np.zeros_like(gates), np.zeros((GROUPS, SIDE), gates.dtype)
    gate[group[begins]] = np.add.reduceat(back * h, begins, axis=0)
    inner[group[begins]] = np.add.reduceat(second, begins, axis=0)
    back *= opened
    back += np.matmul(first, weights.T, out=room.of("other", n, HIDDEN, h.dtype))
    rest = [back, h.T @ first, ones @ first, gate, gated.T @ second, inner]
    np.multiply(h, h, out=h)
    back *= np.subtract(1, h, out=h)
    rest[0] = ones @ back
    # All places' tables at once.
    starts = np.arange(len(PLACES) + 1) * (TOKENS + 1)
    seen, sums = _summed((around + starts[:-1, None]).astype(np.uint16).ravel(), back)
    cuts = np.searchsorted(seen, starts)
    return [(seen[a:b].astype(np.int64) - start, sums[a:b]) for a, b, start in zip(cuts, cuts[1:], starts)], rest


def _whole(table: np.ndarray) -> np.ndarray:
    """The rows of a table, each as one value: numpy writes those faster than rows of numbers."""
    return table.view(np.dtype((np.void, table.shape[1] * table.itemsize))).ravel()


class Trainer:
    """Adam on one shard's examples, from shared parameters; of the tables only the rows that a batch meets move."""

    def __init__(self, flat: np.ndarray, rate: float = 0.004, batch: int = 2048):
        self.flat, self.rate, self.batch = flat.copy(), rate, batch
        self.params = views(self.flat)
        #: Sums of gradients and of their squares that fade out: the moments, but for the factors 0.1 and 0.01.
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        of = [views(x)[0] for x in (self.flat, self.first, self.second)]
        self.tables = [[(x[place], _whole(x[place])) for x in of] for place in range(len(PLACES))]
        self.steps = self.seen = 0
        self.room = Room()

    def train(self, padded: np.ndarray, at: np.ndarray) -> None:
        """Steps over the places ``at``, in an order of chance that depends on nothing but their number."""
        at = np.random.default_rng(len(at)).permutation(at)
        dense = [x[_TABLES:] for x in (self.flat, self.first, self.second)]
        for k in range(0, len(at), self.batch):
            own = at[k : k + self.batch]
            tables, rest = gradient(self.params, neighbours(padded, own), padded[own], self.room)
            self.steps += 1
            self.seen += len(own)
            for held, (rows, values) in zip(self.tables, tables, strict=True):
                some = [x.take(rows, axis=0) for x, _ in held]
                self._move(*some, values)
                for (_, whole), x in zip(held, some, strict=True):
                    np.put(whole, rows, _whole(x), mode="clip")
            self._move(*dense, np.concatenate([g.ravel() for g in rest]))

    def _move(self, values: np.ndarray, first: np.ndarray, second: np.ndarray, gradient: np.ndarray) -> None:
        """In place; the factors of the moments are taken out of the root and the fraction."""
        first *= 0.9
        first += gradient
        second *= 0.99
        second += np.multiply(gradient, gradient, out=gradient)
        root = (1 - 0.99**self.steps) ** 0.5
        step = np.sqrt(second, out=gradient)
        step += 1e-5 * root
        np.divide(first, step, out=step)
        step *= self.rate / (1 - 0.9**self.steps) * root
        values -= step
