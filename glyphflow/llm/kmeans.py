"""k-means in numpy, for codebooks on bounded samples."""

from __future__ import annotations

import numpy as np


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """The number of each row's nearest centre; ``block`` rows are compared at once."""
    squares, out = (centres * centres).sum(axis=1), np.empty(len(x), np.int64)
    for at in range(0, len(x), block):
        out[at : at + block] = np.argmin(squares - 2 * (x[at : at + block] @ centres.T), axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres
