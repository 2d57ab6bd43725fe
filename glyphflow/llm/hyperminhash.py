"""HyperMinHash sketches of word-shingle sets, in numpy.

A sketch has ``m`` registers.  Every shingle is thrown into the registers
``REPEATS`` times with independent hashes, so that sets far smaller than ``m``
fill them too; a register keeps the smallest 32-bit value it gets, stored as
its number of leading zeros (6 bits) and the 10 bits behind the leading one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MANTISSA = 10
REPEATS = 8
ROWS = 5
EMPTY = np.uint16(0xFFFF)
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bands_for(similarity: float, miss: float = 1e-7) -> int:
    """Bands of ROWS registers with which a pair at ``similarity`` shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**ROWS))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one text after the other, and each text's number of them.

    Words are runs of characters other than space and U+0009 to U+000D, with
    A-Z in lower case.  A text of fewer words than a shingle takes is one
    shingle; a text without words has none.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    if not len(distinct):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    real = np.array([bool(w) for w in distinct])[codes := coded.indices.to_numpy()]
    per = np.append(0, np.cumsum(real))[offsets]
    hashed = pd.util.hash_array(distinct.astype(object), categorize=False)[codes[real]]
    starts, counts = per[:-1], np.diff(per)
    h = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for k in range(words):
        h = mix(h + hashed[k : k + len(h)] + _STEP)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, (a, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
        if n >= words:
            own = np.unique(h[a : a + n - words + 1])
        elif n:
            own = np.array([n], np.uint64)
            for k in range(n):
                own = mix(own + hashed[a + k] + _STEP)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def registers(hashes: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """One row of ``m`` registers per set."""
    least = np.full(len(sizes) * m, 0xFFFFFFFF, np.uint32)
    base = np.repeat(np.arange(len(sizes), dtype=np.uint64) * np.uint64(m), sizes)
    for k in range(REPEATS):
        v = mix(hashes + np.uint64((k + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        at = base + (((v >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32))
        np.minimum.at(least, at.astype(np.int64), v.astype(np.uint32))
    exponent = np.frexp(least.astype(np.float64))[1]  # 0 for 0
    zeros = 32 - exponent
    mantissa = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    packed = (zeros << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    packed[least == 0xFFFFFFFF] = EMPTY
    return packed.reshape(len(sizes), m)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; 0 for a band whose registers are all empty."""
    bands = regs.reshape(len(regs), -1, ROWS)
    key = np.broadcast_to(mix(np.arange(1, bands.shape[1] + 1, dtype=np.uint64)), bands.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key + bands[:, :, k].astype(np.uint64) + _STEP)
    key[(bands == EMPTY).all(axis=2)] = 0
    return key


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def shares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sketch pairs: the share of equal registers among those that either uses, and the number of these."""
    held = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    return equal / np.maximum(held, 1), held


def corrected(share: np.ndarray, na: np.ndarray, nb: np.ndarray, m: int) -> np.ndarray:
    """Jaccard estimates from shares of equal registers, less the matches that unequal values give by chance.

    The smallest of a register's values is about exponential with the load
    REPEATS * n / m; a cell [lo, hi) of values shares lead and mantissa, and two
    independent registers meet there with the product of their densities times
    the cell's width, summed over all leads.
    """
    la, lb = REPEATS * na / m, REPEATS * nb / m
    chance = np.zeros(len(share))
    for zeros in range(32):
        lo, hi = 2.0 ** -(zeros + 1), 2.0**-zeros
        chance += 2.0 ** -(zeros + 1 + MANTISSA) * la * lb / (la + lb) * (np.exp(-(la + lb) * lo) - np.exp(-(la + lb) * hi))
    return (share - chance) / (1 - chance)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch pairs."""
    return corrected(shares(a, b)[0], na, nb, a.shape[1])
