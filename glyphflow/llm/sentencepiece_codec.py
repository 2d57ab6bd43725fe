"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

For merge-type vocabularies.  Pre-tokens are cut where no piece holds both
neighbouring characters, so that no merge could cross; every different part of
an Arrow batch goes through the agenda once.  The ``sentencepiece`` library then
encodes the same parts in one call, and where it differs its ids stand
(``corrected`` counts those).  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept, ragged, slices, tidy
from .pieces import SPACE, Crossings, Pieces, irregular, marked, runs, strings

#: Half of the pre-tokens that a worker remembers, and the longest one that it does.
MEMORY, LONG = 600_000, 100


class Codec:
    def __init__(self, path: str, checked: bool = True):
        self.pieces = Pieces(path)
        self.known: dict[str, str] = {}
        self.past: dict[str, str] = {}
        self.corrected = 0
        self.library = None
        if checked:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=self.pieces.without_mark())
        self.crossings = Crossings(self.pieces)
        rank = self.pieces.rank
        self.rank = rank.get
        self.spoken = [t.replace(SPACE, " ") for t in self.pieces.text]
        self.numbers = [*map(str, range(len(self.pieces.text)))]
        self.bytes = frozenset(self.pieces.byte_of)

    def agenda(self, run: str) -> list[str]:
        """The pieces of a run, merged by score: a heap of adjacent pairs by rank and place.

        ``of`` has the rank of the pair that begins at a place now; a pair that
        comes up with another rank has changed since and is passed over.
        """
        rank, symbols, end = self.rank, [*run], len(run)
        bits = 20 if end < 1 << 20 else end.bit_length()
        mask = (1 << bits) - 1
        of = [*map(rank, map(add, run, run[1:])), None]
        heap = [r << bits | i for i, r in enumerate(of) if r is not None]
        heapify(heap)
        after, before = [*range(1, end + 1)], [*range(-1, end)]
        while heap:
            low = heappop(heap)
            i = low & mask
            if of[i] != low >> bits:
                continue
            j = after[i]
            symbols[i] = merged = symbols[i] + symbols[j]
            symbols[j] = of[j] = None
            after[i] = k = after[j]
            before[k] = i
            if k < end and (r := rank(merged + symbols[k])) is not None:
                of[i] = r
                heappush(heap, r << bits | i)
            else:
                of[i] = None
            if i:
                h = before[i]
                of[h] = r = rank(symbols[h] + merged)
                if r is not None:
                    heappush(heap, r << bits | h)
        return [s for s in symbols if s is not None]

    def encode_run(self, run: str) -> list[int]:
        """Ids of a text whose spaces are marks already."""
        ids = [*map(self.pieces.id.get, found := self.agenda(run))]
        if None not in ids:
            return ids
        return [k for s, i in zip(found, ids, strict=True) for k in (self.pieces.byte_ids(s) if i is None else (i,))]

    def encode_runs(self, words: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each run: the number of ids, the ids joined by commas, their text with the leading space."""
        number = self.numbers.__getitem__
        joined = [*map(self.known.get, words)]
        spoken: list[str] = [w.replace(SPACE, " ") for w in words]
        miss = [i for i, found in enumerate(joined) if found is None]
        if miss and self.past:
            for i in miss:
                joined[i] = self.past.get(words[i])
            self._remember(words, joined, [i for i in miss if joined[i] is not None])
            miss = [i for i in miss if joined[i] is None]
        if miss:
            made = [self.encode_run(words[i]) for i in miss]
            if self.library is not None:
                for k, ids in enumerate(self.library.encode([words[i] for i in miss], num_threads=1)):
                    if ids != made[k]:
                        self.corrected += 1
                        made[k] = ids
            same = []
            for i, ids in zip(miss, made, strict=True):
                joined[i], text = ",".join(map(number, ids)), self.pieces_text(ids)
                if text == spoken[i]:
                    same.append(i)
                spoken[i] = text
            self._remember(words, joined, same)
        return [ids.count(",") + 1 for ids in joined], joined, spoken

    def _remember(self, words: list[str], joined: list[str], rows: list[int]) -> None:
        """Keep the ids of runs that decode to their own text; what wasn't met since MEMORY others were is forgotten."""
        if len(self.known) + len(rows) > MEMORY:
            self.past, self.known = self.known, {}
        self.known.update((words[i], joined[i]) for i in rows if len(words[i]) <= LONG)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.encode_runs(runs(text))[1] for i in ids.split(",")]

    def pieces_text(self, ids: list[int]) -> str:
        """Text of ids, with the leading space."""
        p, out, held = self.pieces, [], bytearray()
        if self.bytes.isdisjoint(ids):
            return "".join(map(self.spoken.__getitem__, ids))
        for i in ids:
            if i in p.byte_of:
                held.append(p.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.spoken[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.pieces_text(ids).removeprefix(" ")

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray, pa.Array]:
        """Number of ids, the ids as text joined by commas, and the decoded text of each document."""
        offsets, codes, distinct = chunks(texts)
        points, lengths = marked(distinct)
        begins = self.crossings.begins(points, lengths)
        parts = strings(points, begins).dictionary_encode()
        held = np.append(0, np.cumsum(begins))
        ends = np.cumsum(lengths)
        first, many = held[ends - lengths], held[ends] - held[ends - lengths]
        sizes, joined, spoken = self.encode_runs(parts.dictionary.to_pylist())
        # The parts of every text, by number.
        own = parts.indices.to_numpy()[ragged(first[codes], many[codes])]
        at = np.append(0, np.cumsum(many[codes]))[offsets]
        ends = np.append(0, np.cumsum(np.array(sizes, np.int64)[own]))
        total = ends[at[1:]] - ends[at[:-1]]
        rows = pa.array(at.astype(np.int32))

        def together(of: list[str], between: str) -> list:
            return pc.binary_join(pa.ListArray.from_arrays(rows, pa.array(of, pa.string()).take(pa.array(own))), between).to_pylist()

        ids = together(joined, ",")
        back = [t[1:] for t in together(spoken, "")]
        odd = irregular(distinct)
        if odd.any():
            held = np.append(0, np.cumsum(odd[codes]))
            for i in np.flatnonzero(held[offsets[1:]] > held[offsets[:-1]]):
                own = self.encode(texts[i].as_py())
                total[i], ids[i], back[i] = len(own), ",".join(map(str, own)), self.decode(own)
        return total, ids, back


def _mapped(df: DataFrame, path: str, key: str, text: str, checked: bool, made: Callable, schema: str) -> DataFrame:
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                codec = kept(("codec", path, checked), lambda: Codec(path, checked))
                before = codec.corrected
                columns = made(*codec.documents(part.column(1)))
                fixed = pa.array([codec.corrected - before] + [0] * (part.num_rows - 1), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, fixed], ["k", *names, "corrected"])

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, {schema}, corrected long").withColumnRenamed("k", key)


def sentencepiece_encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", checked: bool = True) -> DataFrame:
    """One row per row of ``df``: the key, n_tokens, ids (array<int>), decoded (the text of decode(ids)), corrected.

    A null or empty text has no ids and decodes to an empty text.  Whole texts
    are encoded, however long.  ``corrected`` counts, on a slice's first row,
    the pre-tokens for which the library's ids replaced the agenda's.
    """

    def made(total, ids, back):
        flat = np.fromstring(",".join(i for i in ids if i), np.int32, sep=",") if total.any() else np.zeros(0, np.int32)
        return [pa.array(total), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(total)).astype(np.int32)), pa.array(flat)), pa.array(back, pa.string())]

    return _mapped(df, path, key, text, checked, made, "n_tokens long, ids array<int>, decoded string")


def sentencepiece_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", checked: bool = True) -> DataFrame:
    """As sentencepiece_encode, with sha256 of the comma-joined ids and of the decoded text in place of both."""

    def sha(values: list[str]) -> pa.Array:
        return pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())

    return _mapped(df, path, key, text, checked, lambda total, ids, back: [pa.array(total), sha(ids), sha(back)], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def sentencepiece_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the decoded text of its array<int> column ``ids`` as ``out``; null ids give null."""

    @F.pandas_udf("string")
    def decode(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = kept(("codec", path, False), lambda: Codec(path, False))
        for column in columns:
            yield column.map(lambda x: None if x is None else codec.decode(list(x)))

    return df.withColumn(out, decode(F.col(ids)))
