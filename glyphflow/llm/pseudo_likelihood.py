"""Masked pseudo-likelihood scores of documents.

The most frequent words of the corpus are tokens of their own, the others share
SHARED tokens by their endings.  The network predicts every token from both
sides; a word that shares a token has that token's probability times its own
part of the token's occurrences, which are counted over the whole corpus.  So the
vocabulary is that of the corpus, and grows with it.

The network is trained on shards of documents: their number follows from the
corpus, their rows and the order of these from the rows' own hashes, so the
model doesn't depend on how the rows lie.  In each round a shard takes Adam steps
on every STRIDE-th position of its documents, the rounds together on all of them,
and the parameters are averaged by the number of examples.  Texts are read
twice; token numbers, the words that share one, and parameters are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, materialise, runs, slices, tidy
from .window_network import PAD, SIZE, TOKENS, Trainer, log_probabilities, start

#: Tokens that the words without one of their own share.
SHARED = 64
#: The most frequent words, whose counts go to where the texts are; the counts of all others meet them by shuffle.
KNOWN = 1 << 18
#: A round trains on every STRIDE-th position of every document, each round on others; ROUNDS rounds cover all.
STRIDE = ROUNDS = 2
#: Tokens of a shard, about, and the most shards; beyond that many shards these become larger.
SHARD, SHARDS = 5_000_000, 4096
#: Parameters in a row of what shards send.
BLOCK = 8192
#: Bytes of the longest words that are hashed as arrays.
LONG = 64
#: Words handled at once, and different words that a task counts before it sends them on.
PART, WORDS = 400_000, 2_000_000


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; of words of more than LONG bytes by pandas."""
    wide = pa.types.is_large_string(words.type)
    ends = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    begins, sizes = ends[:-1], np.diff(ends)
    text = np.append(np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.zeros(8, np.uint8))
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))  # from every byte on
    inside = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, LONG, 8):
        some = np.flatnonzero(sizes > at) if at else slice(None)
        part = eight[begins[some] - ends[0] + at]
        if not len(part):
            break
        part &= inside[np.minimum(sizes[some] - at, 8)]
        part ^= out[some]
        for factor, shift in ((0xFF51AFD7ED558CCD, 32), (0xC4CEB9FE1A85EC53, 29)):
            part *= np.uint64(factor)
            part ^= part >> np.uint64(shift)
        out[some] = part
    if len(some := np.flatnonzero(sizes > LONG)):
        out[some] = pd.util.hash_array(words.take(pa.array(some)).to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return out.view(np.int64)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of texts, the hash and the first place of each different one, each word's number among these, and where each text's words begin and end."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = cut.offsets.to_numpy().astype(np.int64)
    words = cut.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not real.all():
        words, offsets = words.filter(pa.array(real)), np.append(0, np.cumsum(real))[offsets]
    if not len(words):
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), offsets
    codes, hashed = pd.factorize(_hashes(words))
    # Numbers are given in the order in which words come.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    return words, hashed, first, codes, offsets


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts (between ASCII white space, ASCII letters in lower case).

    Of each different word its 64-bit hash and shared token; each word's number
    among these; and where each text's words begin and end.
    """
    words, hashed, first, codes, offsets = _split(texts)
    if not len(words):
        return hashed, np.zeros(0, np.uint16), codes, offsets
    endings = pc.utf8_slice_codeunits(words.take(pa.array(first)), -2).dictionary_encode()
    ending = pd.util.hash_array(endings.dictionary.to_numpy(zero_copy_only=False).astype(object))
    shared = (TOKENS - SHARED + (ending % SHARED).astype(np.int64)).astype(np.uint16)
    return hashed, shared[endings.indices.to_numpy()], codes, offsets


class Vocabulary:
    """Tokens of words, and counts of frequent ones: ``hashes``, the most frequent first, and ``counts``."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.sorted, self.place, self.logs = hashes[order], order, np.log(counts[order])

    def tokens(self, hashes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's token, and the logarithm of its count; not a number for words that aren't known."""
        if not len(self.sorted):
            return shared, np.full(len(hashes), np.nan)
        # In their order words are found several times as fast.
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.sorted, hashes[order]), len(self.sorted) - 1)
        known = self.sorted[at] == hashes
        own = known & (self.place[at] < TOKENS - SHARED)
        return np.where(own, self.place[at], shared).astype(np.uint16), np.where(known, self.logs[at], np.nan)


def _padded(column: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of several documents with two pads around each, the places of the tokens, and each document's number."""
    sizes = np.array([len(x) // 2 for x in column], np.int64)
    tokens = np.frombuffer(b"".join(column), np.uint16)
    places = np.arange(len(tokens)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(tokens) + 2 * len(sizes) + 2, PAD, np.uint16)
    padded[places] = tokens
    return padded, places, sizes


def in_round(inside: np.ndarray, number: int) -> np.ndarray:
    """Which positions of a document the round ``number`` trains on."""
    return (inside + number * STRIDE // ROUNDS) % STRIDE == 0


def train(tokens: DataFrame, counts: np.ndarray) -> np.ndarray:
    """The network's parameters, from rows (k, w)."""
    flat = start(counts)
    shards = int(np.clip(-(-int(counts.sum()) // SHARD), 1, SHARDS))
    order = F.xxhash64("k", "w").alias("o")
    dealt = tokens.select(order, "w").withColumn("s", F.pmod("o", F.lit(shards)).cast("int")).repartitionById(shards, F.col("s")).sortWithinPartitions("s", "o")
    dealt = dealt.select("s", "w")
    for number in range(ROUNDS):
        shared = tokens.sparkSession.sparkContext.broadcast(flat)

        @tidy
        def fit(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            trainer, now = None, None

            def sent() -> pa.RecordBatch:
                rows = np.array_split(trainer.flat, -(-SIZE // BLOCK))
                columns = [pa.array(range(len(rows)), pa.int32()), pa.array([now] * len(rows), pa.int32()), pa.array([trainer.seen] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.float32()))]
                return pa.RecordBatch.from_arrays(columns, ["block", "s", "n", "values"])

            waiting: list[bytes] = []

            def step() -> None:
                padded, places, sizes = _padded(waiting)
                inside = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                trainer.train(padded, places[in_round(inside, number)])
                waiting.clear()

            words = 0
            for (shard,), batch in runs(batches, 1):
                if shard != now:
                    if trainer is not None:
                        step()
                        yield sent()
                    trainer, now, words = Trainer(shared.value), shard, 0
                # The steps' bounds depend on the rows alone, not on batches.
                for row in batch.column(1):
                    waiting.append(row.as_py())
                    words += len(waiting[-1]) // 2
                    if words >= PART:
                        step()
                        words = 0
            if trainer is not None:
                step()
                yield sent()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, total, n in _sums(batches):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total / max(n, 1)], pa.list_(pa.float64()))], ["block", "values"])

        made = dealt.mapInArrow(fit, "block int, s int, n long, values array<float>").repartition("block").sortWithinPartitions("block", "s")
        rows = made.mapInArrow(average, "block int, values array<double>").orderBy("block").collect()  # the model
        if rows and sum(len(r["values"]) for r in rows) == SIZE:
            flat = np.concatenate([np.array(r["values"], np.float32) for r in rows])
    return flat


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """Weighted sums per block, as the rows come in."""
    block, total, n = None, None, 0
    for batch in batches:
        for b, weight, values in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            own = weight * values.values.to_numpy().astype(np.float64)
            if b != block:
                if block is not None:
                    yield block, total, n
                block, total, n = b, own, weight
            else:
                total, n = total + own, n + weight
    if block is not None:
        yield block, total, n


def _dealt(buckets: int, hashes: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
    """One row per bucket of hashes, with the hashes and the other columns as bytes: words cost bytes in a shuffle, not rows."""
    bucket = (hashes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    columns = [[x[cuts[b] : cuts[b + 1]].tobytes() for b in some] for x in (c[order] for c in (hashes, *others))]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], ["b", *(f"c{k}" for k in range(len(columns)))])


def _gathered(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket, from rows of ``_dealt`` sorted by bucket."""
    for table in grouped(batches, 1):
        yield [np.frombuffer(b"".join(table[f"c{k}"].to_pylist()), kind) for k, kind in enumerate(kinds)]


def _buckets(df: DataFrame) -> int:
    """A bucket's words are a quarter of those of an input partition, whatever the size of the input."""
    return 4 * max(1, df.rdd.getNumPartitions())


def _frequent(rows: DataFrame) -> Vocabulary:
    """The KNOWN most frequent words of all rows, the most frequent first, the smaller hash of equals."""
    buckets, most = _buckets(rows), KNOWN

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)
            held.clear()
            return _dealt(buckets, words, n)

        for batch in batches:
            for part in slices(batch, 0):
                _, hashes, _, codes, _ = _split(part.column(0))
                held.append((hashes, np.bincount(codes, minlength=len(hashes))))
                if sum(len(h) for h, _ in held) > WORDS:
                    yield sent()
        if held:
            yield sent()

    @tidy
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, n in _gathered(batches, np.int64, np.int64):
            words, place = np.unique(hashes, return_inverse=True)
            n = np.bincount(place, n, len(words)).astype(np.int64)
            if len(n) > most:  # no other word of the bucket can be among the most frequent
                least = np.partition(n, -most)[-most]
                above, equal = np.flatnonzero(n > least), np.flatnonzero(n == least)
                own = np.append(above, equal[: most - len(above)])
                words, n = words[own], n[own]
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], ["h", "n"])

    sent = rows.select("t").mapInArrow(count, "b int, c0 binary, c1 binary").repartition("b").sortWithinPartitions("b")
    counted = sent.mapInArrow(total, "h long, n long")
    found = counted.orderBy(F.desc("n"), "h").limit(most).toArrow()  # bounded
    return Vocabulary(found["h"].to_numpy(), found["n"].to_numpy())


def _rare_shares(tokens: DataFrame) -> DataFrame:
    """(id, own): over a row's words that aren't known, the sum of the logarithms of their occurrences in all rows."""
    buckets = _buckets(tokens)

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(words := batch.column(1).flatten()):
                rows = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
                yield _dealt(buckets, words.to_numpy(), rows, batch.column(2).flatten().to_numpy())

    @tidy
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, rows, n in _gathered(batches, np.int64, np.int64, np.int32):
            _, place = np.unique(hashes, return_inverse=True)
            total = np.bincount(place, n)[place]
            some = total > 1  # the logarithm of one occurrence is 0
            ids, place = np.unique(rows[some], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(place, n[some] * np.log(total[some]), len(ids)).astype(np.float64))], ["id", "own"])

    dealt = tokens.select("id", "rare", "many").mapInArrow(deal, "b int, c0 binary, c1 binary, c2 binary").repartition("b").sortWithinPartitions("b")
    return dealt.mapInArrow(share, "id long, own double").groupBy("id").agg(F.sum("own").alias("own"))


def _tokenised(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row: its number, k, the tokens as unsigned 16-bit numbers, the logarithms of known words' counts where tokens are shared, summed, and the other words' hashes and numbers."""
    shared_words = rows.sparkSession.sparkContext.broadcast(vocabulary)  # KNOWN words at most

    @tidy
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, vocabulary = TaskContext.get().partitionId() << 36, shared_words.value
        for batch in batches:
            for part in slices(batch, 1):
                hashes, shared, codes, ends = words_of(part.column(1))
                token, logs = vocabulary.tokens(hashes, shared)
                tokens = token[codes]
                own = [tokens[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]
                places = np.flatnonzero((tokens >= TOKENS - SHARED) & ~np.isnan(logs)[codes])
                owner = np.searchsorted(ends, places, "right") - 1
                sums = np.bincount(owner, logs[codes[places]], part.num_rows).astype(np.float64)
                # Each document's other words, each once, with their number.
                places = np.flatnonzero(np.isnan(logs)[codes])
                owner = np.searchsorted(ends, places, "right") - 1
                pairs, many = np.unique(owner * max(len(hashes), 1) + codes[places], return_counts=True)
                owner, word = np.divmod(pairs, max(len(hashes), 1))
                held = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(held, pa.array(x)) for x in (hashes[word], many.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + part.num_rows)), part.column(0), pa.array(own, pa.binary()), pa.array(sums), *lists], ["id", "k", "w", "known", "rare", "many"])
                number += part.num_rows

    return rows.mapInArrow(tokenise, f"id long, k {dict(rows.dtypes)['k']}, w binary, known double, rare array<long>, many array<int>")


def _token_counts(tokens: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOKENS, np.int64)
        for batch in batches:
            for part in slices(batch, 0, 2 * PART):
                total += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint16), minlength=TOKENS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["token", "n"])

    counts = np.zeros(TOKENS, np.int64)
    for r in tokens.select("w").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # TOKENS rows
        counts[r["token"]] = r["n"]
    return counts


def pseudo_likelihood(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the key, n_tokens, log_likelihood (natural, summed over all tokens), mean_log_likelihood, rare_log_share.

    rare_log_share is the mean, over the document's words that share a token, of
    the logarithm of the word's part of that token's occurrences.  A null or
    empty text, or one without words, has 0 tokens, a sum of 0 and null means.
    Whole texts are scored; repeated rows are scored each.  Scores don't depend
    on how the rows lie in partitions.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    tokens = materialise(_tokenised(rows, _frequent(rows)))
    counts = _token_counts(tokens)
    model = df.sparkSession.sparkContext.broadcast((train(tokens, counts), np.log(np.maximum(counts, 1))))

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, logs = model.value
            for part in slices(batch, 2, 2 * PART):
                padded, places, sizes = _padded(part.column(2).to_pylist())
                shared = padded[places] >= TOKENS - SHARED
                # The words' own counts come in later.
                of = np.append(0, np.cumsum(np.where(shared, -logs[padded[places]], 0)))
                ends = np.append(0, np.cumsum(log_probabilities(flat, padded, places)))
                held = np.append(0, np.cumsum(shared))
                at = np.cumsum(sizes)
                columns = [pa.array(sizes), *(pa.array(x[at] - x[at - sizes]) for x in (ends, of, held))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], part.column(3), *columns], ["id", "k", "known", "n_tokens", "net", "shares", "shared"])

    kind = dict(rows.dtypes)["k"]
    scored = tokens.select("id", "k", "w", "known").mapInArrow(score, f"id long, k {kind}, known double, n_tokens long, net double, shares double, shared long")
    found = scored.join(_rare_shares(tokens), "id", "left").withColumn("shares", F.col("shares") + F.col("known") + F.coalesce("own", F.lit(0.0)))
    sum_of = F.col("net") + F.col("shares")
    return found.select(
        F.col("k").alias(key), "n_tokens", sum_of.alias("log_likelihood"),
        F.when(F.col("n_tokens") > 0, sum_of / F.col("n_tokens")).alias("mean_log_likelihood"),
        F.when(F.col("shared") > 0, F.col("shares") / F.col("shared")).alias("rare_log_share"),
    )
