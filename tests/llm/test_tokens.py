"""Token counts, SentencePiece and packing against the libraries."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphflow.llm.bpe import PairTable, agenda, merge_ragged
from glyphflow.llm.packing import pack_documents, plan_bins
from glyphflow.llm.sentencepiece_codec import Codec, sentencepiece_decode, sentencepiece_digests, sentencepiece_encode
from glyphflow.llm.token_counts import count_tokens
from glyphflow.llm.word_tokenizer import WordTokenizer

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=8), st.data())
@settings(max_examples=100, deadline=None)
def test_array_merges_equal_the_agenda(rows, data):
    ranks = data.draw(st.permutations(range(16)))
    left, right, rank, merged = zip(*[(a, b, ranks[4 * a + b], 4 + 4 * a + b) for a in range(4) for b in range(4)], strict=True)
    extra = [(4 + k, k % 4, 16 + k, 30 + k) for k in range(16)]
    left, right, rank, merged = (list(x) + [e[i] for e in extra] for i, x in enumerate((left, right, rank, merged)))
    pairs = PairTable(left, right, rank, merged)
    ids, sizes = merge_ragged(np.array([x for r in rows for x in r], np.int32), np.array([len(r) for r in rows]), pairs)
    want = [agenda(list(r), pairs.one) for r in rows]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_counts(odd, library, nothing):
    for r in count_tokens(odd, PIECE, limit=100).collect():
        text = {x["doc_id"]: x["text"] for x in odd.collect()}[r["doc_id"]] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)
    assert count_tokens(odd, PIECE).count() == odd.count() and count_tokens(nothing, PIECE).count() == 0


def test_codec(odd, library, nothing):
    texts = {x["doc_id"]: x["text"] or "" for x in odd.collect()}
    found = sentencepiece_digests(odd, PIECE).collect()
    assert len(found) == odd.count()
    for r in found:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["corrected"] == 0
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    whole = sentencepiece_encode(odd, PIECE, checked=False)
    for r in sentencepiece_decode(whole, PIECE, out="again").collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == r["again"] == library.decode(ids)
    assert sentencepiece_digests(nothing, PIECE).count() == 0


@given(st.text(alphabet="ab  e▁thé\nqu日.<0x41>", max_size=60))
@settings(max_examples=300, deadline=None)
def test_codec_on_any_text(text):
    global _codec
    try:
        codec, library = _codec
    except NameError:
        codec, library = _codec = Codec(PIECE, checked=False), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert codec.encode(text) == library.encode(text) and codec.decode(library.encode(text)) == library.decode(library.encode(text))
    total, ids, back = codec.documents(pa.array([text, "", text + " x"]))
    for i, t in enumerate((text, "", text + " x")):
        want = library.encode(t)
        assert (total[i], ids[i], back[i]) == (len(want), ",".join(map(str, want)), library.decode(want))


def test_every_document_against_the_library(spark, library):
    """Counts, ids and texts of a driver's whole table, without any correction by the library."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, PIECE).collect()}
    for r in sentencepiece_encode(docs, PIECE, checked=False).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == library.decode(ids) and counts[r["doc_id"]] == len(ids)


def test_every_chunk_against_the_library():
    """All different chunks of a table, and odd ones, by arrays and by the tokenizers library."""
    tokens = WordTokenizer(WORD)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    words = sorted({w for t in texts if t for w in t.split(" ")} | {"", "a", "A1b2,,c\n\tD..e", "ÀÉÞßÿ", "×", "÷x", "Ã", "x×y", "it's", "'", "<|endoftext|>", "日本", "a\u0301", "\r", "\x0b", "9" * 50, "İ", "ﬁ", "\n"})
    flat, starts, sizes = tokens.encode(pa.array(words))
    for w, e, a, n in zip(words, tokens.library.encode_batch(words, add_special_tokens=False), starts, sizes):
        assert flat[a : a + n].tolist() == e.ids, w
    data = pa.array(words)
    assert tokens.plain_chunks(np.frombuffer(data.buffers()[2], np.uint8), np.array([len(w.encode()) for w in words]), data).mean() > 0.9


def test_packing(odd, nothing):
    library = Tokenizer.from_file(WORD)
    found = pack_documents(odd, WORD, 256, with_ids=True).collect()
    want = Counter()
    for r in odd.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            own = ids[at : at + 256]
            want[r["doc_id"], piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in found) == want
    places: dict = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= -(-sum(r["length"] for r in found) // 256) + 1
    assert pack_documents(nothing, WORD).count() == 0


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=51) if lengths else np.zeros(51, int)
    used = np.zeros(51, int)
    for times, held in plan_bins(counts, 50):
        assert times > 0 and sum(s * n for s, n in held.items()) <= 50
        for s, n in held.items():
            used[s] += times * n
    assert (used == counts).all()


def test_two_fit_beats_greedy():
    # Greedy alone: 6+3, then 5+5, 4: three bins. With the swap 6+... stays, 5+5 and 4+3 fit as well.
    plan = plan_bins(np.bincount([6, 3, 2, 2, 7], minlength=11), 10)
    assert sum(t for t, _ in plan) == 2
