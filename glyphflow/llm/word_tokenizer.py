"""Token ids by a byte-level BPE file with word ends, as the ``tokenizers`` library gives them.

The file's pre-tokeniser never joins text across white space, so a document's
ids are those of its chunks between spaces, and a batch's different chunks are
encoded once.  If the file states the rules that are written out here, chunks of
ASCII and Latin-1 letters are cut and merged as arrays of bytes; all others,
chunks with an apostrophe or an added token's string, and all chunks of files
with other rules take the library.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import PairTable, merge_ragged
from .common import chunks, ragged

#: Kinds of bytes, for the rules below: letters and bytes of Latin-1 letters, digits, other signs, white space.
LETTER, DIGIT, SIGN, BLANK = 1, 2, 3, 0
# The rules for which ``by_arrays`` is right, as a file states them.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _kinds() -> np.ndarray:
    out = np.full(256, SIGN, np.int8)
    for first, last, kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT)):
        out[ord(first) : ord(last) + 1] = kind
    out[0x80:] = LETTER
    out[[0x09, 0x0A, 0x20]] = BLANK
    return out


def byte_chars() -> list[str]:
    """The usual character for each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(rest)) for b in range(256)]


class WordTokenizer:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        vocab = model["vocab"]
        self.added = [t["content"] for t in spec["added_tokens"]]
        end = model["end_of_word_suffix"] or ""
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.final = np.array([vocab.get(c + end, -1) for c in chars], np.int32)
        rules = spec["normalizer"] == NORMALISER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and not spec["truncation"]
        rules = rules and {k: model.get(k) for k in MODEL} == MODEL and not any(t["normalized"] or t["single_word"] for t in spec["added_tokens"])
        #: Whether the file's rules are those that ``by_arrays`` follows; the library takes every chunk of other files.
        self.plain = bool(rules and (self.inner >= 0).all() and (self.final >= 0).all())
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(*zip(*((vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)), strict=True))
        self.kinds = _kinds()

    def plain_chunks(self, data: np.ndarray, lengths: np.ndarray, distinct: pa.Array) -> np.ndarray:
        """Which chunks are of ASCII signs, tab, line feed and Latin-1 letters alone, which lower case and NFC leave as they are."""
        if not self.plain:
            return np.zeros(len(lengths), bool)
        before = np.append(0, data[:-1]) if len(data) else data
        second = (before == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
        good = ((data > 0x20) & (data < 0x7F) & (data != 0x27)) | (data == 0x09) | (data == 0x0A) | second
        good |= (data == 0xC3) & np.append(second[1:], False) if len(data) else False
        bad = np.append(0, np.cumsum(~good))
        ends = np.cumsum(lengths)
        out = bad[ends] == bad[ends - lengths]
        for text in self.added:
            out &= ~pc.match_substring(distinct, text).to_numpy(zero_copy_only=False)
        return out

    def by_arrays(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks, one after the other, and each chunk's number of them."""
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        data = data + 0x20 * upper.astype(np.uint8)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        kind = self.kinds[data]
        held = kind != BLANK
        # A pre-token is a run of letters, one digit, or a run of other signs.
        begins = np.ones(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (owner[1:] != owner[:-1])
        begins = begins[held]
        data, owner = np.ascontiguousarray(data[held]), owner[held]
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        different = coded.dictionary
        ends = np.frombuffer(different.buffers()[1], np.int32, len(different) + 1)
        raw = np.frombuffer(different.buffers()[2] or b"", np.uint8)[: ends[-1]]
        ids = self.inner[raw]
        ids[ends[1:] - 1] = self.final[raw[ends[1:] - 1]]
        merged, sizes = merge_ragged(ids, np.diff(ends), self.pairs)
        code = coded.indices.to_numpy()
        own = sizes[code]
        flat = merged[ragged((np.cumsum(sizes) - sizes)[code], own)]
        return flat.astype(np.uint32), np.bincount(owner[starts], own, len(lengths)).astype(np.int64)

    def by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of chunks: all of them, and where each chunk's begin and how many it has."""
        ends = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4).astype(np.int64)
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        lengths = np.diff(ends)
        plain = self.plain_chunks(data, lengths, distinct)
        quick, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        whole = data if not len(other) else data[ragged((ends[:-1] - ends[0])[quick], lengths[quick])]
        flat, sizes = [], np.zeros(len(distinct), np.int64)
        for rows, (ids, n) in ((quick, self.by_arrays(whole, lengths[quick])), (other, self.by_library(distinct.take(pa.array(other)).to_pylist()) if len(other) else (np.zeros(0, np.uint32), sizes[:0]))):
            flat.append(ids)
            sizes[rows] = n
        starts = np.zeros(len(distinct), np.int64)
        starts[quick] = np.cumsum(sizes[quick]) - sizes[quick]
        starts[other] = len(flat[0]) + np.cumsum(sizes[other]) - sizes[other]
        return np.concatenate(flat), starts, sizes

    def documents(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end, in ids."""
        offsets, codes, distinct = chunks(texts)
        ids, starts, sizes = self.encode(distinct)
        own = sizes[codes]
        out = ids[ragged(starts[codes], own)].astype("<u4")
        return memoryview(out.tobytes()), np.append(0, np.cumsum(own))[offsets]
