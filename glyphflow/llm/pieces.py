"""Reading a merge-type SentencePiece vocabulary, and cutting texts where no merge can cross."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import PairTable

SPACE = "▁"


class Pieces:
    """A vocabulary of the SentencePiece library's BPE kind with byte fallback and no text normalisation.

    Raises ValueError for a model of another kind; such a model would need other rules.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only merge-type vocabularies with byte fallback are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only models that leave the text as it is, with a leading space mark, are supported")
        self.path = path
        self.text = [p.piece for p in model.pieces]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        if any(p.type == 4 for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that hold a space mark behind other text are not supported")
        self.id = {p: i for p, (i, _) in normal.items()}
        by_score = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        #: Equal scores have equal ranks; then the leftmost pair goes first.
        self.rank = {p: by_score[s] for p, (_, s) in normal.items()}

    def pairs(self) -> PairTable:
        """Every way to put a piece together from two pieces."""
        found = [(self.id[p[:k]], self.id[p[k:]], self.rank[p], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        return PairTable(*zip(*found, strict=True))

    def without_mark(self) -> bytes:
        """The vocabulary as the library reads it, less the mark that it would put in front of a text."""
        from sentencepiece import sentencepiece_model_pb2

        with open(self.path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False
        return model.SerializeToString()

    def byte_ids(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()]


#: Runs that merges cannot leave: no piece holds a space mark behind other text.
RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def runs(text: str) -> list[str]:
    """A text with its leading mark and marks for spaces, cut into runs; an empty text has none."""
    return RUN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def irregular(chunks: pa.Array) -> np.ndarray:
    """Chunks that cannot stand for a run of their own: empty ones (a space follows a space) and those ending with a mark."""
    return pc.or_(pc.equal(chunks, ""), pc.ends_with(chunks, SPACE)).to_numpy(zero_copy_only=False)


def code_points(chunks: pa.Array) -> np.ndarray:
    """The code points of all chunks, one after the other."""
    ends = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, chunks.offset * 4)
    data = (chunks.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[ends[0] : ends[-1]]
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)


def marked(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all chunks, each with the mark in front, and each one's number of them."""
    lengths = pc.utf8_length(chunks).to_numpy().astype(np.int64) + 1
    points = np.full(lengths.sum(), ord(SPACE), np.uint32)
    inside = np.ones(len(points), bool)
    inside[np.cumsum(lengths) - lengths] = False
    points[inside] = code_points(chunks)
    return points, lengths


class Crossings:
    """Which neighbouring characters stand together in some piece; no merge joins any others."""

    BITS = 20

    def __init__(self, pieces: Pieces):
        self.table = np.zeros(1 << self.BITS, bool)
        pairs = sorted({p[i : i + 2] for p in pieces.id for i in range(len(p) - 1)})
        points = np.frombuffer("".join(pairs).encode("utf-32-le"), np.uint32).reshape(-1, 2)
        self.table[self._place(points[:, 0], points[:, 1])] = True

    def _place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs that fall on one place count as joined if either is: a cut too few does no harm."""
        return (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - self.BITS)

    def begins(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Where parts begin that merges cannot leave, in texts of ``lengths`` one after the other."""
        out = np.ones(len(points), bool)
        out[1:] = ~self.table[self._place(points[:-1], points[1:])]
        out[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        return out


def strings(points: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Texts that begin at ``begins``, from code points."""
    size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.append(0, np.cumsum(size))[np.append(np.flatnonzero(begins), len(points))].astype(np.int32)
    data = points.tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
