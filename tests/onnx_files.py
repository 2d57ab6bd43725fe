"""Small ONNX files, written field by field: the same stand-ins as inference.StubLoader, for the real runtime."""

from __future__ import annotations

import struct

FLOAT, INT64 = 1, 7


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _message(*fields: tuple[int, object]) -> bytes:
    return b"".join(_field(n, v) for n, v in fields)


def _attribute(name: str, value) -> bytes:
    if isinstance(value, list):
        return _message((1, name), *[(8, v) for v in value], (20, 7))
    return _message((1, name), (3, value), (20, 2))


def node(kind: str, inputs: list[str], output: str, **attributes) -> bytes:
    return _message(*[(1, i) for i in inputs], (2, output), (4, kind), *[(5, _attribute(k, v)) for k, v in attributes.items()])


def constant(name: str, values: list[float], dims: list[int], kind: int = FLOAT) -> bytes:
    raw = struct.pack(f"<{len(values)}{'f' if kind == FLOAT else 'q'}", *values)
    return _message(*[(1, d) for d in dims], (2, kind), (8, name), (9, raw))


def _value(name: str, dims: list[str | int]) -> bytes:
    shape = _message(*[(1, _message((1, d) if isinstance(d, int) else (2, d))) for d in dims])
    return _message((1, name), (2, _message((1, _message((1, FLOAT), (2, shape))))))


def model(nodes: list[bytes], constants: list[bytes], taking: list[str | int], giving: list[str | int]) -> bytes:
    graph = _message(*[(1, n) for n in nodes], (2, "g"), *[(5, c) for c in constants], (11, _value("x", taking)), (12, _value("y", giving)))
    return _message((1, 8), (7, graph), (8, _message((1, ""), (2, 13))))


def detector() -> bytes:
    nodes = [node("ReduceMean", ["x"], "m", axes=[1], keepdims=1), node("Less", ["m", "zero"], "dark"), node("Cast", ["dark"], "f", to=FLOAT), node("Mul", ["f", "sure"], "y")]
    return model(nodes, [constant("zero", [0.0], [1]), constant("sure", [0.9], [1])], ["n", 3, "h", "w"], ["n", 1, "h", "w"])


def recogniser(classes: int = 8) -> bytes:
    top = float(classes - 1)
    nodes = [
        node("ReduceMean", ["x"], "m", axes=[1, 2], keepdims=1),
        node("AveragePool", ["m"], "s", kernel_shape=[1, 8], strides=[1, 8]),
        node("Sub", ["one", "s"], "d"),
        node("Mul", ["d", "scale"], "r"),
        node("Clip", ["r", "low", "high"], "c"),
        node("Round", ["c"], "o"),
        node("Cast", ["o"], "i", to=INT64),
        node("Squeeze", ["i", "axes"], "k"),
        node("OneHot", ["k", "depth", "values"], "y", axis=-1),
    ]
    constants = [constant("one", [1.0], [1]), constant("scale", [top / 2], [1]), constant("low", [0.0], []), constant("high", [top], []), constant("axes", [1, 2], [2], INT64), constant("depth", [classes], [1], INT64), constant("values", [0.01, 0.91], [2])]
    return model(nodes, constants, ["n", 3, 48, "w"], ["n", "t", classes])


def classifier() -> bytes:
    """Every crop is the other way round."""
    nodes = [node("ReduceMean", ["x"], "m", axes=[1, 2, 3], keepdims=0), node("Mul", ["m", "zero"], "z"), node("Unsqueeze", ["z", "axes"], "a"), node("Add", ["a", "one"], "b"), node("Concat", ["a", "b"], "y", axis=1)]
    return model(nodes, [constant("zero", [0.0], [1]), constant("one", [1.0], [1]), constant("axes", [1], [1], INT64)], ["n", 3, 80, 160], ["n", 2])
