"""Models behind one protocol, held once per Python worker."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np


class Models(Protocol):
    """detect: (1, 3, H, W) -> (1, 1, H, W); classify: (N, 3, 80, 160) -> (N, 2) or None; recognise: (N, 3, 48, W) -> (N, T, C)."""

    def detect(self, tensor: np.ndarray) -> np.ndarray: ...

    def classify(self, tensor: np.ndarray) -> np.ndarray | None: ...

    def recognise(self, tensor: np.ndarray) -> np.ndarray: ...

    def close(self) -> None: ...


#: What a worker has loaded, by loader; published only when it is complete.
_LOADED: dict[object, Models] = {}


def loaded(loader: Callable[[], Models]) -> Models:
    if loader not in _LOADED:
        models = loader()
        _LOADED[loader] = models
    return _LOADED[loader]


def release(loader: Callable[[], Models]) -> None:
    models = _LOADED.pop(loader, None)
    if models is not None:
        models.close()


@dataclass(frozen=True)
class OnnxLoader:
    """Loads ONNX files of a folder that every executor has; sessions are made when first asked for.

    A folder without a classifier gives no orientations.  Sessions are made
    afresh after ``recycle`` runs, which bounds what an arena keeps for the many
    shapes that batches have.
    """

    folder: str
    detector: str = "detector.onnx"
    classifier: str = "classifier.onnx"
    recogniser: str = "recogniser.onnx"
    recycle: int = 1000
    options: tuple[tuple[str, str], ...] = ()

    def __call__(self) -> Models:
        return _Onnx(self)


class _Onnx:
    def __init__(self, spec: OnnxLoader):
        self.spec, self.sessions, self.runs = spec, {}, 0
        for name in (spec.detector, spec.recogniser):
            if not os.path.exists(os.path.join(spec.folder, name)):
                raise FileNotFoundError(os.path.join(spec.folder, name))

    def _run(self, name: str, tensor: np.ndarray) -> np.ndarray:
        import onnxruntime

        self.runs += 1
        if self.runs % self.spec.recycle == 0:
            self.sessions.clear()
        if name not in self.sessions:
            have = onnxruntime.get_available_providers()
            chosen = [("CUDAExecutionProvider", dict(self.spec.options))] if "CUDAExecutionProvider" in have else []
            self.sessions[name] = onnxruntime.InferenceSession(os.path.join(self.spec.folder, name), providers=[*chosen, "CPUExecutionProvider"])
        session = self.sessions[name]
        return session.run(None, {session.get_inputs()[0].name: tensor})[0]

    def detect(self, tensor):
        return self._run(self.spec.detector, tensor)

    def classify(self, tensor):
        return self._run(self.spec.classifier, tensor) if os.path.exists(os.path.join(self.spec.folder, self.spec.classifier)) else None

    def recognise(self, tensor):
        return self._run(self.spec.recogniser, tensor)

    def close(self) -> None:
        self.sessions.clear()


@dataclass(frozen=True)
class StubLoader:
    """Deterministic stand-ins for tests: dark pixels are text, a crop is upright, and its text is its darkness per step."""

    classes: int = 8
    orientation: bool = True

    def __call__(self) -> Models:
        return _Stub(self)


class _Stub:
    def __init__(self, spec: StubLoader):
        self.spec = spec

    def detect(self, tensor):
        return (tensor.mean(axis=1, keepdims=True) < 0).astype(np.float32) * 0.9

    def classify(self, tensor):
        if not self.spec.orientation:
            return None
        half = tensor.shape[3] // 2
        left, right = tensor[..., :half].mean(axis=(1, 2, 3)), tensor[..., half:].mean(axis=(1, 2, 3))
        return np.stack([left - 1e-3, right], axis=1)

    def recognise(self, tensor):
        n, _, _, width = tensor.shape
        steps = tensor[:, :, :, : width - width % 8].mean(axis=(1, 2)).reshape(n, -1, 8).mean(axis=2)
        level = np.clip(((1 - steps) / 2 * (self.spec.classes - 1)).round().astype(int), 0, self.spec.classes - 1)
        return np.eye(self.spec.classes, dtype=np.float32)[level] * 0.9 + 0.01

    def close(self) -> None:
        pass
