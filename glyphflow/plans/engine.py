"""The two ways from images to text: tiled in one narrow pass, or detection and recognition as two stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from enum import StrEnum
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS, Settings
from glyphflow.functions import raster
from glyphflow.operators.ctc import decode_numpy, with_extra
from glyphflow.operators.ordering import order_rows, reading_order
from glyphflow.operators.suppression import suppress, suppress_rows
from glyphflow.operators.tiling import keep_core
from glyphflow.plans.inference import Models, loaded, release
from glyphflow.schema import BOX, RESULT, RESULT_WITH_PIXELS
from glyphflow.storage import materialise


class EngineType(StrEnum):
    TILED = "tiled"
    TWO_PHASE = "two-phase"


class Engine(Protocol):
    def transform(self, images: DataFrame, keep_pixels: bool = False) -> DataFrame:
        """Rows of schema.RESULT for rows of schema.IMAGE, one each, in any order; with ``keep_pixels`` also height, width and data."""
        ...


@dataclass(frozen=True)
class EngineConfig:
    """``loader`` makes the models in a worker; ``mask``: 0 or minus infinity per class of ``dictionary``.

    A recogniser may have a class behind the dictionary, such as the space, which
    gives nothing unless ``extra_chars`` names its character.
    """

    loader: Callable[[], Models]
    dictionary: tuple[str, ...]
    mask: tuple[float, ...] | None = None
    extra_chars: tuple[str, ...] = ()
    least_score: float = DEFAULTS.drop_score
    settings: Settings = DEFAULTS


def create_engine(kind: EngineType | str, config: EngineConfig) -> Engine:
    """ValueError for an unknown kind."""
    return {EngineType.TILED: TiledEngine, EngineType.TWO_PHASE: TwoPhaseEngine}[EngineType(kind)](config)


# ---- steps on one image, in a worker -------------------------------------------------------------------------


def pixels(raw: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 3)


def detect_whole(image: np.ndarray, models: Models, s: Settings) -> tuple[list[np.ndarray], list[float]]:
    tensor, h, w = raster.detector_input(image, s)
    return raster.boxes_of_map(models.detect(tensor)[0, 0], h, w, s)


def tile_places(height: int, width: int, s: Settings) -> list[tuple[int, int, int, int]]:
    """y1, x1, y2, x2, row by row, as tiling.with_tiles has them."""

    def starts(side: int) -> range:
        return range(0) if side <= 0 else range(0, max(1, -(-(side - s.tile) // s.stride) + 1) * s.stride, s.stride) if side > s.tile else range(1)

    return [(y, x, min(y + s.tile, height), min(x + s.tile, width)) for y in starts(height) for x in starts(width)]


def _within_core(box: np.ndarray, tile: tuple[int, int, int, int], height: int, width: int, s: Settings) -> bool:
    (y1, x1, y2, x2), margin = tile, s.overlap / 2
    cx, cy = box.mean(axis=0)
    across = (x1 + margin if x1 > 0 else x1) <= cx <= (x2 - margin if x2 < width else x2)
    return across and (y1 + margin if y1 > 0 else y1) <= cy <= (y2 - margin if y2 < height else y2)


def detect_tiled(image: np.ndarray, models: Models, s: Settings) -> tuple[list[np.ndarray], list[float]]:
    h, w = image.shape[:2]
    boxes, scores = [], []
    for tile in tile_places(h, w, s):
        y1, x1, y2, x2 = tile
        for box, score in zip(*detect_whole(image[y1:y2, x1:x2], models, s), strict=True):
            box = box + np.array([x1, y1], np.int32)
            if _within_core(box, tile, h, w, s):
                boxes.append(box)
                scores.append(score)
    if not boxes:
        return [], []
    all_boxes, all_scores = np.stack(boxes), np.array(scores)
    sides = np.concatenate([all_boxes.min(axis=1), all_boxes.max(axis=1)], axis=1)
    kept = suppress_rows(all_scores, np.arange(len(boxes)), sides, s.overlap_iou)
    return [boxes[k] for k in kept], [scores[k] for k in kept]


def in_reading_order(boxes: list[np.ndarray], s: Settings) -> list[int]:
    """Places of boxes in reading order, by top left corners."""
    if not boxes:
        return []
    x, y = np.array([b[0] for b in boxes], np.int64).T
    return order_rows(x, y, np.arange(len(boxes)), s.same_line)


def read_crops(crops: list[np.ndarray], models: Models, config: EngineConfig) -> list[tuple[str, float, int]]:
    """(text, score, angle) of an image's crops in order; batches never hold crops of two images."""
    s, angles = config.settings, [0] * len(crops)
    for at in range(0, len(crops), s.cls_batch):
        part = crops[at : at + s.cls_batch]
        found = models.classify(raster.classifier_input(part, s))
        if found is not None:
            angles[at : at + len(part)] = found.argmax(axis=1).tolist()
    crops = [raster.turned(c) if a == 1 else c for c, a in zip(crops, angles, strict=True)]
    dictionary, mask = with_extra(list(config.dictionary), None if config.mask is None else list(config.mask), list(config.extra_chars))
    mask = None if mask is None else np.array(mask, np.float32)
    texts: list[tuple[str, float]] = []
    for at in range(0, len(crops), s.rec_batch):
        texts += decode_numpy(models.recognise(raster.recogniser_input(crops[at : at + s.rec_batch], s)), dictionary, mask)
    return [(text, score, angle) for (text, score), angle in zip(texts, angles, strict=True)]


def items_of(boxes: list[np.ndarray], crops: list[np.ndarray], models: Models, config: EngineConfig) -> list[dict]:
    """Items for boxes that are in reading order, and their crops."""
    if not boxes:
        return []
    found = read_crops(crops, models, config)
    return [
        {"text": text, "score": score, "polygon": box.astype(int).tolist(), "angle": angle}
        for box, (text, score, angle) in zip(boxes, found, strict=True)
        if not score < config.least_score and text.strip()
    ]


def crops_of(image: np.ndarray, boxes: list[np.ndarray], s: Settings) -> list[np.ndarray]:
    return [raster.straighten(image, b, s) for b in boxes]


def _result(path: str, items: list[dict], kept: tuple[int, int, bytes] | None) -> pa.RecordBatch:
    item = pa.struct([("text", pa.string()), ("score", pa.float64()), ("polygon", pa.list_(pa.list_(pa.int32()))), ("angle", pa.int32())])
    columns = [pa.array([path], pa.string()), pa.array([len(items)], pa.int32()), pa.array([items], pa.list_(item))]
    if kept is not None:
        columns += [pa.array([x], t) for x, t in zip(kept, (pa.int32(), pa.int32(), pa.binary()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, RESULT_WITH_PIXELS.names[: len(columns)])


# ---- plans ---------------------------------------------------------------------------------------------------


class TiledEngine:
    """Detection on overlapping tiles; the whole way of an image in one task, nothing shuffled."""

    def __init__(self, config: EngineConfig):
        self.config = config

    def transform(self, images: DataFrame, keep_pixels: bool = False) -> DataFrame:
        config = self.config

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = loaded(config.loader)
            for batch in batches:
                for path, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    image = pixels(raw, h, w)
                    boxes, _ = detect_tiled(image, models, config.settings)
                    boxes = [boxes[k] for k in in_reading_order(boxes, config.settings)]
                    items = items_of(boxes, crops_of(image, boxes, config.settings), models, config)
                    yield _result(path, items, (h, w, raw) if keep_pixels else None)

        return images.select("path", "height", "width", "data").mapInArrow(run, RESULT_WITH_PIXELS if keep_pixels else RESULT)

    def boxes(self, images: DataFrame) -> DataFrame:
        """(path, box_idx, polygon, det_score), for images so large that their tiles should be tasks of their own.

        A tile's pixels are cut out where the image lies and dealt out by image
        and tile, so that a task holds tiles, not images; then boxes are shuffled.
        """
        config = self.config
        s = config.settings
        tile_type = "struct<y1:int,x1:int,y2:int,x2:int>"

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.struct([(n, pa.int32()) for n in ("y1", "x1", "y2", "x2")])
            for batch in batches:
                for path, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    image = pixels(raw, h, w)
                    for number, (y1, x1, y2, x2) in enumerate(tile_places(h, w, s)):
                        tile = {"y1": y1, "x1": x1, "y2": y2, "x2": x2}
                        columns = [pa.array([path], pa.string()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([number], pa.int32()), pa.array([tile], kind)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([np.ascontiguousarray(image[y1:y2, x1:x2]).tobytes()], pa.binary())], ["path", "h", "w", "tile_no", "tile", "data"])

        cut_out = images.select("path", "height", "width", "data").mapInArrow(cut, f"path string, h int, w int, tile_no int, tile {tile_type}, data binary")
        cut_out = cut_out.repartition("path", "tile_no")

        def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = loaded(config.loader)
            for batch in batches:
                for k in range(batch.num_rows):
                    path, h, w, number, tile, raw = (c[k].as_py() for c in batch.columns)
                    part = pixels(raw, tile["y2"] - tile["y1"], tile["x2"] - tile["x1"])
                    boxes, scores = detect_whole(part, models, s)
                    n = len(boxes)
                    moved = [(b + np.array([tile["x1"], tile["y1"]], np.int32)).tolist() for b in boxes]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n, pa.string()), pa.array([h] * n, pa.int32()), pa.array([w] * n, pa.int32()), pa.array([number * 100_000 + i for i in range(n)], pa.int64()),
                         pa.array([tile] * n, batch.column(4).type), pa.array(moved, pa.list_(pa.list_(pa.int32()))), pa.array(scores, pa.float64())],
                        ["path", "h", "w", "id", "tile", "polygon", "score"],
                    )

        found = cut_out.mapInArrow(detect, f"path string, h int, w int, id long, tile {tile_type}, polygon array<array<int>>, score double")
        kept = keep_core(found, s=s)
        sides = [_side("polygon", k, low) for low in (True, False) for k in (0, 1)]
        flat = kept.select("path", "id", "score", *[c.alias(n) for c, n in zip(sides, ("x1", "y1", "x2", "y2"), strict=True)], "polygon")
        placed = reading_order(suppress(flat, "path", s.overlap_iou).withColumns({"cx": F.col("polygon")[0][0], "cy": F.col("polygon")[0][1]}), "path", "cx", "cy", "id", s.same_line)
        return placed.select("path", F.col("box_idx").cast("int").alias("box_idx"), "polygon", F.col("score").alias("det_score"))


def _side(polygon: str, axis: int, low: bool):
    values = F.transform(polygon, lambda p: p[axis])
    return F.array_min(values) if low else F.array_max(values)


class TwoPhaseEngine:
    """Whole-image detection for all images, then recognition; a stage has only its own models loaded.

    What lies between, boxes and their straightened crops, is written to shared
    storage.  Nothing is shuffled, and an image is decoded once.
    """

    def __init__(self, config: EngineConfig):
        self.config = config

    def boxes(self, images: DataFrame) -> DataFrame:
        """(path, boxes): each image's boxes in reading order."""
        return self._detected(images, False, False).select("path", "boxes")

    def _detected(self, images: DataFrame, cut: bool, keep_pixels: bool) -> DataFrame:
        """(path, boxes, crops, height, width, data): crops as (height, width, data); empty or null where they are not asked for."""
        config = self.config
        crop = "struct<height:int,width:int,data:binary>"

        def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = loaded(config.loader)
            box_kind = pa.list_(pa.struct([("polygon", pa.list_(pa.list_(pa.int32()))), ("det_score", pa.float64())]))
            crop_kind = pa.list_(pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))
            for batch in batches:
                for path, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    image = pixels(raw, h, w)
                    boxes, scores = detect_whole(image, models, config.settings)
                    order = in_reading_order(boxes, config.settings)
                    rows = [{"polygon": boxes[k].tolist(), "det_score": scores[k]} for k in order]
                    crops = crops_of(image, [boxes[k] for k in order], config.settings) if cut else []
                    held = [{"height": c.shape[0], "width": c.shape[1], "data": c.tobytes()} for c in crops]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path], pa.string()), pa.array([rows], box_kind), pa.array([held], crop_kind), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([raw if keep_pixels else None], pa.binary())],
                        ["path", "boxes", "crops", "height", "width", "data"],
                    )
            release(config.loader)

        return images.select("path", "height", "width", "data").mapInArrow(detect, f"path string, boxes array<{BOX.simpleString()}>, crops array<{crop}>, height int, width int, data binary")

    def transform(self, images: DataFrame, keep_pixels: bool = False) -> DataFrame:
        return self._recognised(materialise(self._detected(images, True, keep_pixels)), keep_pixels)

    def _recognised(self, detected: DataFrame, keep_pixels: bool) -> DataFrame:
        config = self.config

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = loaded(config.loader)
            for batch in batches:
                for path, boxes, crops, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = [np.array(b["polygon"], np.int32) for b in boxes]
                    items = items_of(own, [pixels(c["data"], c["height"], c["width"]) for c in crops], models, config)
                    yield _result(path, items, (h, w, raw) if keep_pixels else None)
            release(config.loader)

        return detected.mapInArrow(read, RESULT_WITH_PIXELS if keep_pixels else RESULT)

    def run_batch(self, images: DataFrame, on_detected: Callable[[int, str], None] | None = None, on_read: Callable[[int, str], None] | None = None) -> DataFrame:
        """Results, written to shared storage; each callback gets every image's place, in the order of paths, and path when its stage is done.

        Only paths come to the driver, and only where a callback is given.
        """

        def tell(done: DataFrame, path: str, callback: Callable[[int, str], None] | None) -> None:
            if callback is not None:
                for place, row in enumerate(done.select(path).orderBy(path).toLocalIterator()):
                    callback(place, row[0])

        detected = materialise(self._detected(images, True, False))
        tell(detected, "path", on_detected)
        results = materialise(self._recognised(detected, False))
        tell(results, "input_path", on_read)
        return results
