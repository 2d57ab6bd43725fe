"""Pixel kernels: the same values as by definition, for less work; queries that deal their rows out."""

import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from glyphflow.config import DEFAULTS
from glyphflow.functions import raster
from glyphflow.operators import characters
from glyphflow.plans import kernel_queries, sinks  # noqa: F401 (registers its queries)
from glyphflow.plans.contract import QUERIES

from .conftest import DATA


def sampled(image, width, height):
    """Resizing by definition: every place on its own."""
    h, w = image.shape[:2]
    x = (np.arange(width) + 0.5) * (w / width) - 0.5
    y = (np.arange(height) + 0.5) * (h / height) - 0.5
    return raster.sample(image, *np.meshgrid(x, y))


def peak_of(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def calls_of(f):
    """Calls, of Python and of C functions, that something takes: its work on small images, whatever the machine."""
    n = 0

    def see(*_):
        nonlocal n
        n += 1

    f()
    sys.setprofile(see)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def random_image(g, h, w):
    return g.integers(0, 256, (h, w, 3)).astype(np.uint8)


def test_resizing_equals_sampling_of_every_place():
    g = np.random.default_rng(0)
    for h, w, height, width in [(1, 1, 9, 7), (30, 1, 7, 90), (17, 23, 80, 160), (50, 70, 20, 33), (40, 200, 200, 300)]:
        image = random_image(g, h, w)
        assert np.array_equal(raster.resize(image, width, height), sampled(image, width, height))


def test_classifier_inputs_are_made_block_by_block():
    g = np.random.default_rng(1)
    crops = [random_image(g, 20, 30), random_image(g, 90, 200)]
    w, h = DEFAULTS.cls_size
    found = raster.classifier_input(crops)
    for own, crop in zip(found, crops, strict=True):
        want = (sampled(crop, w, h).astype(np.float32) / 255 - np.array(DEFAULTS.det_mean, np.float32)) / np.array(DEFAULTS.det_std, np.float32)
        assert np.array_equal(own, want.transpose(2, 0, 1))
    assert peak_of(lambda: raster.classifier_input(crops[:1])) < 6 * found[:1].nbytes


@pytest.mark.parametrize("name", ["classifier_inputs", "detector_inputs", "resize_double"])
def test_ids_are_dealt_out_to_all_tasks(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= 16


def test_recogniser_batches_are_made_block_by_block():
    g = np.random.default_rng(2)
    crops = [random_image(g, 12, 70), random_image(g, 40, 90), random_image(g, 9, 100)]
    found = raster.recogniser_input(crops)
    assert found.shape[3] == int(48 * 100 / 9)
    for own, crop in zip(found, crops, strict=True):
        used = min(found.shape[3], int(np.ceil(48 * crop.shape[1] / crop.shape[0])))
        want = (sampled(crop, used, 48).astype(np.float32) / 255 - 0.5) / 0.5
        assert np.array_equal(own[:, :, :used], want.transpose(2, 0, 1)) and not own[:, :, used:].any()
    assert peak_of(lambda: raster.recogniser_input(crops)) < 2 * found.nbytes + 2**20


def test_json_of_a_batch_is_made_result_by_result():
    import json

    item = {"text": "a", "score": 0.5, "polygon": [[1, 2], [3, 2], [3, 4], [1, 4]], "angle": 0}
    kind = pa.list_(pa.struct({"text": pa.string(), "score": pa.float64(), "polygon": pa.list_(pa.list_(pa.int32())), "angle": pa.int32()}))
    one = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([300], pa.int32()), pa.array([[item] * 300], kind)], ["page", "text_count", "items"])
    batch = pa.concat_batches([one] * 200)
    most, found = 0, 0

    def read():
        nonlocal most, found
        for made in sinks.json_rows(iter([batch]), ["page", "json"]):
            assert made.column(0).to_pylist() == [7] * made.num_rows
            assert json.loads(made.column(1)[0].as_py()) == {"input_path": "7", "text_count": 300, "items": [item] * 300}
            most, found = max(most, made.nbytes), found + made.num_rows

    peak = peak_of(read)
    assert found == 200 and most < 5 * 2**20
    # All rows at once were 60,000 items as Python objects and all their JSON.
    assert peak < 20 * 2**20
    assert not list(sinks.json_rows(iter([batch.slice(0, 0)]), ["page", "json"]))


def test_characters_are_counted_in_slices(spark, monkeypatch):
    monkeypatch.setattr(characters, "_SLICE", 10)
    texts = ["", None, "a" * 25, "é😀", "bc" * 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"]) for t in (texts, texts)]
    parts = list(characters._slices(iter(batches)))
    assert "".join(parts) == "".join(t or "" for t in texts) * 2 and max(map(len, parts)) < 20
    found = characters.character_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert dict(map(tuple, found.collect())) == {"a": 25, "é": 1, "😀": 1, "b": 4, "c": 4}


def flooded(mask, diagonal):
    """Each connected part as a set of cells (y, x), by flooding, in scan order of first cells."""
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    left, parts = set(map(tuple, np.argwhere(mask).tolist())), []
    while left:
        todo = [min(left)]
        left.remove(todo[0])
        part = set(todo)
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a, b in steps} & left
            left -= near
            part |= near
            todo += near
        parts.append(part)
    return parts


def test_outlines_equal_those_by_flooding():
    g = np.random.default_rng(3)
    beside = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    for share in (0.1, 0.3, 0.5, 0.6, 0.7, 0.9, 1):
        for _ in range(6):
            mask = g.random(g.integers(1, 26, 2)) < share
            unset = ~np.pad(mask, 1)
            outer, *holes = flooded(unset, False)
            gaps = outer.union(*holes)
            want = [{(y + 1, x + 1) for y, x in part} for part in flooded(mask, True)]
            want = [{(y, x) for y, x in part if any((y + a, x + b) in gaps for a, b in beside)} for part in want]
            want += [{(y + a, x + b) for y, x in hole for a, b in beside} - hole for hole in holes]
            found = [{(y + 1, x + 1) for x, y in points.tolist()} for points in raster.contours(mask)]
            assert sorted(map(sorted, found)) == sorted(map(sorted, want))


def test_outlines_and_fills_take_few_calls():
    mask = np.zeros((30, 30), bool)
    mask[3:20, 2:18] = True
    assert calls_of(lambda: raster.contours(mask)) < 300  # were 1,035
    mask[6:8, 5:8] = False
    assert calls_of(lambda: raster.contours(mask)) < 600  # were 1,467
    lines = np.zeros((300, 300), bool)
    lines[::3] = True
    assert calls_of(lambda: raster.contours(lines)) < 5000  # were 8,079


def test_fills_equal_those_pixel_by_pixel():
    g = np.random.default_rng(4)
    shapes = [np.array([[2, 3], [14, 3], [14, 15], [2, 15]]), np.array([[-5, 4], [60, 4], [60, 9], [-5, 9]]), np.array([[50, 50], [60, 50], [60, 60], [50, 60]])]
    for p in shapes + [g.integers(-5, 40, (4, 2)) for _ in range(40)]:
        want = np.zeros((28, 35), bool)
        for y in range(28):
            for x in range(35):
                odd = edge = False
                for (ax, ay), (bx, by) in zip(p.tolist(), np.roll(p, -1, axis=0).tolist(), strict=True):
                    cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                    edge |= min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by) and abs(cross) <= 0.5 * max(abs(bx - ax), abs(by - ay), 1e-9)
                    odd ^= (ay > y) != (by > y) and (cross > 0) == (by < ay)
                want[y, x] = odd or edge
        assert np.array_equal(raster.inside(p, 35, 28), want)


def test_drawing_takes_few_calls_and_keeps_within_the_image():
    items = [{"polygon": [[4, 5], [24, 5], [24, 17], [4, 17]], "score": 0.5, "angle": 1}]
    image = np.full((40, 50, 3), 255, np.uint8)
    assert calls_of(lambda: raster.draw_boxes(image, items)) < 420  # were 483
    over = [{"polygon": [[-9, -5], [70, -5], [70, 60], [-9, 60]], "score": 0.95, "angle": 0}, {"polygon": [[60, 60], [70, 60], [70, 70], [60, 70]], "score": 0.95, "angle": 0}]
    assert (raster.draw_boxes(image, over) == [217, 247, 217]).all()
    assert (raster.draw_boxes(image, over[1:]) == image).all()


def test_boxes_of_a_map_take_few_calls():
    prob = np.zeros((96, 128), np.float32)
    prob[20:40, 15:55] = 0.8
    assert calls_of(lambda: raster.boxes_of_map(prob, 192, 256)) < 1200  # were 2,745


def test_hulls_hold_their_points():
    g = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 30, 200):
        for most in (1, 4, 40):
            points = g.integers(0, most, (n, 2))
            p = raster.hull(points)
            assert set(map(tuple, p.tolist())) <= set(map(tuple, points.tolist()))
            a, b = p, np.roll(p, -1, axis=0)
            if len(p) > 2:
                cross = (b - a)[:, 0] * (points[:, None, 1] - a[:, 1]) - (b - a)[:, 1] * (points[:, None, 0] - a[:, 0])
                assert (cross >= 0).all()


def test_many_small_masks_and_polygons_at_once():
    g = np.random.default_rng(6)
    for share in (0, 0.3, 0.6, 0.9, 1):
        masks = g.random((12, *g.integers(1, 20, 2))) < share
        for own, mask in zip(raster.contours_of(masks), masks, strict=True):
            want = raster.contours(mask)
            assert len(own) == len(want) and all(np.array_equal(a, b) for a, b in zip(own, want, strict=True))
    polygons = g.integers(-5, 40, (20, 4, 2))
    assert np.array_equal(raster.inside_of(polygons, 35, 28), [raster.inside(p, 35, 28) for p in polygons])
    masks = np.zeros((64, 30, 30), bool)
    masks[:, 3:20, 2:18] = True
    masks[::2, 6:8, 5:8] = False
    assert calls_of(lambda: raster.contours_of(masks)) < 64 * 60  # one by one up to 295 each
