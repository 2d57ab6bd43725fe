"""Kernels, sources, engines and sinks on drawn images."""

import json
import struct

import numpy as np
import pytest

from glyphflow.config import Settings
from glyphflow.functions import raster
from glyphflow.operators.ctc import decode_numpy
from glyphflow.plans import cli, sinks
from glyphflow.plans.engine import EngineConfig, EngineType, TiledEngine, create_engine
from glyphflow.plans.inference import OnnxLoader, StubLoader
from glyphflow.schema import RESULT
from glyphflow.sources.dictionaries import allowed_characters, character_dictionary
from glyphflow.sources.images import NoImages, list_images, read_images, unsupported

from . import onnx_files

DICT = ("blank", *"abcdef")


def drawn(h, w, boxes):
    image = np.full((h, w, 3), 255, np.uint8)
    for x1, y1, x2, y2 in boxes:
        image[y1:y2, x1:x2] = 0
    return image


def save(path, image):
    path.write_bytes(raster.png(image))


def grey(path, values):
    import zlib

    rows = b"".join(b"\0" + bytes(r) for r in values)

    def chunk(n, d):
        return struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(values[0]), len(values), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_channels_and_bad_files(spark, tmp_path):
    save(tmp_path / "c.png", np.array([[[0, 0, 255], [255, 0, 0]]], np.uint8))  # red, blue
    grey(tmp_path / "g.PNG", [[7, 9]])
    (tmp_path / "notes.txt").write_text("x")
    found = {r["path"].rsplit("/", 1)[1]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert set(found) == {"c.png", "g.PNG"}
    assert list(found["c.png"]["data"]) == [0, 0, 255, 255, 0, 0]
    assert list(found["g.PNG"]["data"]) == [7, 7, 7, 9, 9, 9]
    (tmp_path / "bad.PNG").write_bytes(b"no image")
    assert read_images(spark, str(tmp_path), strict=False).count() == 2
    with pytest.raises(Exception, match="bad.PNG"):
        read_images(spark, str(tmp_path)).collect()


def test_listing(spark, tmp_path):
    for name in ("b.png", "a.JPG", "n.txt", "w.webp"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.png").write_bytes(b"x")
    found = list_images(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in found.collect()] == ["a.JPG", "b.png", "w.webp"]
    assert unsupported(found).count() == 1
    assert list_images(spark, str(tmp_path / "n.txt")).count() == 1
    (tmp_path / "empty").mkdir()
    for path in (tmp_path / "empty", tmp_path / "missing"):
        with pytest.raises(NoImages):
            list_images(spark, str(path))


def test_dictionaries(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\n\n b \nc\n")
    assert character_dictionary(spark, str(tmp_path / "d.txt")) == ["blank", "a", "", "b", "c"]
    (tmp_path / "s.txt").write_text("a\n\na\n　\nb")
    assert {r["ch"] for r in allowed_characters(spark, str(tmp_path / "s.txt")).collect()} == {"a", "b"}


def test_rotated_rectangle():
    angle, centre, sides = 0.4, np.array([60, 50]), (50, 20)
    e, n = np.array([np.cos(angle), np.sin(angle)]), np.array([-np.sin(angle), np.cos(angle)])
    y, x = np.mgrid[:100, :120]
    d = np.stack([x, y], axis=-1) - centre
    mask = (np.abs(d @ e) <= sides[0] / 2) & (np.abs(d @ n) <= sides[1] / 2)
    (outline,) = raster.contours(mask)
    corners, w, h = raster.least_rectangle(outline)
    assert abs(max(w, h) - 50) < 2 and abs(min(w, h) - 20) < 2
    want = np.array([centre - e * 25 - n * 10, centre + e * 25 - n * 10, centre + e * 25 + n * 10, centre - e * 25 + n * 10])
    assert np.abs(raster.corners(corners) - raster.corners(want)).max() < 2


def test_rings_have_a_hole():
    mask = np.zeros((40, 40), bool)
    mask[5:35, 5:35] = True
    mask[15:25, 15:25] = False
    assert len(raster.contours(mask)) == 2
    assert raster.contours(np.zeros((5, 5), bool)) == []


def test_box_gates():
    prob = np.zeros((64, 64), np.float32)
    prob[10:20, 10:50] = 0.9
    prob[40:42, 40:42] = 0.9  # a speck
    prob[50:60, 5:30] = 0.5  # not sure enough
    boxes, scores = raster.boxes_of_map(prob, 128, 64)
    assert len(boxes) == 1 and scores[0] > 0.85
    tl, tr, br, bl = boxes[0]
    d = 39 * 9 * 1.5 / (2 * 48) * 1.1
    assert abs(tl - [10 - d, (10 - d) * 2]).max() <= 2 and abs(br - [49 + d, (19 + d) * 2]).max() <= 2


def test_straightening():
    image = np.random.default_rng(0).integers(0, 255, (50, 80, 3)).astype(np.uint8)
    same = raster.straighten(image, np.array([[10, 5], [40, 5], [40, 25], [10, 25]]))
    assert same.shape == (20, 30, 3) and (same == image[5:25, 10:40]).all()
    tall = raster.straighten(image, np.array([[10, 5], [20, 5], [20, 45], [10, 45]]))
    assert tall.shape == (10, 40, 3)
    limit = raster.straighten(image, np.array([[10, 5], [30, 5], [30, 35], [10, 35]]))
    assert limit.shape == (30, 20, 3)  # exactly 1.5 times: not turned


def test_inputs():
    s = Settings()
    tensor, h, w = raster.detector_input(np.zeros((20, 30, 3), np.uint8), s)
    assert (h, w) == (32, 32) and tensor.shape == (1, 3, 64, 64)
    batch = raster.recogniser_input([np.zeros((10, 10, 3), np.uint8), np.full((10, 100, 3), 255, np.uint8)], s)
    assert batch.shape == (2, 3, 48, 480) and (batch[0, :, :, 48:] == 0).all() and (batch[0, :, :, :48] == -1).all() and (batch[1] == 1).all()
    assert raster.classifier_input([np.zeros((5, 7, 3), np.uint8)]).shape == (1, 3, 80, 160)


def test_drawing_is_a_png(spark, tmp_path):
    items = [{"polygon": [[5, 5], [30, 5], [30, 20], [5, 20]], "score": 0.95, "angle": 0}]
    out = raster.draw_boxes(np.full((40, 50, 3), 255, np.uint8), items)
    # Edges and fills are one layer, blended in at 0.15.
    assert out[5, 10].tolist() == out[12, 15].tolist() == [217, 247, 217] and out[35, 45].tolist() == [255] * 3
    save(tmp_path / "x.png", out)
    (back,) = read_images(spark, str(tmp_path / "x.png")).collect()
    assert np.array_equal(np.frombuffer(back["data"], np.uint8).reshape(40, 50, 3), out)


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "scans"
    folder.mkdir()
    save(folder / "two.png", drawn(200, 400, [(40, 100, 200, 130), (40, 30, 300, 60)]))
    save(folder / "none.png", drawn(100, 100, []))
    save(folder / "wide.png", drawn(500, 1700, [(100, 100, 300, 140), (760, 200, 900, 240), (1300, 400, 1600, 440)]))
    many = [(20 + 60 * (k % 6), 20 + 60 * (k // 6), 60 + 60 * (k % 6), 40 + 60 * (k // 6)) for k in range(36)]
    save(folder / "many.png", drawn(420, 420, many))
    return folder


@pytest.mark.parametrize("kind", list(EngineType))
def test_engines(spark, pages, kind):
    images = read_images(spark, str(pages))
    results = create_engine(kind, EngineConfig(StubLoader(), DICT)).transform(images)
    assert [f.name for f in results.schema] == RESULT.names
    found = {r["input_path"].rsplit("/", 1)[1]: r for r in results.collect()}
    assert {n: r["text_count"] for n, r in found.items()} == {"two.png": 2, "none.png": 0, "wide.png": 3, "many.png": 36}
    assert found["none.png"]["items"] == []
    first, second = (i["polygon"][0][1] for i in found["two.png"]["items"])
    assert first < second and all(i["text"] for i in found["many.png"]["items"])
    again = create_engine(kind, EngineConfig(StubLoader(), DICT)).transform(images.repartition(5)).collect()
    assert {r["input_path"]: r["items"] for r in again} == {r["input_path"]: r["items"] for r in found.values()}


def test_tiles_as_tasks_give_the_same_boxes(spark, pages):
    engine = TiledEngine(EngineConfig(StubLoader(), DICT))
    images = read_images(spark, str(pages))
    results = {r["input_path"]: [i["polygon"] for i in r["items"]] for r in engine.transform(images).collect()}
    spread: dict = {}
    for r in engine.boxes(images).orderBy("path", "box_idx").collect():
        spread.setdefault(r["path"], []).append(r["polygon"])
    assert spread == {p: b for p, b in results.items() if b}


def test_progress(spark, pages):
    from glyphflow.plans.progress import observed, watched

    results, totals = observed(TiledEngine(EngineConfig(StubLoader(), DICT)).transform(read_images(spark, str(pages))))
    said = []
    rows = watched(spark, results.collect, lambda done, known: said.append((done, known)), 0.05)
    assert totals.get == {"images": 4, "texts": 41, "empty_images": 1} and len(rows) == 4
    assert said[-1][0] == said[-1][1] > 0


def test_callbacks_of_a_batch(spark, pages):
    from glyphflow.plans.engine import TwoPhaseEngine

    images, detected, read = read_images(spark, str(pages)), [], []
    results = TwoPhaseEngine(EngineConfig(StubLoader(), DICT)).run_batch(images, lambda i, p: detected.append((i, p)), lambda i, p: read.append((i, p)))
    assert detected == read == list(enumerate(sorted(r["path"] for r in images.select("path").collect())))
    assert results.count() == 4


@pytest.mark.parametrize("kind", list(EngineType))
def test_no_pixels_are_shuffled(spark, pages, kind):
    """From the images, or from what the first stage wrote, to results with pixels: no exchange at any size."""
    engine = create_engine(kind, EngineConfig(StubLoader(), DICT))
    results = engine.transform(read_images(spark, str(pages)), keep_pixels=True)
    assert "Exchange" not in results._jdf.queryExecution().executedPlan().toString()
    first = results.where("input_path like '%two.png'").first()
    assert (first["height"], first["width"], len(first["data"])) == (200, 400, 200 * 400 * 3)


def test_tiles_are_tasks(spark, pages):
    """Tiles are dealt out by image and number: what is shuffled is a tile's pixels, not an image's for each tile."""
    plan = TiledEngine(EngineConfig(StubLoader(), DICT)).boxes(read_images(spark, str(pages)))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [path" in plan and "tile_no" in plan


def test_scores_of_rectangles():
    """Means over the cells of a polygon, against all cells whose centres lie in it or on its outline."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        prob = rng.random((40, 50)).astype(np.float32)
        angle, centre, sides = rng.random() * 3, rng.uniform(12, 28, 2), rng.uniform(6, 18, 2)
        e, n = np.array([np.cos(angle), np.sin(angle)]), np.array([-np.sin(angle), np.cos(angle)])
        box = np.floor(np.array([centre + a * e * sides[0] / 2 + b * n * sides[1] / 2 for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]))
        rows, first, last = raster.spans(box, 40, 50)
        mask = np.zeros((40, 50), bool)
        for y, a, b in zip(rows, first, last):
            mask[y, a : b + 1] = True
        want = raster.inside(box, 50, 40)
        assert abs(raster.box_score(prob, box) - prob[mask].astype(float).mean()) < 1e-9
        assert (mask ^ want).sum() <= 0.12 * want.sum()
    assert raster.box_score(np.ones((4, 4), np.float32), np.array([[9, 9], [12, 9], [12, 12], [9, 12]])) == 0


def test_decoding_of_batches_equals_columns():
    rng = np.random.default_rng(1)
    for mask in (None, np.array([0, 0, -np.inf, 0], np.float32)):
        pred = rng.random((7, 9, 6)).astype(np.float32)
        for own, (text, score) in zip(pred, decode_numpy(pred, list("-abcd"), mask)):
            if mask is not None:
                own = own + np.concatenate([mask, [-np.inf, -np.inf]])
            best, letters, sure = own.argmax(axis=1), "", []
            for t, c in enumerate(best):
                if c != 0 and c < 5 and (t == 0 or best[t - 1] != c):
                    letters += "-abcd"[c]
                    sure.append(float(own[t, c]))
            assert text == letters and score == pytest.approx(np.mean(sure) if sure else 0)
    assert decode_numpy(np.zeros((2, 0, 4), np.float32), ["-"], None) == [("", 0.0)] * 2
    assert decode_numpy(np.zeros((0, 3, 4), np.float32), ["-"], None) == []


def test_extra_characters(spark, pages):
    """A class behind the dictionary gives its character where that is named, with a mask too."""
    images = read_images(spark, str(pages))
    for mask in (None, (0.0,) * 3):
        plain, extra = (
            {r["input_path"]: "".join(i["text"] for i in r["items"]) for r in TiledEngine(EngineConfig(StubLoader(), ("blank", "a", "b"), mask, chars)).transform(images).collect()} for chars in ((), tuple("cdefg"))
        )
        assert sum(map(len, extra.values())) > sum(map(len, plain.values()))


@pytest.mark.parametrize("kind", list(EngineType))
def test_engines_with_onnx_files(spark, pages, tmp_path, kind):
    """The real runtime, on files that say what the stand-ins do: the same results, and with a classifier all crops are turned."""
    pytest.importorskip("onnxruntime")
    folder = tmp_path / "models"
    folder.mkdir()
    (folder / "detector.onnx").write_bytes(onnx_files.detector())
    (folder / "recogniser.onnx").write_bytes(onnx_files.recogniser())
    images = read_images(spark, str(pages))

    def results(loader):
        return {r["input_path"]: r["items"] for r in create_engine(kind, EngineConfig(loader, DICT)).transform(images).collect()}

    want, got = results(StubLoader(orientation=False)), results(OnnxLoader(str(folder), recycle=2))
    assert sum(map(len, want.values())) == 41 and set(want) == set(got)
    for path, items in want.items():
        assert [(i["text"], i["polygon"], i["angle"]) for i in items] == [(i["text"], i["polygon"], i["angle"]) for i in got[path]]
        assert np.allclose([i["score"] for i in items], [i["score"] for i in got[path]], atol=1e-6)
    (folder / "classifier.onnx").write_bytes(onnx_files.classifier())
    assert all(i["angle"] == 1 for items in results(OnnxLoader(str(folder), recycle=3)).values() for i in items)
    with pytest.raises(Exception, match="detector.onnx"):
        results(OnnxLoader(str(tmp_path)))


def test_unknown_engine():
    with pytest.raises(ValueError):
        create_engine("other", EngineConfig(StubLoader(), DICT))


def test_command_line(spark, pages, tmp_path, capsys):
    models = tmp_path / "models"
    models.mkdir()
    (models / "dictionary.txt").write_text("\n".join(DICT[1:]))
    (models / "en.txt").write_text("a\nf\n")
    args = ["ocr", "-i", str(pages), "-o", str(tmp_path / "out"), "--model-dir", str(models)]
    assert cli.main([*args, "--lang", "en"], StubLoader()) == 0
    out = tmp_path / "out" / "scans"
    assert {p.name for p in out.iterdir()} == {f"{s}.{e}" for s in ("two", "none", "wide", "many") for e in ("json", "png", "svg")}
    found = json.loads((out / "two.json").read_text())
    assert list(found) == ["input_path", "text_count", "items"] and found["text_count"] == len(found["items"])
    assert all(set(i["text"]) <= {"a", "f"} for i in found["items"])
    assert json.loads((out / "none.json").read_text())["items"] == []
    said = capsys.readouterr().out
    assert "4 of 4 images" in said and "[3/4] two.png: " in said
    (tmp_path / "empty").mkdir()
    assert cli.main(["ocr", "-i", str(tmp_path / "empty"), "--model-dir", str(models)], StubLoader()) == 1


def test_collisions(spark):
    rows = spark.createDataFrame([("/x/a.png", 0, []), ("/x/a.jpg", 0, [])], RESULT)
    with pytest.raises(sinks.Collision):
        sinks.check_outputs(rows, "/out")
    with pytest.raises(sinks.Collision):
        sinks.check_outputs(rows.limit(1), "/x")


def test_arriving_images(spark, pages, tmp_path):
    from glyphflow.streaming.landing import watch

    engine = TiledEngine(EngineConfig(StubLoader(), DICT))
    query = watch(spark, str(pages), engine, str(tmp_path / "results"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "results")).count() == 4
