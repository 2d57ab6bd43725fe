"""Operators on small hand-made rows, and their invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphflow.config import Settings
from glyphflow.functions import geometry as G
from glyphflow.functions import text as X
from glyphflow.operators import assembly, ctc, ordering, suppression, tiling
from glyphflow.plans.engine import in_reading_order, tile_places


def one(spark, column, **values):
    names = ", ".join(f"{v!r} AS {k}" if not isinstance(v, str) else f"{v} AS {k}" for k, v in values.items())
    return spark.sql(f"SELECT {names}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("h", "w", "rh", "rw"), [(20, 30, 64, 64), (64, 64, 64, 64), (80, 80, 64, 64), (112, 112, 128, 128), (5000, 100, 4000, 64), (40, 400, 64, 640)])
def test_detector_sides(spark, h, w, rh, rw):
    ph, pw = G.padded_sides(F.lit(h), F.lit(w))
    a, b = G.detector_sides(ph, pw)
    found = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (found["a"], found["b"]) == (rh, rw)


def test_iou_limits(spark):
    def box(x1, y1, x2, y2):
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)])

    found = spark.range(1).select(G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("a"), G.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)).alias("b"), G.iou(box(0, 0, 1, 1), box(5, 5, 6, 6)).alias("c")).first()
    assert tuple(found) == (0.0, 1.0, 0.0)


def test_tiles_cover_and_cut(spark):
    images = spark.createDataFrame([(1, 961, 2000), (2, 321, 321), (3, 0, 10), (4, 960, 961)], "page int, h int, w int")
    found = tiling.with_tiles(images).collect()
    by = {p: [(r["y1"], r["x1"], r["y2"], r["x2"]) for r in found if r["page"] == p] for p in (1, 2, 3, 4)}
    assert by[1][-1] == (640, 1280, 961, 2000) and len(by[1]) == 6
    assert by[2] == [(0, 0, 321, 321)] and by[3] == []
    for p, h, w in ((1, 961, 2000), (2, 321, 321), (3, 0, 10), (4, 960, 961)):
        assert by[p] == tile_places(h, w, Settings())
    with pytest.raises(ValueError):
        Settings(tile=100, overlap=100).stride


def brute_suppress(rows):
    kept = []
    for s, i, *b in sorted(rows, key=lambda r: (-r[0], -r[1])):
        def share(c):
            w, h = min(b[2], c[2]) - max(b[0], c[0]), min(b[3], c[3]) - max(b[1], c[1])
            inter = max(w, 0) * max(h, 0)
            union = (b[2] - b[0]) * (b[3] - b[1]) + (c[2] - c[0]) * (c[3] - c[1]) - inter
            return inter / union if union else 0.0

        if all(share(c) <= 0.3 for _, _, *c in kept):
            kept.append((s, i, *b))
    return {k[1] for k in kept}


def test_suppression_small_and_large_pages(spark):
    rng = np.random.default_rng(0)
    rows = []
    for page, n in ((1, 60), (2, 400), (3, 1)):
        for i in range(n):
            x, y, w, h = rng.integers(0, 200), rng.integers(0, 200), rng.integers(0, 60), rng.integers(0, 60)
            rows.append((page, i, int(x), int(y), int(x + w), int(y + h), float(rng.integers(0, 20)) / 20))
    df = spark.createDataFrame(rows, "page int, id long, x1 int, y1 int, x2 int, y2 int, score double")
    want = {(p, i) for p in (1, 2, 3) for i in brute_suppress([(r[6], r[1], *r[2:6]) for r in rows if r[0] == p])}
    for fold in (0, 100, 1000):
        assert {(r["page"], r["id"]) for r in suppression.suppress(df, fold=fold).select("page", "id").collect()} == want
    assert suppression.suppressed(df).count() == len(rows) - len(want)
    assert {(r["page"], r["id"]) for r in suppression.suppress_spread(df).select("page", "id").collect()} == want
    two = np.array([r for r in rows if r[0] == 2], object)
    for block in (16, 512):
        kept = suppression.suppress_rows(two[:, 6].astype(float), two[:, 1].astype(int), two[:, 2:6].astype(int), block=block)
        assert {(2, int(two[k, 1])) for k in kept} == {w for w in want if w[0] == 2}


def test_iou_of_exactly_the_limit_stays(spark):
    rows = [(1, 1, 0, 0, 13, 10, 0.9), (1, 2, 7, 0, 20, 10, 0.8)]  # 60 of 200
    df = spark.createDataFrame(rows, "page int, id long, x1 int, y1 int, x2 int, y2 int, score double")
    assert suppression.suppress(df).count() == 2


def swaps(points):
    """The order by adjacent swaps, as a definition to compare with."""
    out = sorted(points, key=lambda p: (p[1], p[0]))
    for i in range(len(out) - 1):
        for j in range(i, -1, -1):
            if abs(out[j + 1][1] - out[j][1]) < 10 and out[j + 1][0] < out[j][0]:
                out[j], out[j + 1] = out[j + 1], out[j]
            else:
                break
    return out


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 60)), max_size=14, unique=True))
@settings(max_examples=200, deadline=None)
def test_order_in_numpy(points):
    boxes = [np.array([p, p, p, p]) for p in points]
    assert [points[k] for k in in_reading_order(boxes, Settings())] == swaps(points)


def test_order_in_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(p, i, int(rng.integers(0, 100)), int(rng.integers(0, 80))) for p in range(40) for i in range(12)]
    df = spark.createDataFrame(rows, "page int, id int, x1 int, y1 int")
    for fold in (0, 128):
        found = ordering.reading_order(df, fold=fold).orderBy("page", "box_idx").collect()
        for p in range(40):
            assert [(r["x1"], r["y1"]) for r in found if r["page"] == p] == swaps([(x, y) for q, i, x, y in rows if q == p])


DICT = ["blank", "a", "b", "c"]


@pytest.mark.parametrize(
    ("path", "text"),
    [([1, 1, 0, 1], "aa"), ([0, 0], ""), ([1, 4, 1], "aa"), ([1, 2, 2, 3], "abc"), ([4, 4], "")],
)
def test_decoding(spark, path, text):
    frames = [[0.9 if c == k else 0.02 for c in range(5)] for k in path]
    got = ctc.decode_frames(spark.createDataFrame([(frames,)], "f array<array<double>>"), "f", DICT).first()
    assert got["text"] == text and abs(got["score"] - (0.9 if text else 0)) < 1e-9
    (again,) = ctc.decode_numpy(np.array([frames]), DICT)
    assert again[0] == text and abs(again[1] - got["score"]) < 1e-9


@pytest.mark.parametrize("mask", [[0.0, float("-inf")], [0.0, float("-inf"), 0.0, 0.0, float("-inf"), 0.0, 0.0]])
def test_mask_is_grown_or_cut(spark, mask):
    frames = [[0.1, 0.9, 0.5, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4, 0.9]]
    got = ctc.decode_frames(spark.createDataFrame([(frames,)], "f array<array<double>>"), "f", DICT, mask).first()
    (again,) = ctc.decode_numpy(np.array([frames]), DICT, np.array(mask))
    assert got["text"] == again[0] and "a" not in got["text"]


def test_blank_texts_and_names(spark):
    texts = ["　", "  \t", "", "a", "　a ", "\x1c", "\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", X.is_blank(F.col("t")).alias("b"), X.strip(F.col("t")).alias("s")).collect()
    assert [(r["b"], r["s"]) for r in found] == [(not t.strip(), t.strip()) for t in texts]
    names = ["/x/a.PNG", "/x/b.tar.gz", "/x.d/c", "/x/.png", "/x/d.webp"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(X.is_image(F.col("p")).alias("i"), X.stem(F.col("p")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, "a"), (False, "b.tar"), (False, "c"), (False, ".png"), (True, "d")]


def test_scores_that_are_not_numbers_pass(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 0.1), ("c", 0.5)], "text string, score double")
    assert {r["text"] for r in assembly.text_filter(df, least=0.3).collect()} == {"a", "c"}


def test_assembly_keeps_images_without_text(spark):
    from glyphflow.schema import ITEM

    images = spark.createDataFrame([("a",), ("b",)], "page string")
    boxes = spark.createDataFrame([("a", k, [[k, 0], [k + 1, 0], [k + 1, 1], [k, 1]]) for k in range(3)], "page string, box_idx int, polygon array<array<int>>")
    texts = spark.createDataFrame([("a", 2, "z", 0.5), ("a", 0, "x", 0.4), ("a", 1, "　", 0.9)], "page string, box_idx int, text string, score double")
    found = {r["page"]: r for r in assembly.assemble(images, boxes, texts).collect()}
    assert found["b"]["text_count"] == 0 and found["b"]["items"] == []
    assert [i["text"] for i in found["a"]["items"]] == ["x", "z"] and found["a"]["items"][1]["angle"] == 0
    assert [f.name for f in assembly.assemble(images, boxes, texts).schema["items"].dataType.elementType] == ITEM.names


def test_batches_of_32(spark):
    rows = [(1, k, 1.0 + (k == 32) * 20) for k in range(33)]
    found = assembly.recogniser_batches(spark.createDataFrame(rows, "page int, box_idx int, ratio double")).orderBy("box_idx").collect()
    assert [r["batch_no"] for r in found] == [0] * 32 + [1]
    assert (found[0]["img_w"], found[0]["resized_w"], found[32]["img_w"]) == (320, 48, 1008)


def test_corner_ties(spark):
    points = [[0, 5], [0, 5], [9, 1], [9, 8]]
    got = one(spark, G.corner_order(F.col("p")), p="array(array(0,5),array(0,5),array(9,1),array(9,8))")
    assert got == [[0, 5], [9, 1], [9, 8], [0, 5]] and len(got) == len(points)
