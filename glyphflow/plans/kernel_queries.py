"""Contract queries that run pixel kernels, sources, sinks and engines on images derived from the driver's tables, with SQL for what they must give."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS
from glyphflow.functions import raster
from glyphflow.operators import ctc, suppression
from glyphflow.plans import contract as C
from glyphflow.plans.engine import EngineConfig, create_engine
from glyphflow.plans.inference import StubLoader
from glyphflow.plans.sinks import json_rows
from glyphflow.schema import IMAGE, RESULT
from glyphflow.sources.images import list_images, read_images
from glyphflow.storage import new_path

query = C.query


def _per_id(spark, sf_dir: str, schema: str, run: Callable[[int], tuple]) -> DataFrame:
    """A row per event: its id and what ``run`` gives for it."""
    return _per_ids(spark, sf_dir, schema, lambda ids: map(run, ids))


def _per_ids(spark, sf_dir: str, schema: str, run: Callable[[list[int]], Iterable[tuple]], most: int = 10_000) -> DataFrame:
    """The same where ``run`` takes ``most`` ids at a time.

    Ids are small and what is done for each is not, so they are dealt out to a
    given number of tasks: by their size alone, few tasks would hold them all.
    """
    types = {"double": pa.float64(), "long": pa.int64()}
    fields = pa.schema([(n, types[t]) for n, t in (c.split() for c in schema.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                ids = batch.column(0)[at : at + most].to_pylist()
                found = zip(*((i, *values) for i, values in zip(ids, run(ids), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, fields, strict=True)], schema=fields)

    return C._read(spark, sf_dir, "events").select("event_id").repartition(_tasks(spark), "event_id").mapInArrow(rows, schema)


def _tasks(spark) -> int:
    """As many tasks as a shuffle has, and a few for each core, for rows whose number says more about the work than their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


# ---- detection -------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_id AS id, 10+event_id%20 AS x, 8+event_id%17 AS y, CAST(1+event_id%60 AS DOUBLE) AS w, CAST(1+event_id%30 AS DOUBLE) AS h, (event_id%101)/100.0::DOUBLE AS p FROM events),
 g AS (SELECT *, w*h*1.5::DOUBLE/(2*(w+h))*1.10::DOUBLE AS d FROM r WHERE p > 0.3 AND least(w,h) >= 3 AND p >= 0.6),
 b AS (SELECT * FROM g WHERE least(w,h)+2*d >= 5)
 SELECT id, CAST(least(greatest(round_even((x-d)/128*(256+id%5),0),0),256+id%5) AS BIGINT) AS x1, CAST(least(greatest(round_even((y-d)/96*(192+id%7),0),0),192+id%7) AS BIGINT) AS y1,
 CAST(least(greatest(round_even((x+w+d)/128*(256+id%5),0),0),256+id%5) AS BIGINT) AS x2, CAST(least(greatest(round_even((y+h+d)/96*(192+id%7),0),0),192+id%7) AS BIGINT) AS y2, round(p,4) AS score FROM b""")
def db_boxes(spark, sf_dir):
    """Boxes of a probability map with one rectangle: threshold, outline, gates, growth, place in the image."""

    def run(i: int) -> tuple:
        prob = np.zeros((96, 128), np.float32)
        x, y = 10 + i % 20, 8 + i % 17
        prob[y : y + 2 + i % 30, x : x + 2 + i % 60] = i % 101 / 100
        boxes, scores = raster.boxes_of_map(prob, 192 + i % 7, 256 + i % 5)
        return (*(boxes[0][0].tolist()), *(boxes[0][2].tolist()), scores[0]) if boxes else (None,) * 5

    found = _per_id(spark, sf_dir, "id long, x1 long, y1 long, x2 long, y2 long, score double", run)
    return found.where("score is not null").withColumn("score", F.round("score", 4))


@query("""SELECT event_id AS id, CAST(1+event_id%2 AS BIGINT) AS outlines, CAST(2*((12+event_id%9)+(11+event_id%7))-4 + CASE WHEN event_id%2=1 THEN 4*((2+event_id%3)+(1+event_id%4)) ELSE 0 END AS BIGINT) AS points,
 CAST((13+event_id%9)*(12+event_id%7) AS BIGINT) AS covered FROM events""")
def outlines(spark, sf_dir):
    """Outlines of a rectangle, every other one with a hole (whose edge belongs to both outlines), and the pixels of a polygon of that size."""

    def run(ids: list[int]) -> Iterator[tuple]:
        masks, polygons = np.zeros((len(ids), 30, 30), bool), []
        for mask, i in zip(masks, ids, strict=True):
            w, h = 12 + i % 9, 11 + i % 7
            mask[3 : 3 + h, 2 : 2 + w] = True
            if i % 2:
                mask[6 : 7 + i % 4, 5 : 7 + i % 3] = False
            polygons.append([[2, 3], [2 + w, 3], [2 + w, 3 + h], [2, 3 + h]])
        covered = raster.inside_of(np.array(polygons), 30, 30).sum(axis=(1, 2)).tolist()
        return ((len(found), sum(map(len, found)), n) for found, n in zip(raster.contours_of(masks), covered, strict=True))

    return _per_ids(spark, sf_dir, "id long, outlines long, points long, covered long", run, 64)


# ---- pixels ----------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT event_id AS id, CAST(5+event_id%7 AS INT) AS w, CAST(6+event_id%5 AS INT) AS h, event_id%50 AS c FROM events),
 x AS (SELECT id, w, h, c, unnest(range(2*w)) AS i FROM s), p AS (SELECT *, unnest(range(2*h)) AS j FROM x),
 v AS (SELECT id, round_even(3*least(greatest(i/2.0::DOUBLE-0.25,0),w-1) + 5*least(greatest(j/2.0::DOUBLE-0.25,0),h-1) + c, 0) AS v FROM p)
 SELECT id, CAST(sum(v) AS BIGINT) AS total, CAST(max(v) AS BIGINT) AS most FROM v GROUP BY id""")
def resize_double(spark, sf_dir):
    """Bilinear resizing to twice the size, of an image whose values are linear in x and y."""

    def run(i: int) -> tuple:
        y, x = np.mgrid[: 6 + i % 5, : 5 + i % 7]
        image = np.repeat((3 * x + 5 * y + i % 50).astype(np.uint8)[..., None], 3, axis=2)
        out = raster.resize(image, 2 * x.shape[1], 2 * x.shape[0])[..., 1]
        return int(out.sum()), int(out.max())

    return _per_id(spark, sf_dir, "id long, total long, most long", run)


@query("""WITH s AS (SELECT event_id AS id, CAST(5+event_id%11 AS INT) AS w, CAST(4+event_id%13 AS INT) AS h, CAST(3+event_id%4 AS INT) AS x0, CAST(2+event_id%5 AS INT) AS y0 FROM events),
 x AS (SELECT *, unnest(range(w)) AS i FROM s), p AS (SELECT *, unnest(range(h)) AS j FROM x),
 t AS (SELECT id, CAST(sum((7*(x0+i)+11*(y0+j)+id)%251) AS BIGINT) AS total FROM p GROUP BY id)
 SELECT id, CAST(CASE WHEN h > 1.5*w THEN h ELSE w END AS BIGINT) AS w, CAST(CASE WHEN h > 1.5*w THEN w ELSE h END AS BIGINT) AS h, total,
 CAST(CASE WHEN h > 1.5*w THEN (7*x0+11*(y0+h-1)+id)%251 ELSE (7*x0+11*y0+id)%251 END AS BIGINT) AS first,
 CAST(CASE WHEN h > 1.5*w THEN (7*(x0+w-1)+11*y0+id)%251 ELSE (7*(x0+w-1)+11*(y0+h-1)+id)%251 END AS BIGINT) AS first_turned FROM s JOIN t USING (id)""")
def crops(spark, sf_dir):
    """Straightened crops: tall ones are turned by a quarter; and the first pixel of the crop turned by a half."""

    def run(i: int) -> tuple:
        y, x = np.mgrid[:30, :30]
        image = np.repeat(((7 * x + 11 * y + i) % 251).astype(np.uint8)[..., None], 3, axis=2)
        w, h, x0, y0 = 5 + i % 11, 4 + i % 13, 3 + i % 4, 2 + i % 5
        crop = raster.straighten(image, np.array([[x0, y0], [x0 + w, y0], [x0 + w, y0 + h], [x0, y0 + h]]))[..., 0]
        return crop.shape[1], crop.shape[0], int(crop.sum()), int(crop[0, 0]), int(raster.turned(crop)[0, 0])

    return _per_id(spark, sf_dir, "id long, w long, h long, total long, first long, first_turned long", run)


def _flat(i: int, h: int, w: int) -> np.ndarray:
    return np.broadcast_to(np.array([i % 256, i * 3 % 256, i * 7 % 256], np.uint8), (h, w, 3))


_CHANNEL = "round(({v}/255.0::DOUBLE-{m}::DOUBLE)/{s}::DOUBLE,3)"
_CHANNELS = ", ".join(f"{_CHANNEL.format(v=f'(event_id*{k}%256)', m=m, s=s)} AS {n}" for n, k, m, s in zip("bgr", (1, 3, 7), DEFAULTS.det_mean, DEFAULTS.det_std, strict=True))


def _means(tensor: np.ndarray) -> tuple[float, ...]:
    return tuple(round(float(tensor[0, k].mean(dtype=np.float64)), 3) for k in range(3))


@query(f"""SELECT event_id AS id, CAST(greatest(round_even(trunc((20+event_id%30)*(64.0::DOUBLE/least(20+event_id%30,50+event_id%20)))/32.0::DOUBLE,0)*32,32) AS BIGINT) AS rh,
 CAST(greatest(round_even(trunc((50+event_id%20)*(64.0::DOUBLE/least(20+event_id%30,50+event_id%20)))/32.0::DOUBLE,0)*32,32) AS BIGINT) AS rw, {_CHANNELS} FROM events""")
def detector_inputs(spark, sf_dir):
    """The detector's tensor of an image of one colour: its sides, and each channel's normalised value."""

    def run(i: int) -> tuple:
        tensor, _, _ = raster.detector_input(_flat(i, 20 + i % 30, 50 + i % 20))
        return *tensor.shape[2:], *_means(tensor)

    return _per_id(spark, sf_dir, "id long, rh long, rw long, b double, g double, r double", run)


@query(f"SELECT event_id AS id, CAST(80 AS BIGINT) AS h, CAST(160 AS BIGINT) AS w, {_CHANNELS} FROM events")
def classifier_inputs(spark, sf_dir):
    def run(i: int) -> tuple:
        tensor = raster.classifier_input([_flat(i, 5 + i % 30, 9 + i % 40)])
        return *tensor.shape[2:], *_means(tensor)

    return _per_id(spark, sf_dir, "id long, h long, w long, b double, g double, r double", run)


@query("""WITH s AS (SELECT event_id AS id, CAST(20+event_id%100 AS DOUBLE)/(10+event_id%5) AS a, CAST(40+event_id%60 AS DOUBLE)/(8+event_id%9) AS b FROM events),
 t AS (SELECT *, trunc(48*greatest(320/48.0::DOUBLE, a, b)) AS whole FROM s)
 SELECT id, CAST(whole AS BIGINT) AS width, CAST(3*48*(whole-least(whole, ceil(48*a))) AS BIGINT) AS empty, round((id%255+1)/255.0::DOUBLE/0.5::DOUBLE-1,3) AS value FROM t""")
def recogniser_inputs(spark, sf_dir):
    """A batch of two crops: its width, what the first one leaves empty, and the first one's normalised value."""

    def run(i: int) -> tuple:
        first = np.full((10 + i % 5, 20 + i % 100, 3), i % 255 + 1, np.uint8)
        batch = raster.recogniser_input([first, np.zeros((8 + i % 9, 40 + i % 60, 3), np.uint8)])
        own = batch[0, 0, 0, 0]
        used = min(batch.shape[3], int(np.ceil(48 * first.shape[1] / first.shape[0])))
        return batch.shape[3], int((batch[0, :, :, used:] == 0).sum()), round(float(own), 3)

    return _per_id(spark, sf_dir, "id long, width long, empty long, value double", run)


_BAND = "CASE WHEN s >= 0.9 THEN {0} WHEN s >= 0.7 THEN {1} ELSE {2} END"
_GREEN = f"CASE WHEN turned THEN {_BAND.format(0, 100, 0)} ELSE {_BAND.format(200, 200, 0)} END"


@query(f"""WITH e AS (SELECT event_id AS id, (event_id%101)/100.0 AS s, event_id%2 = 1 AS turned FROM events), c AS (SELECT id, {_GREEN} AS g FROM e)
 SELECT id, CAST(round_even(g*0.15::DOUBLE+255*0.85::DOUBLE,0) AS BIGINT) AS edge, CAST(round_even(g*0.15::DOUBLE+255*0.85::DOUBLE,0) AS BIGINT) AS fill, CAST(255 AS BIGINT) AS outside FROM c""")
def drawn_boxes(spark, sf_dir):
    """Green values of a drawn box on white: on its edge, within, and outside."""

    def run(i: int) -> tuple:
        x, y = 4 + i % 6, 5 + i % 7
        item = {"polygon": [[x, y], [x + 20, y], [x + 20, y + 12], [x, y + 12]], "score": i % 101 / 100, "angle": i % 2}
        out = raster.draw_boxes(np.full((40, 50, 3), 255, np.uint8), [item])[..., 1]
        return int(out[y, x + 5]), int(out[y + 6, x + 9]), int(out[y + 16, x + 24])

    return _per_id(spark, sf_dir, "id long, edge long, fill long, outside long", run)


# ---- recognition and suppression ---------------------------------------------------------------------------------


def _batches(spark, sf_dir: str, mask: np.ndarray | None) -> DataFrame:
    dictionary = C.DICTIONARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred = np.array(batch.column(1).to_pylist(), np.float32).reshape(batch.num_rows, C.SIDE, C.SIDE)
            found = ctc.decode_numpy(pred, dictionary, mask)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["vec_id", "text", "score"])

    found = C.logits(spark, sf_dir).mapInArrow(run, "vec_id long, text string, score double")
    return found.select("vec_id", "text", *C._round("score"))


@query(C.SQL["ctc_decode"])
def ctc_batches(spark, sf_dir):
    """The engines' decoding of whole batches."""
    return _batches(spark, sf_dir, None)


@query(C.SQL["mask_apply"])
def ctc_batches_masked(spark, sf_dir):
    return _batches(spark, sf_dir, np.array(ctc.mask_array(C.DICTIONARY, C.ALLOWED), np.float32))


@query(C.SQL["nms"])
def nms_spread(spark, sf_dir):
    """Suppression for pages that no single task should hold."""
    return suppression.suppress_spread(C.boxes(spark, sf_dir)).select("page", "id", "x1", "y1", "x2", "y2", *C._round("score"))


# ---- files and engines -------------------------------------------------------------------------------------------


def _pictures(spark, sf_dir: str) -> DataFrame:
    """schema.IMAGE: a white page per nation with 1 to 4 dark lines, some wider than a tile."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                image = np.full((260, 600 + 90 * (k % 7), 3), 255, np.uint8)
                for line in range(1 + k % 4):
                    image[20 + 60 * line : 44 + 60 * line, 30 : 180 + 20 * (k % 5)] = [k, 2 * k, 3 * k]
                yield pa.RecordBatch.from_arrays([pa.array([f"/in/page_{k}.png"]), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([image.tobytes()], pa.binary())], ["path", "height", "width", "data"])

    return C._read(spark, sf_dir, "nation").select("n_nationkey").mapInArrow(draw, IMAGE)


_LINES = "SELECT CAST(n_nationkey AS BIGINT) AS page, CAST(1+n_nationkey%4 AS BIGINT) AS texts, true AS in_order FROM nation"


def _read_pages(spark, sf_dir: str, kind: str) -> DataFrame:
    results = create_engine(kind, EngineConfig(StubLoader(), tuple(C.DICTIONARY))).transform(_pictures(spark, sf_dir))
    tops = F.transform("items", lambda i: i["polygon"][0][1])
    page = F.regexp_extract("input_path", r"(\d+)\.png", 1).cast("long")
    return results.select(page.alias("page"), F.col("text_count").cast("long").alias("texts"), (F.array_sort(tops) == tops).alias("in_order"))


@query(_LINES)
def ocr_tiled(spark, sf_dir):
    """The tiled engine, with stand-ins for its models."""
    return _read_pages(spark, sf_dir, "tiled")


@query(_LINES)
def ocr_two_phase(spark, sf_dir):
    return _read_pages(spark, sf_dir, "two-phase")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS page, CAST(260 AS BIGINT) AS height, CAST(600+90*(n_nationkey%7) AS BIGINT) AS width,
 CAST(255*260*(600+90*(n_nationkey%7)) - (255-n_nationkey)*24*(150+20*(n_nationkey%5))*(1+n_nationkey%4) AS BIGINT) AS blue,
 CAST(255*260*(600+90*(n_nationkey%7)) - (255-3*n_nationkey)*24*(150+20*(n_nationkey%5))*(1+n_nationkey%4) AS BIGINT) AS red FROM nation""")
def image_files(spark, sf_dir):
    """PNG files that the tasks write, listed and read back: sizes, and sums of two channels."""
    folder = new_path(spark, "images").removeprefix("file:")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for path, h, w, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(f"{folder}/{path.rsplit('/', 1)[1]}", "wb") as f:
                    f.write(raster.png(np.frombuffer(raw, np.uint8).reshape(h, w, 3)))
            yield batch.select(["path"])

    written = _pictures(spark, sf_dir).mapInArrow(write, "path string").count()
    if written != list_images(spark, folder).count():
        raise RuntimeError("an image that was written is not listed")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(raw, np.uint8).reshape(-1, 3).sum(axis=0, dtype=np.int64) for raw in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([b[0] for b in both], pa.int64()), pa.array([b[2] for b in both], pa.int64())], ["path", "height", "width", "blue", "red"])

    found = read_images(spark, folder).mapInArrow(sums, "path string, height int, width int, blue long, red long")
    return found.select(F.regexp_extract("path", r"(\d+)\.png", 1).cast("long").alias("page"), F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), "blue", "red")


@query(C.SQL["assemble"])
def json_results(spark, sf_dir):
    """Results as the JSON that is written for an image, read back by Spark."""
    results = C.assembly.assemble(*C._items(spark, sf_dir))


    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return json_rows(batches, ["page", "json"])

    back = results.select("page", "text_count", "items").mapInArrow(write, "page long, json string").select("page", F.from_json("json", RESULT).alias("r"))
    return C.totals(back.select("page", "r.text_count", "r.items"))
