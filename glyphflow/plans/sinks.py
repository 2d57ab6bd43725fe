"""Results as files: one JSON per image, an annotated PNG, an SVG with labels, or a table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.config import DEFAULTS, Settings
from glyphflow.functions import raster
from glyphflow.functions.text import PALETTES, stem
from glyphflow.plans.engine import pixels
from glyphflow.sources.images import is_folder


class Collision(ValueError):
    """Two inputs would have the same output, or an output is an input."""


def output_folder(spark: SparkSession, source: str, output: str | None) -> str:
    """``output`` or "output", and for a folder of images its name below that."""
    base = (output or "output").rstrip("/")
    return f"{base}/{source.rstrip('/').rsplit('/', 1)[-1]}" if is_folder(spark, source) else base


def write_table(results: DataFrame, path: str) -> None:
    """All results as JSON lines, in parallel; for corpora this is the sink."""
    results.write.mode("overwrite").json(path)


def result_json(path: str, count: int, items: list[dict]) -> str:
    rows = [{"text": i["text"], "score": i["score"], "polygon": i["polygon"], "angle": i["angle"]} for i in items]
    return json.dumps({"input_path": path, "text_count": count, "items": rows}, ensure_ascii=False, indent=2)


_HELD = 1 << 22  # characters of JSON that are handed on at once


def json_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A result's key and JSON, from batches of key, number of texts and items.

    A batch of Spark's has rows of a given number, whatever their items weigh:
    only one result is Python objects at a time, and texts are handed on by size.
    """

    def handed(keys: list, made: list[str], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(made, pa.string())], names)

    for batch in batches:
        keys, made, size, kind = [], [], 0, batch.column(0).type
        for row in rows_of(batch):
            key, count, items = row.values()
            keys.append(key)
            made.append(result_json(str(key), count, items))
            size += len(made[-1])
            if size >= _HELD:
                yield handed(keys, made, kind)
                keys, made, size = [], [], 0
        if keys:
            yield handed(keys, made, kind)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, each made when it is asked for."""
    for k in range(batch.num_rows):
        yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def svg(width: int, height: int, items: list[dict], s: Settings = DEFAULTS) -> str:
    """Outlines and labels on a transparent ground; a turned region's label runs down beside it."""
    font, out = max(s.least_font, height // s.font_share), [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    for item in items:
        band = "high" if item["score"] >= s.high_score else "mid" if item["score"] >= s.mid_score else "low"
        colour = "#%02x%02x%02x" % PALETTES[1 if item["angle"] == 1 else 0][band]
        p = item["polygon"]
        out.append(f'<polygon points="{" ".join(f"{x},{y}" for x, y in p)}" fill="{colour}" fill-opacity="{s.fill}" stroke="{colour}" stroke-width="2"/>')
        if item["angle"] == 1:
            placed = [(p[1][0] + 4, p[0][1] + k * font, c) for k, c in enumerate(item["text"])]
        else:
            placed = [(p[0][0], p[0][1] - font - 2, item["text"])]
        out += [f'<text x="{x}" y="{y + font}" font-size="{font}" fill="{colour}">{escape(t)}</text>' for x, y, t in placed]
    return "\n".join([*out, "</svg>"])


def output_paths(path: Column, folder: str) -> Column:
    """struct<stem, json_path, png_path, svg_path> of an input's path."""
    name = stem(path)

    def place(ending: str) -> Column:
        return F.concat(F.lit(folder.rstrip("/") + "/"), name, F.lit(f".{ending}")).alias(f"{ending}_path")

    return F.struct(name.alias("stem"), *map(place, ("json", "png", "svg")))


def check_outputs(inputs: DataFrame, folder: str, path: str = "input_path") -> None:
    """Raises Collision; a group's count, not its rows, comes to the driver.  Listed files do, so nothing need be read before."""
    named = inputs.select(F.col(path).alias("input_path"), output_paths(F.col(path), folder).alias("out")).select("input_path", "out.*")
    twice = named.groupBy("stem").count().where("count > 1").limit(1).collect()
    if twice:
        raise Collision(f"several inputs would be written as {twice[0]['stem']}.json")
    over = named.where(F.regexp_replace("input_path", "^file:/+", "/") == F.col("png_path")).limit(1).collect()
    if over:
        raise Collision(f"{over[0]['input_path']} would be overwritten")


def write_files(results: DataFrame, folder: str, show_text: bool = True, s: Settings = DEFAULTS, on_image: Callable[[int, int, str, int], None] | None = None) -> int:
    """{stem}.json per image, and where results carry their image {stem}.png and, if ``show_text``, {stem}.svg; returns their number.

    ``on_image`` gets place, number of images, path and number of texts of each
    image, in the order of paths, once all are written; without it only the
    number comes to the driver.  Files are written by the tasks through a plain
    file system, so ``folder`` has to be a shared mount on a cluster.  There is
    no font here to draw labels with: the PNG has the boxes, the SVG has boxes
    and labels.  See ``check_outputs`` for names that collide.
    """
    rows = results.withColumn("stem", output_paths(F.col("input_path"), folder)["stem"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for row in rows_of(batch):
                base = f"{folder}/{row['stem']}"
                with open(f"{base}.json", "w", encoding="utf-8") as f:
                    f.write(result_json(row["input_path"], row["text_count"], row["items"]))
                if row.get("data") is not None:
                    drawn = raster.draw_boxes(pixels(row["data"], row["height"], row["width"]), row["items"], s)
                    with open(f"{base}.png", "wb") as f:
                        f.write(raster.png(drawn))
                    if show_text:
                        with open(f"{base}.svg", "w", encoding="utf-8") as f:
                            f.write(svg(row["width"], row["height"], row["items"], s))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([batch.column(names.index("input_path")), batch.column(names.index("text_count"))], ["path", "texts"])

    written = rows.mapInArrow(write, "path string, texts int")
    if on_image is None:
        return written.agg(F.count(F.lit(1))).first()[0]
    done = sorted(map(tuple, written.collect()))  # names of the files of one folder
    for place, (path, texts) in enumerate(done, 1):
        on_image(place, len(done), path, texts)
    return len(done)
