"""Images as DataFrames: files listed by ending, decoded to three channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.text import extension, file_name, is_image
from glyphflow.schema import IMAGE


class NoImages(ValueError):
    """There is no such path, or no image in the folder."""


def _status(spark: SparkSession, path: str):
    """Hadoop's file system and path, so that any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_folder(spark: SparkSession, path: str) -> bool:
    store, at = _status(spark, path)
    if not store.exists(at):
        raise NoImages(f"no such path: {path}")
    return store.getFileStatus(at).isDirectory()


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the images of a folder, without its subfolders, in the order of names; or of one file, whatever its ending.

    Only names and sizes are read.  Raises NoImages where there are none.
    """
    folder = is_folder(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length")
    if not folder:
        return files
    found = files.where(is_image(F.col("path")))
    if found.isEmpty():
        raise NoImages(f"no images in {path}")
    return found.orderBy(file_name(F.col("path")))


def read_images(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of schema.IMAGE: path, height, width, data (BGR).

    Grey images become three equal channels, an alpha channel is dropped.  A file
    that cannot be decoded raises an error that names it, or is left out if not
    ``strict``.  WebP passes the ending's test but the JVM's decoder does not
    know it, so such files count as undecodable.
    """
    folder = is_folder(spark, path)
    images = spark.read.format("image").load(path).select("image.*")
    chosen = images.where(is_image(F.col("origin"))) if folder else images
    if folder and list_images(spark, path).isEmpty():
        raise NoImages(f"no images in {path}")
    bad = F.col("height") < 0
    if strict:
        said = F.raise_error(F.concat(F.lit("cannot decode image: "), F.col("origin")))
        chosen = chosen.withColumn("height", F.when(bad, said.cast("int")).otherwise(F.col("height")))
    else:
        chosen = chosen.where(~bad)
    return three_channels(chosen.select("origin", "height", "width", "nChannels", "data"))


def three_channels(images: DataFrame) -> DataFrame:
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for h, w, n, raw in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                pixels = np.frombuffer(raw, np.uint8).reshape(h, w, n)
                data.append(raw if n == 3 else (np.repeat(pixels, 3, axis=2) if n == 1 else np.ascontiguousarray(pixels[:, :, :3])).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(data, pa.binary())], ["path", "height", "width", "data"])

    return images.mapInArrow(convert, IMAGE)


def unsupported(files: DataFrame) -> DataFrame:
    """Listed files that the JVM cannot decode."""
    return files.where(extension(F.col("path")) == "webp")
