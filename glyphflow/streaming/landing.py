"""Images as they arrive in a folder. An addition: the batch plans need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphflow.functions.text import is_image
from glyphflow.plans.engine import Engine
from glyphflow.sources.images import three_channels


def watch(spark: SparkSession, folder: str, engine: Engine, output: str, checkpoint: str, once: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Appends results of new images to a JSON table; each image stands for itself, so there is no watermark.

    A micro-batch that runs again writes to the same place, so results appear once.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    names = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")

    def batch(rows: DataFrame, number: int) -> None:
        paths = [r["path"] for r in rows.where(is_image(F.col("path"))).collect()]  # at most files_per_batch names
        if paths:
            images = read_some(rows.sparkSession, paths)
            engine.transform(images).write.mode("overwrite").json(f"{output}/batch={number}")

    writer = names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_some(spark: SparkSession, paths: list[str]) -> DataFrame:
    images = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    return three_channels(images.select("origin", "height", "width", "nChannels", "data"))
