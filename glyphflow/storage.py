"""Tables between the stages of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session on one machine (as in tests) gets a new
    folder; any other raises an error, for executors could not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared_"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def _store(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder; what is there is deleted when the application ends."""
    at = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
    store, path = _store(spark, at)
    store.deleteOnExit(path)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written as Parquet into the shared folder and read back: lineage ends there.

    The table is deleted when the application ends, or by ``drop``.
    """
    at = new_path(df.sparkSession)
    df.write.parquet(at)
    made = df.sparkSession.read.schema(df.schema).parquet(at)
    made._table_at = at
    return made


def drop(df: DataFrame) -> None:
    """Delete a table that ``materialise`` made and that no plan still to be run reads."""
    store, path = _store(df.sparkSession, df._table_at)
    store.delete(path, True)
    store.cancelDeleteOnExit(path)
