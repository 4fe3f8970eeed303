"""Session with the settings that the engine relies on."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "docuseam", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def bounded_batches(spark: SparkSession, size: int = 16 << 20, rows: int = 4000) -> None:
    """Bound the Arrow batches that reach Python workers, so that long texts fit."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def kept(df: DataFrame) -> DataFrame:
    """The frame's rows in the shared checkpoint folder, without the plan that made them."""
    shared_folder(df.sparkSession, "")
    return df.checkpoint()


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new name in the shared checkpoint folder.

    A folder of the driver's own is taken only where none is set and driver and
    executors are one process.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))
    return f"{spark.sparkContext.getCheckpointDir()}/{stem}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
