"""A session for local runs and tests, and the folder for tables that a query writes on its way."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyfold")
        .config("spark.driver.memory", os.environ.get("TALLYFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder under the one that driver and executors share; removed when the application ends.

    The shared one is spark.checkpoint.dir, or what SparkContext.setCheckpointDir was given. Where neither is set, a local
    master, whose tasks run on the driver's machine, has the temp folder; on a cluster that is an error. The session's
    configuration is never changed.
    """
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.gettempdir()
    own = f"{place.rstrip('/')}/tallyfold-{context.applicationId}"
    path, files = _on_store(spark, own)
    files.deleteOnExit(path)
    return own


def _on_store(spark: SparkSession, place: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, folder: str | None = None) -> DataFrame:
    """Write df once into the shared folder (or the given one) and read it back: cuts lineage, survives lost executors, has known size."""
    path = f"{folder}/{what}-{uuid.uuid4().hex}" if folder else shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables that nothing reads any more."""
    path, files = _on_store(spark, folder)
    files.delete(path, True)


def made(spark: SparkSession, folder: str) -> None:
    """Make a folder, if there is none."""
    path, files = _on_store(spark, folder)
    files.mkdirs(path)
