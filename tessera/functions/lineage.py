"""Cutting lineage in loops, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset (tests in one JVM), one of this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4()}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: compressed, unlike a checkpoint, for larger tables."""
    spark = df.sparkSession
    path = new_path(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> set[str]:
    """The tables and checkpoints that this application has in the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = set()
    for entry in files.listStatus(folder):
        inner = [entry] if entry.getPath().getName().startswith("rdd-") else files.listStatus(entry.getPath())
        found |= {x.getPath().toString() for x in inner}
    return found


def discard(spark: SparkSession, paths: set[str]) -> None:
    """Deletes tables and checkpoints that no DataFrame still to be run reads."""
    for path in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
