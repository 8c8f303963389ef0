"""Cutting long lineages through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Where the session names no such folder, the context's checkpoint folder counts. A session in one process, as
    in tests, may do without either: it shares its own temporary folder with itself. A cluster may not.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/sourcesift-{context.applicationId}"
    return f"{base.rstrip('/')}/{uuid.uuid4()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there.

    The rows survive the loss of executors, and later steps neither repeat the scan nor drag its
    plan along.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to a new folder in the shared folder and read them from there.

    Unlike a checkpoint, later steps read only the columns they need. The folder stays until whoever owns the
    shared folder removes it.
    """
    path = shared_folder(df.sparkSession) + "/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
