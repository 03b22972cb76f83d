"""Cutting long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine, where it is unset, a temporary one.

    On a cluster a machine's own folder can't be read by others: there a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}")
        context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared folder of ``shared_folder``."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` kept as columns in the shared folder, for tables of which later steps read some columns or some rows."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
