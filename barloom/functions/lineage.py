"""Cutting a plan where several branches read the same costly intermediate result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir. Where none is set, a local session gets a temporary one; on a
    cluster executors could not read that, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _own.get("path")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own["path"] = tempfile.mkdtemp(prefix="spark-")
    return named


_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written once to the cluster's shared checkpoint folder, read by every later
    branch, and safe when executors are lost."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, written once. Unlike a checkpoint it has a known size, so Spark decides by
    that whether a join sends it to every task."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
