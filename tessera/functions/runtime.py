"""Cutting plans that would otherwise be computed, and planned, again and again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of spark.checkpoint.dir. Only a session of one machine may do without, and has a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = context.getConf().get("spark.checkpoint.dir")
        if not path and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the checkpoint folder."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder that the whole cluster sees."""
    return f"{ready(spark)}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet beside the checkpoints: for many rows, which take far less room there. The folder stays."""
    path = folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
