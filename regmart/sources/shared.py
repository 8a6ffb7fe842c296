"""Cutting the lineage of a job through the folder that the driver and all executors share, and work that is done once for each distinct value."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame


def _shared(df: DataFrame) -> str:
    """The session's folder in ``spark.checkpoint.dir``; only a session on one machine (tests) may leave it unset."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as checkpointed in the shared folder."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: each reader takes the columns it needs, and Spark knows the size of the table."""
    path = f"{_shared(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(rows: DataFrame, key: str, **made: Column) -> DataFrame:
    """``rows`` with columns that are made once for each distinct value of ``key``, which is not null."""
    return rows.join(stored(rows.select(key).distinct().withColumns(made)), key)
