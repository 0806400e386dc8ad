"""Cutting the lineage of tables that several parts of a job read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's checkpoint folder."""
    _checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _checkpoints(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-gleaner-"))


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the session's checkpoint folder, which all executors share, and
    read from there; a temporary folder only where the session names none (tests)."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def kept_once(spark: SparkSession, name: str, make) -> DataFrame:
    """``make()`` written once a session under ``name``, for all queries that read it."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = kept(make(), "once")
    return _WRITTEN[key]
