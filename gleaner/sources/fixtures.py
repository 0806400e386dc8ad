"""Readers of request files and sinks of derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fixtures(spark: SparkSession, path: str, schema: str, needed: str, most: int) -> DataFrame:
    """The objects of all JSON files under ``path``, each file an object or an array
    of them; files that don't parse and objects without ``needed`` are left out; the
    first ``most`` by ``needed``."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(schema).json(path)
    return rows.where(F.col(needed).isNotNull()).orderBy(needed).limit(most)


def write_table(df: DataFrame, path: str, *payload: str) -> None:
    """``df`` as Parquet by project.  ``payload`` columns become one JSON column,
    ``payload``, with its keys in order, so that equal rows are equal texts."""
    if payload:
        df = df.withColumn("payload", F.to_json(F.struct(*sorted(payload)))).drop(*payload)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)
