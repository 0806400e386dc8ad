"""State kept apart by project, so that one project goes without touching others."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

NO_PROJECT = "__HIVE_DEFAULT_PARTITION__"


class ProjectState:
    """Parquet tables under one folder, each partitioned by ``project_id``.

    Writing rows replaces the partitions of the projects they name and no others.  A
    project without rows in any table has no state.  Removing is a deletion of folders:
    no row is read, and a removal that is cut short is finished by the next one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _list(self, path: str) -> list[tuple[str, object]]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def write(self, table: str, rows: DataFrame) -> None:
        # a project's rows meet in one task, or in several where it is large
        spread = rows.hint("rebalance", "project_id")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{self.path}/{table}")

    def tables(self) -> list[str]:
        return sorted(n for n, _ in self._list(self.path) if not n.startswith(("_", ".")))

    def read(self, table: str, schema) -> DataFrame:
        """All projects' rows; a filter on ``project_id`` reads only its folders."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def prune(self, project_id: str | None) -> bool:
        """Remove a project from every table; whether it had any state.  Null is the rows
        without a project."""
        removed = False
        for table in self.tables():
            for name, path in self._list(f"{self.path}/{table}"):
                if name.startswith("project_id=") and unquote(name.split("=", 1)[1]) == (NO_PROJECT if project_id is None else project_id):
                    fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
                    removed = fs.delete(path, True) or removed
        return removed
