"""Tables in hash buckets that change together, version by version.

A store is a folder with one or more tables.  Each table's rows lie in buckets by the
hash of a key; a version writes only the buckets it touches and then a manifest, which
says for every table and bucket in which version it was last written.  The manifest's
``_SUCCESS`` is the commit: readers take the last manifest that has one, so they see all
tables at one whole version, whatever a killed writer left behind.  Writing a version
again gives the same version.

A version either rewrites the buckets it touches (``update``) or adds to them
(``replace``): then it writes its own rows and its keys, and readers leave out what older
versions hold of keys that came again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, folder string, buckets array<int>"
#: The folder of the keys that versions replaced.
KEYS = "_keys"
#: A bucket with so many versions is rewritten by the next that touches it.
FOLD = 512
#: Replaced keys that are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Files of a version's keys at most.
KEY_FILES = 8


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """``buckets`` must stay the same for the life of a store; the manifest has a
        row for each table and version that holds some, with their numbers."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.hash(*keys), F.lit(self.buckets)).cast("int")  # as repartition() deals rows

    def _folders(self, name: str) -> list[tuple[int, object]]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(folder)]
        return sorted((int(n.split("=")[1]), p) for n, p in found if n.startswith("version="))

    def _committed(self, path) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def versions(self, before: int | None = None) -> list[int]:
        """The versions that were committed, or those before one."""
        return [v for v, path in self._folders("_manifests") if (before is None or v < before) and self._committed(path)]

    def manifest(self, before: int | None = None) -> dict[tuple[str, int], list[str]]:
        """The folders of each table and bucket in the last version, or the last before one."""
        found = (v for v, path in reversed(self._folders("_manifests")) if (before is None or v < before) and self._committed(path))
        last, out = next(found, None), {}
        if last is not None:
            for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifests/version={last}").collect():
                for b in r["buckets"]:
                    out.setdefault((r["table"], b), []).append(r["folder"] if _of_keys(r["folder"]) else f"{r['folder']}/_bucket={b}")
        return {k: sorted(ps, key=lambda p: (_version_of(p), p)) for k, ps in out.items()}

    def read(self, table: str, buckets: set[int] | None = None, before: int | None = None) -> DataFrame | None:
        """A table's rows (of some buckets), or None if it has none there."""
        held = [(b, p) for (t, b), ps in self.manifest(before).items() if t == table and (buckets is None or b in buckets) for p in ps]
        paths = sorted(f"{self.path}/{p}" for _, p in held if not _of_keys(p))
        if not paths or not any(_of_keys(p) for _, p in held):
            return self.spark.read.parquet(*paths) if paths else None
        parts: dict[tuple[str, int], set[int]] = {}
        for b, p in held:
            if not _of_keys(p):
                parts.setdefault((p.split("/")[0], _version_of(p)), set()).add(b)
        alike: dict[tuple[str, frozenset[int]], list[int]] = {}  # versions with the same buckets
        for (folder, v), bs in parts.items():
            alike.setdefault((folder, frozenset(bs)), []).append(v)
        found = []
        for name in sorted({folder for folder, _ in parts}):
            where = reduce(or_, (F.col("_version").isin(vs) & F.col("_bucket").isin(list(bs)) for (folder, bs), vs in alike.items() if folder == name))
            found.append(self._of_versions(name, {v for folder, v in parts if folder == name}).where(where))
        return self._last(reduce(DataFrame.unionByName, found), {_version_of(p) for _, p in held if _of_keys(p)}).drop("_version", "_bucket")

    def _of_versions(self, folder: str, versions: set[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{folder}").parquet(*[f"{self.path}/{folder}/_version={v}" for v in sorted(versions)])

    def _last(self, rows: DataFrame, versions: set[int]) -> DataFrame:
        """``rows`` without those of keys that a later one of ``versions`` replaced."""
        keys = self._of_versions(KEYS, versions)
        names = [c for c in keys.columns if c != "_version"]
        # a version's keys are different, and rows come with their key: one that came once replaced nothing
        again = keys.groupBy(*names).agg(F.max("_version").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        n = again.limit(BROADCAST_KEYS + 1).count()
        if not n:
            return rows
        return rows.join(F.broadcast(again) if n <= BROADCAST_KEYS else again, names, "left").where("_last IS NULL OR _version >= _last").drop("_last")

    def commit(self, version: int, tables: dict[str, tuple[DataFrame, Column]], touched: set[int] | None, append: bool = False) -> None:
        """Write ``tables``, each with the column of its buckets, and the manifest that
        puts them in place of the ``touched`` buckets (None: of all).  With ``append``
        they come beside what the buckets hold."""
        kept = self.manifest(version)
        if not append:
            kept = {k: v for k, v in kept.items() if k[0] not in tables or (touched is not None and k[1] not in touched)}
        for name, (rows, bucket) in tables.items():
            # rows of a bucket meet in one task, or in several where a bucket is large
            for b, p in self._write(version, name, rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket")).items():
                kept.setdefault((name, b), []).append(p)
        self._publish(version, kept)

    def _write(self, version: int, name: str, rows: DataFrame) -> dict[int, str]:
        """Write ``rows`` by their ``_bucket``; the folders of the buckets that have some."""
        folder = f"{name}/_version={version}"
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        parent = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in parent.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(parent)]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def _publish(self, version: int, kept: dict[tuple[str, int], list[str]]) -> None:
        """Write the manifest, by which a version is committed."""
        folders: dict[tuple[str, str], list[int]] = {}
        for (t, b), ps in kept.items():
            for p in ps:
                folders.setdefault((t, p.split("/_bucket=")[0]), []).append(b)
        rows = pa.table({"table": [t for t, _ in folders], "folder": [f for _, f in folders], "buckets": list(folders.values())}, pa.schema([("table", pa.string()), ("folder", pa.string()), ("buckets", pa.list_(pa.int32()))]))
        self.spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_manifests/version={version}")

    def touched(self, keys: DataFrame, *names: str) -> set[int]:
        """The buckets of some keys: as many numbers as there are buckets at most."""
        return {r["b"] for r in keys.select(self.bucket(*names).alias("b")).distinct().collect()}

    def update(self, version: int, keys: DataFrame, names: list[str], step: Callable[[dict[str, DataFrame | None]], dict[str, DataFrame]], tables: list[str]) -> None:
        """Rewrite the buckets of ``keys`` in all ``tables``: ``step`` gets their rows
        before this version and gives those after.  Work follows the touched buckets."""
        hit = self.touched(keys, *names)
        if not hit:
            self.commit(version, {}, set())
            return
        made = step({t: self.read(t, hit, version) for t in tables})
        self.commit(version, {t: (df, self.bucket(*names)) for t, df in made.items()}, hit)

    def replace(self, version: int, keys: DataFrame, names: list[str], tables: dict[str, DataFrame]) -> None:
        """Put ``tables``, rows of ``keys`` alone, in place of all that was written of
        ``keys``.  Work follows the new rows, which are written as they lie (see ``dealt``);
        older ones stay where they are, until a bucket holds ``FOLD`` versions.  Tables of a
        store take either this or ``update``."""
        folder, bucket, kept = f"{KEYS}/_version={version}", self.bucket(*names), self.manifest(version)
        if any(t in tables and not any(map(_of_keys, ps)) for (t, _), ps in kept.items()):
            raise ValueError("a table that was written without keys can't take them")
        written = {t: self._write(version, t, rows.withColumn("_bucket", bucket)) for t, rows in tables.items()}
        keys = keys.select(*names).distinct()
        keys.coalesce(KEY_FILES).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        keys = self.spark.read.schema(keys.schema).parquet(f"{self.path}/{folder}")
        hit = self.touched(keys, *names)
        full = {b for (t, b), ps in kept.items() if t in tables and b in hit and sum(not _of_keys(p) for p in ps) >= FOLD}
        for t in tables if full else ():
            older = self.read(t, full, version)
            if older is not None:  # beside the new rows, in a table's folder of its own
                older = self._write(version, f"{t}-folded", self.dealt(older.join(keys, names, "left_anti"), *names).withColumn("_bucket", bucket))
            for b in full:
                kept[t, b] = [p for p in kept.get((t, b), []) if _of_keys(p)] + ([older[b]] if older and b in older else [])
        for t, folders in written.items():
            for b in hit:
                kept.setdefault((t, b), []).extend([*([folders[b]] if b in folders else []), folder])
        self._publish(version, kept)

    def dealt(self, rows: DataFrame, *names: str) -> DataFrame:
        """``rows`` with those of a bucket in one task, so that what is made of each task's
        rows is written without another exchange."""
        return rows.repartition(self.buckets, *names)


def _of_keys(path: str) -> bool:
    return path.startswith(f"{KEYS}/")


def _version_of(path: str) -> int:
    return int(path.split("version=")[1].split("/")[0])
