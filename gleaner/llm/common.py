"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: ASCII upper and lower case; texts are folded over A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a
    temporary one of our own only where the session sets none and runs in this process
    (tests).  A cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-gleaner-")
        base = _OWN[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage with
    files that outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def worker_cache(tenant: str) -> dict:
    """A dict that lives as long as the Python worker; tasks of one worker share it.
    It holds what one ``tenant`` (an operator) remembers: when another one's tasks
    come to a reused worker, what the last one left is forgotten."""
    import sys
    import types

    held = sys.modules.setdefault("_gleaner_worker_cache", types.ModuleType("_gleaner_worker_cache"))
    if getattr(held, "tenant", None) != tenant:
        held.tenant, held.kept = tenant, {}
        give_back()
    return held.kept


def give_back() -> None:
    """Hand what a Python worker has freed back to the system.  Workers outlive their
    tasks, and the allocators would keep it for them."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


#: Rows of an Arrow batch where the session leaves Spark's default of 10 000: that many
#: long texts take tens of megabytes on both sides of each task's pipe.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's rows a batch for Python, unless the session has set them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(df: DataFrame, function, schema: str, rows: int = 500) -> DataFrame:
    """``function`` over ``df`` as an iterator of small pandas tables.  Batches stay in
    Arrow's form; only ``rows`` rows at a time become Python objects, so that a worker
    needs little memory."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        parts = (b.slice(a, rows).to_pandas() for b in batches for a in range(0, b.num_rows, rows))
        for out in function(parts):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        give_back()

    return df.mapInArrow(run, schema)


def with_scores(docs: DataFrame, function, column: str, rows: int = 500) -> DataFrame:
    """``docs`` plus ``function``'s numbers for its texts (lists of ``rows`` at most),
    which take the place of a column of that name.  All else stays in Arrow's form."""
    import pyarrow as pa
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    docs = docs.drop(column)

    def run(batches):
        for b in batches:
            texts, out = b.column(b.schema.get_field_index("text")), []
            for a in range(0, b.num_rows, rows):
                out += function(texts.slice(a, rows).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, column])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
