"""Structured Streaming forms (W operators); each equals its batch twin.

Tables that a stream keeps up to date are stores of hash buckets (``sources.versions``):
a batch rewrites the buckets of its own keys, or adds to them, and commits one version.  A batch
that is run again after a failure writes the same version again; readers take the last
version that was committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, memory
from ..sources.versions import Store

#: Buckets of a stream's table.
BUCKETS = 64


def _run(stream: DataFrame, checkpoint: str, step):
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_events(stream: DataFrame, log_path: str, checkpoint: str):
    """Append new events to the log, once by event_id, and stop when all available
    input is in.  An event's copies have its ``recorded_at``, so a batch is compared
    with the ids of its own days alone (of its ids' buckets, if events have no time); it
    writes only its new rows.  No state is kept for ever, and no late event is lost."""

    def append(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, log_path)
        new = batch.dropDuplicates(["event_id"])
        day = F.coalesce(F.date_diff(F.to_date("recorded_at"), F.lit("1970-01-01").cast("date")), F.lit(-1)) if "recorded_at" in new.columns else store.bucket("event_id")
        days = {r["d"] for r in new.select(day.alias("d")).distinct().collect()}  # a number a day
        log = store.read("log", days, batch_id)
        if log is not None:
            new = new.join(log.select("event_id"), "event_id", "left_anti")
        store.commit(batch_id, {"log": (new, day)}, None, append=True)

    return _run(stream, checkpoint, append)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``append_events`` has written."""
    rows = Store(spark, path).read("log")
    return None if rows is None else rows.drop("_bucket")


def last_version(spark: SparkSession, path: str, table: str = "rows") -> DataFrame | None:
    """A table as the last committed batch left it."""
    rows = Store(spark, path).read(table)
    return None if rows is None else rows.drop("_bucket")


def refresh_corpus(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, max_terms: int | None = extract.MAX_TERMS):
    """Postings of files as they change: those of the paths in a batch are made again
    from their last content (the greatest mtime_ns) and replace older ones; a batch writes
    its own alone.  A path whose last content is null was removed.  ``max_terms`` as in X01."""

    def step(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, path, buckets)
        last = store.dealt(batch, "path").groupBy("path").agg(F.max_by(F.struct("content"), "mtime_ns")["content"].alias("content")).persist()
        store.replace(batch_id, last, ["path"], {"rows": extract.postings(last.where("content is not null"), max_terms, by_path=True)})
        last.unpersist()

    return _run(stream, checkpoint, step)


def upsert_memory(stream: DataFrame, path: str, checkpoint: str, *keys: str, buckets: int = BUCKETS):
    """The last write of each key (M01), with the time of its first.  A null ``value``
    removes the key."""

    def step(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, path, buckets)
        writes = batch.withColumn("created_at", F.col("written_at"))

        def apply(before):
            both = writes if before["rows"] is None else before["rows"].drop("_bucket").unionByName(writes)
            first = both.groupBy(*keys).agg(F.min("created_at").alias("_first"))
            made = memory.latest(both.drop("created_at"), *keys).drop("created_at").join(first, list(keys)).withColumnRenamed("_first", "created_at")
            return {"rows": made.where("value is not null")}

        store.update(batch_id, batch, list(keys), apply, ["rows"])

    return _run(stream, checkpoint, step)


def count_changes(stream: DataFrame) -> DataFrame:
    """Running counts of a listing's changes by kind."""
    return stream.groupBy("change").agg(F.count("*").alias("n"))
