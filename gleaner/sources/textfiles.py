"""Corpora as files: a recursive scan of text files, and writing texts as such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus

#: Files above this many bytes aren't read.
MAX_BYTES = 262_144


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size, mtime_ns, content) of the text files below ``root``: names
    that aren't excluded, with a text suffix or none, ``max_bytes`` at most, without a NUL
    in their first 4096 bytes.  Bytes that are no UTF-8 become replacement characters.
    Sizes and names are tested on the listing, before any byte is read.  Spark's reader
    gives no row for a file without bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    path = F.substr("path", F.lit(len(base) + 1))
    named = found.where(F.col("length") <= max_bytes).select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")
    kept = named.where(corpus.is_text_name(F.col("path")) & ~corpus.excluded(F.col("path")) & ~corpus.is_binary(F.col("content")))
    return kept.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def write_files(files: DataFrame, root: str) -> None:
    """Write each of ``files(path, content)`` as a file of its own below ``root``.  A task
    that runs again writes the same files again."""
    schema = "n long"

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content if isinstance(content, bytes) else (content or "").encode())
            yield pd.DataFrame({"n": [len(b)]})

    files.select("path", "content").mapInPandas(write, schema).agg(F.sum("n")).collect()
