"""Documents to packed training sequences: five stages, each over all that the one
before kept.

All stages but the last return the columns of ``documents``, and any others that the
input has, for the rows they keep.  They decide by row, never by doc_id: null and
repeated ids don't matter.  Null and empty texts are scored like others, are nobody's
copies and hold no passage.  Long texts are read whole.  An empty table gives none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, jaccard, packing, quality, toxicity
from gleaner.llm.common import free_name, stage

#: Row keys (about 60 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 250_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model, score = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name(docs, "_score")
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    model, score = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), free_name(docs, "_score")
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` plus a key of each row: its file and its place there.  What isn't a
    file scan is written first."""
    key = free_name(docs, "_row_key")
    place = F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit("-"), F.col("_metadata.row_index")).alias(key)
    try:
        return docs.select("*", place), key
    except AnalysisException:
        return stage(docs, "pipeline-rows").select("*", place), key


def _without(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't among ``keys``."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_anti").drop(key)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least doc_id (nulls
    come last), of equal ids the first row."""
    docs, key = _with_key(docs)
    linked = jaccard.link_documents(docs.select(F.col(key).alias("doc_id"), "text")).where("doc_id <> component_id or n_links > 0")
    groups = stage(linked.select(F.col("doc_id").alias(key), "component_id"), "near-duplicates").join(docs.select(key, F.col("doc_id").alias("id")), key)
    order = F.struct(F.col("id").isNull().alias("none"), "id", key)
    first = groups.groupBy("component_id").agg(F.min(order)[key].alias("first"))
    return _without(docs, key, stage(groups.join(first, "component_id").where(F.col(key) != F.col("first")).select(key), "near-duplicates-out"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage was found."""
    docs, key = _with_key(docs)
    found = decontaminate.contaminated(docs.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, key, stage(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No stage's decisions are expressible in SQL (models, tokens); tests/llm compares each with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
