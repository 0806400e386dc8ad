"""Event aggregates and targets (A operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values: (key, operator, target, least samples)
TARGETS = (
    ("latency.context_pack.avg_elapsed_ms", "<=", 750.0, 1), ("latency.context_pack.p95_recent_ms", "<=", 1500.0, 3), ("latency.context_pack.index_refresh_avg_ms", "<=", 250.0, 1), ("latency.context_pack.snippet_batch_avg_ms", "<=", 250.0, 1),
    ("latency.context_admin.warmup.avg_elapsed_ms", "<=", 1000.0, 1), ("tokens.context_pack.avg_saved_per_pack", ">=", 500.0, 1), ("tokens.context_pack.avg_candidate_compression_per_pack", ">=", 500.0, 1), ("tokens.context_pack.compression_ratio", "<=", 0.7, 1),
    ("retrieval.context_pack.candidates_per_selected", "<=", 8.0, 1), ("cache.context_pack_fragment_hit_ratio", ">=", 0.2, 2), ("cache.retrieval.search_term.hit_ratio", ">=", 0.2, 2), ("cache.retrieval.file_summary.hit_ratio", ">=", 0.2, 2),
    ("cache.retrieval.test_owner_paths.hit_ratio", ">=", 0.2, 2), ("tooling.external_calls_saved_per_pack", ">=", 2.0, 1), ("tooling.contract_tokens_saved_est", ">=", 1.0, 1), ("references.bytes_deferred_est", ">=", 1.0, 1),
)


#: What events add up, negative values as 0.
MEASURES = ("output_tokens", "saved_tokens", "baseline_tokens", "raw_chars", "selected_chars", "calls_saved", "deferred_bytes", "results", "candidates", "omitted", "selected")


def _sums():
    clamp = lambda c: F.sum(F.greatest(F.col(c), F.lit(0)))
    return [F.count("*").alias("n"), *[clamp(c).alias(c) for c in MEASURES], F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses")]


def totals(events: DataFrame) -> DataFrame:
    """Sums over all events, negative measures as 0."""
    return events.agg(*_sums())


def by(events: DataFrame, key: str) -> DataFrame:
    """Sums, latencies and compression by operation or by (non-empty) route."""
    ms = F.col("elapsed_ms").cast("decimal(18,6)")
    rows = events.where(F.col(key) != "").groupBy(key).agg(*_sums(), F.round(F.sum(ms), 3).cast("double").alias("total_ms"), F.min("elapsed_ms").alias("min_ms"), F.max("elapsed_ms").alias("max_ms"), F.max_by("elapsed_ms", "event_id").alias("last_ms"))
    return rows.withColumn("avg_ms", F.round(F.col("total_ms") / F.col("n"), 3)).withColumn("candidates_per_selected", F.round(F.col("candidates") / F.greatest("selected", F.lit(1)), 4)).withColumn("compression", F.coalesce(F.round(F.try_divide(F.col("output_tokens"), F.col("baseline_tokens")), 4), F.lit(0.0)))


def by_namespace(events: DataFrame) -> DataFrame:
    """Hits, misses and their ratio by namespace (the operation where none)."""
    rows = events.groupBy(F.coalesce("cache_namespace", "operation").alias("namespace")).agg(F.count_if("cache_hit").alias("hits"), F.count_if(~F.col("cache_hit")).alias("misses"))
    return rows.withColumn("ratio", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 4))


def reasons(events: DataFrame) -> DataFrame:
    """How often each reason in each namespace."""
    return events.groupBy("cache_namespace", "cache_reason").agg(F.count("*").alias("n"))


def recent(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events."""
    return events.orderBy(F.desc("event_id")).limit(n)


def triggers(events: DataFrame) -> DataFrame:
    """Manual and automatic runs and the last of each."""
    return events.agg(F.count_if("manual").alias("manual"), F.count_if(~F.col("manual")).alias("auto"), F.max(F.when(F.col("manual"), F.col("event_id"))).alias("last_manual"), F.max_by("operation", "event_id").alias("last_operation"))


def recent_p95(events: DataFrame, n: int = 50) -> DataFrame:
    """A10: interpolated 95th percentile of each operation's last ``n`` latencies."""
    w = Window.partitionBy("operation").orderBy(F.desc("event_id"))
    last = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return last.groupBy("operation").agg(F.round(F.round(F.percentile("elapsed_ms", F.lit(0.95)), 9), 3).alias("p95_ms"), F.count("*").alias("n"))


def matrix(values: DataFrame) -> DataFrame:
    """Each target with its value's status; ``values(key, value, samples)``."""
    spark = values.sparkSession
    targets = spark.createDataFrame(TARGETS, "key string, operator string, target double, least int")
    j = F.broadcast(targets).join(values, "key", "left")
    met = F.when(F.col("operator") == "<=", F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target"))
    status = F.when(F.col("value").isNull() | (F.coalesce("samples", F.lit(0)) < F.col("least")), "insufficient").when(met, "pass").otherwise("fail")
    return j.select("key", "target", "value", status.alias("status"))


def kpi_values(events: DataFrame, pack: str, warm: str, namespaces: dict[str, str]) -> DataFrame:
    """A11's values from ``events``: (key, value, samples) of each target.  ``pack`` and
    ``warm`` are the operations of packs and warm-ups; ``namespaces`` names the cache
    namespace of each ratio.  A key with no event has a null value; contract tokens
    have no input here."""
    packs, clamp = F.col("operation") == pack, lambda c: F.greatest(F.col(c), F.lit(0))
    ms = lambda c, when: F.sum(F.when(when, F.col(c).cast("decimal(18,6)"))).cast("double") / F.count_if(when)
    per = lambda c: F.sum(F.when(packs, clamp(c))) / F.count_if(packs)
    calls = F.col("selected") + F.when(F.col("memory"), 1).otherwise(0) + F.when(F.col("candidates") > F.col("selected"), 1).otherwise(0)
    n, cached = F.count_if(packs), F.count_if(packs & F.col("cache_hit").isNotNull())
    values = [
        ("latency.context_pack.avg_elapsed_ms", F.round(ms("elapsed_ms", packs), 3), n), ("latency.context_pack.index_refresh_avg_ms", F.round(ms("index_refresh_ms", packs), 3), n), ("latency.context_pack.snippet_batch_avg_ms", F.round(ms("snippet_batch_ms", packs), 3), n),
        ("latency.context_admin.warmup.avg_elapsed_ms", F.round(ms("elapsed_ms", F.col("operation") == warm), 3), F.count_if(F.col("operation") == warm)),
        ("tokens.context_pack.avg_saved_per_pack", F.round(per("saved_tokens"), 4), n), ("tokens.context_pack.avg_candidate_compression_per_pack", F.round(per("saved_tokens"), 4), n),
        ("tokens.context_pack.compression_ratio", F.round(F.try_divide(F.sum(F.when(packs, clamp("output_tokens"))), F.sum(F.when(packs, clamp("output_tokens") + clamp("saved_tokens")))), 4), n),
        ("retrieval.context_pack.candidates_per_selected", F.round(F.sum(F.when(packs, clamp("candidates"))) / F.greatest(F.lit(1), F.sum(F.when(packs, clamp("selected")))), 4), n),
        ("cache.context_pack_fragment_hit_ratio", F.round(F.try_divide(F.count_if(packs & F.col("cache_hit")), cached), 4), cached),
        ("tooling.external_calls_saved_per_pack", F.round(F.sum(F.when(packs, calls)) / n, 4), n), ("references.bytes_deferred_est", F.sum(F.when(packs, clamp("deferred_bytes"))).cast("double"), n),
    ]
    for key, namespace in namespaces.items():
        here = F.col("cache_namespace") == namespace
        values.append((f"cache.retrieval.{key}.hit_ratio", F.round(F.try_divide(F.count_if(here & F.col("cache_hit")), F.count_if(here)), 4), F.count_if(here)))
    one = events.agg(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"), s.cast("long").alias("samples")).alias(f"k{i}") for i, (k, v, s) in enumerate(values)])
    p95 = recent_p95(events.where(packs)).select(F.lit("latency.context_pack.p95_recent_ms").alias("key"), F.col("p95_ms").alias("value"), F.col("n").alias("samples"))
    return one.select(F.explode(F.array(*one.columns)).alias("p")).select("p.*").unionByName(p95)


def severity(matrix_rows: DataFrame) -> DataFrame:
    """Failed latencies are critical, other failures warnings."""
    label = F.when((F.col("status") == "fail") & F.col("key").startswith("latency."), "critical").when(F.col("status") == "fail", "warning").otherwise(F.col("status"))
    return matrix_rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def across_projects(events: DataFrame) -> DataFrame:
    """Sums by project and over all, with the share of fragments that were hits."""
    ratio = F.coalesce(F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), 4), F.lit(0.0))
    return events.rollup("project_id").agg(*_sums()).withColumn("project_id", F.coalesce("project_id", F.lit("*"))).withColumn("fragment_ratio", ratio)


def warmup(events: DataFrame, operation: str) -> DataFrame:
    """One row about an operation's runs: counts by trigger, latencies, queries and
    their average, the last run, and the status and time of the last automatic one."""
    runs = events.where(F.col("operation") == operation)
    last = lambda c, when=None: F.max_by(F.col(c), F.col("event_id") if when is None else F.when(when, F.col("event_id")))
    auto, n = ~F.col("manual"), F.count("*")
    total = F.coalesce(F.sum(F.col("elapsed_ms").cast("decimal(18,6)")), F.lit(0))
    each = lambda a: F.coalesce(F.round(F.try_divide(a.cast("double"), n), 3), F.lit(0.0))
    queries = F.coalesce(F.sum("results"), F.lit(0))
    return runs.agg(
        n.alias("n"), F.count_if("manual").alias("manual_count"), F.count_if(auto).alias("auto_count"), each(total).alias("avg_ms"), F.coalesce(F.min("elapsed_ms"), F.lit(0.0)).alias("min_ms"), F.coalesce(F.max("elapsed_ms"), F.lit(0.0)).alias("max_ms"), queries.alias("query_count"), each(queries).alias("avg_query_count"),
        F.coalesce(last("elapsed_ms"), F.lit(0.0)).alias("last_ms"), F.coalesce(last("results"), F.lit(0)).alias("last_query_count"), F.when(last("manual"), "manual").otherwise(F.when(n > 0, "auto").otherwise("")).alias("last_trigger"),
        F.coalesce(F.max_by("status", F.when(auto, F.col("event_id"))), F.lit("")).alias("last_auto_status"), F.max(F.when(auto, F.col("event_id"))).alias("last_auto_event"))


def slowest(events: DataFrame) -> DataFrame:
    """The operation with the highest average in each route."""
    ms = F.round(F.sum(F.col("elapsed_ms").cast("decimal(18,6)")) / F.count("*"), 3).cast("double")
    per = events.groupBy("route", "operation").agg(ms.alias("avg_ms"))
    w = Window.partitionBy("route").orderBy(F.desc("avg_ms"), "operation")
    return per.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def slowest_stage(latency: DataFrame) -> DataFrame:
    """The stage with the highest average of each operation, the first by name of
    equals, and its last value: that of the last event which timed it."""
    best = latency.groupBy("operation").agg(F.max("avg_ms").alias("avg_ms"))
    first = latency.join(best, ["operation", "avg_ms"]).groupBy("operation", "avg_ms").agg(F.min(F.struct("stage", "last_ms")).alias("m"))
    return first.select("operation", "m.stage", "avg_ms", "m.last_ms")
