"""Expiring-entry tables seen as data (K operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CURRENT_SCHEMA = 2
#: Namespaces of fragments, the one of them that a search backend made, and those that are no longer used.
FRAGMENTS, SEARCH, UNSUPPORTED = ("ns0", "ns1"), "ns0", ("ns3",)


def with_status(entries: DataFrame, backend: str = "b1") -> DataFrame:
    """Status and reason by the first rule that holds.  Only fragments must have the
    current schema and a signature, and only those of searches the backend's version."""
    space = F.coalesce("namespace", F.lit("unknown"))
    fragment, search, version = space.isin(*FRAGMENTS), space == SEARCH, F.coalesce("backend", F.lit("")) if "backend" in entries.columns else F.lit(backend)
    rules = (
        (F.col("invalidated"), "stale", "invalidated"), (space.isin(*UNSUPPORTED), "stale", "unsupported_namespace"), (fragment & (F.coalesce("schema_version", F.lit(0)) < CURRENT_SCHEMA), "stale", "legacy_schema"),
        (fragment & (F.coalesce("signature", F.lit("")) == ""), "stale", "signature_missing"), (search & (version == ""), "stale", "backend_missing"), (search & (version != backend), "stale", "backend_changed"), (F.col("ttl_left_days") < 0, "expired", "expired"),
    )
    status = reason = None
    for rule, s, r in rules:
        status, reason = (F.when(rule, s), F.when(rule, r)) if status is None else (status.when(rule, s), reason.when(rule, r))
    return entries.withColumn("status", status.otherwise("active")).withColumn("reason", reason.otherwise("active"))


def stats(entries: DataFrame) -> DataFrame:
    """Counts by namespace."""
    return with_status(entries).groupBy(F.coalesce("namespace", F.lit("unknown")).alias("namespace")).agg(
        F.count("*").alias("entries"), *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "expired", "stale")], F.count_if(F.col("schema_version") < CURRENT_SCHEMA).alias("legacy"), F.min("key").alias("sample_key"))


def prune(entries: DataFrame, max_age_days: int = 30) -> DataFrame:
    """What stays."""
    return with_status(entries).where((F.col("status") == "active") & (F.col("age_days") <= max_age_days))


def stats_with_counters(entries: DataFrame, counters: DataFrame, samples: int = 5) -> DataFrame:
    """``stats`` with the first keys of each namespace and its hits and misses; a
    namespace may have entries, counters or both.  A key's rank is cut in each task
    before the exchange, so a large namespace doesn't gather."""
    named = entries.withColumn("namespace", F.coalesce("namespace", F.lit("unknown")))
    first = named.select("namespace", "key").withColumn("_r", F.row_number().over(Window.partitionBy("namespace").orderBy("key"))).where(F.col("_r") <= samples)
    keys = first.groupBy("namespace").agg(F.sort_array(F.collect_list("key")).alias("sample_keys"))
    rows = stats(entries).drop("sample_key").join(keys, "namespace").join(counters.select("namespace", "hits", "misses"), "namespace", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("entries", "active", "expired", "stale", "legacy", "hits", "misses")}
    return rows.withColumns(zero).withColumn("sample_keys", F.coalesce("sample_keys", F.array().cast("array<string>")))


def prune_counts(entries: DataFrame, max_age_days: int = 30) -> DataFrame:
    """How many rows stay, and how many go for what."""
    outcome = F.when(F.col("status") != "active", F.col("status")).when(F.col("age_days") > max_age_days, "too_old").otherwise("kept")
    return with_status(entries).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def lookup(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Hit, or miss with its reason."""
    j = keys.join(with_status(entries).select("key", "status", "reason"), "key", "left")
    return j.select("key", (F.col("status") == "active").eqNullSafe(True).alias("hit"), F.when(F.col("status").isNull(), "absent").when(F.col("status") == "active", "hit").otherwise(F.col("reason")).alias("reason"))


def keyspace(entries: DataFrame) -> DataFrame:
    """Rows by key prefix."""
    return entries.groupBy(F.split_part("key", F.lit(":"), F.lit(2)).alias("prefix")).agg(F.count("*").alias("n"))


def search(entries: DataFrame, text: str, n: int) -> DataFrame:
    """Rows with a text in any column; stale first, newest first, by key."""
    rows = with_status(entries).where(F.contains(F.lower(F.concat_ws(" ", "key", "namespace", "signature", "status", "reason")), F.lit(text.lower())))
    order = F.when(F.col("status") == "stale", 0).when(F.col("status") == "expired", 1).otherwise(2)
    return rows.orderBy(order, "age_days", "key").limit(n)
