"""Learning from the usage log (U operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import GENERIC_TERMS

KEYS = ("term", "route", "path_scope")
# The routes that are warmed, in order, and the terms that each starts with
WARM_ROUTES = ("coding", "review", "debug", "test", "docs")
DEFAULT_SEEDS = {
    "coding": ("auth", "token", "config", "schema", "context", "server"),
    "review": ("auth", "token", "schema", "metrics", "server", "context"),
    "debug": ("error", "failure", "traceback", "timeout", "exception", "log"),
    "test": ("pytest", "fixture", "coverage", "assert", "mock", "auth"),
    "docs": ("readme", "docs", "manual", "usage", "example", "schema"),
}


def term_statistics(log: DataFrame) -> DataFrame:
    """Totals and current streaks of each (term, route, scope).  A streak counts
    the uses after the last success, found by a second aggregate, so no window
    sorts a whole key."""
    last = log.groupBy(*KEYS).agg(F.max(F.when(F.col("result_count") > 0, F.col("seq"))).alias("ok"), F.max(F.when(F.col("selected_count") > 0, F.col("seq"))).alias("chosen"))
    j = log.join(last, list(KEYS))
    after = lambda c: F.col("seq") > F.coalesce(F.col(c), F.lit(-1))
    return j.groupBy(*KEYS).agg(
        F.count("*").alias("uses"), F.sum("result_count").alias("results"), F.sum("selected_count").alias("selections"), F.count_if("cache_hit").alias("hits"),
        F.count_if(~F.col("cache_hit")).alias("misses"), F.max_by("result_count", "seq").alias("last_results"), F.count_if(after("ok")).alias("zero_streak"),
        F.count_if(after("chosen") & F.col("selection_observed") & (F.col("result_count") > 0)).alias("unselected_streak"))


def negative_terms(statistics: DataFrame) -> DataFrame:
    """Terms that keep giving nothing, or nothing that is used."""
    reason = F.when(F.col("zero_streak") >= 2, "repeated_zero_results").when(F.col("unselected_streak") >= 3, "never_selected")
    return statistics.withColumn("reason", reason).where("reason is not null").select(*KEYS, "reason")


def in_scope_of(scope: Column, above: Column) -> Column:
    return (above == ".") | (scope == above) | scope.startswith(F.concat(above, F.lit("/")))


def without_negative(rows: DataFrame, negative: DataFrame) -> DataFrame:
    """Rows whose term isn't negative for its route in its scope or above."""
    a, n = rows.alias("a"), negative.alias("n")
    on = (F.col("a.term") == F.col("n.term")) & (F.col("a.route") == F.col("n.route")) & in_scope_of(F.col("a.path_scope"), F.col("n.path_scope"))
    return a.join(n, on, "left_anti")


def route_seeds(log: DataFrame, scope: str, n: int = 8) -> DataFrame:
    """The best terms of each route for a scope: own scope first, then
    selections, results, recency, term; negative and generic terms are left out."""
    s = term_statistics(log)
    negative = negative_terms(s)
    s = s.join(log.groupBy(*KEYS).agg(F.max("seq").alias("last_seq")), list(KEYS))
    near = F.when(F.col("path_scope") == scope, 0).when(F.lit(scope).startswith(F.concat("path_scope", F.lit("/"))), 1).when(F.col("path_scope") == ".", 2).otherwise(3)
    rows = without_negative(s, negative).where((F.col("results") > 0) & ~F.col("term").isin(*GENERIC_TERMS) & (F.col("route") != ""))
    w = Window.partitionBy("route").orderBy("near", F.desc("selections"), F.desc("results"), F.desc("last_seq"), "term")
    return rows.withColumn("near", near).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("route", "rank", "term", "path_scope", "selections", "results")


def seed_plan(log: DataFrame, scope: str, n: int) -> DataFrame:
    """(place, term, route, source): learned seeds by route, then the routes'
    default ones that are neither generic nor negative here; each term once, ``n`` in all."""
    spark = log.sparkSession
    routes = spark.createDataFrame([(r, k) for k, r in enumerate(WARM_ROUTES)], "route string, o int")
    rows = [(t, r, k) for k, (r, t) in enumerate((r, t) for r in WARM_ROUTES for t in DEFAULT_SEEDS[r])]
    defaults = spark.createDataFrame(rows, "term string, route string, r int").where(~F.col("term").isin(*GENERIC_TERMS)).withColumn("path_scope", F.lit(scope))
    defaults = without_negative(defaults, negative_terms(term_statistics(log))).select("term", "route", F.lit("default_seed").alias("source"), F.lit(1).alias("k"), "r")
    learned = route_seeds(log, scope).select("term", "route", F.lit("route_seed").alias("source"), F.lit(0).alias("k"), F.col("rank").alias("r"))
    first = learned.unionByName(defaults).join(F.broadcast(routes), "route").groupBy("term").agg(F.min(F.struct("k", "o", "r", "route", "source")).alias("m"))
    # at most eight learned seeds and six defaults a route: a few dozen rows
    return first.select("term", "m.route", "m.source", F.row_number().over(Window.orderBy("m")).alias("place")).where(F.col("place") <= n)
