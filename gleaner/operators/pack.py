"""Context packs: ranking and budgeted selection (C operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values
TESTED_ROUTES = ("coding", "review", "debug", "test")
SECURITY_MARKERS = ("auth", "security", "secret", "token", "config", "path")


def confidence(score: Column, scale: float = 14.0) -> Column:
    """C05."""
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.1), score / scale)), 3)


def route_score(score: Column, path: Column, route: Column, explicit: Column, test_owner: Column, term_in_path: Column) -> Column:
    """Bonuses for explicit paths, tests, documents, security and terms."""
    tested, low = route.isin(*TESTED_ROUTES), F.lower(path)
    marker = None
    for m in SECURITY_MARKERS:
        marker = low.contains(m) if marker is None else marker | low.contains(m)
    bonus = lambda c, x: F.when(c, x).otherwise(F.lit(0.0))
    total = score + bonus(explicit, F.lit(6.0)) + bonus(test_owner, F.when(tested, 4.0).otherwise(1.0)) + bonus(path.rlike("^tests?/") & tested, F.lit(2.0))
    total = total + bonus((route == "docs") & low.rlike("^(readme|docs/)"), F.lit(5.0)) + bonus((route == "security") & marker, F.lit(3.0)) + bonus(term_in_path, F.lit(1.0))
    return F.round(total, 4)


def select_rows(candidates: DataFrame, max_items: int = 6, budget: int = 3600, per_path: int = 2) -> DataFrame:
    """``candidates`` plus place (1 is best) and outcome.  Candidates of a
    request, best first, are selected unless they repeat a range, their path has
    its share, the items are full or the characters are used up (the first always
    fits).  The choice of each hangs on those before, so the ranges and lengths of a
    request's candidates, which retrieval bounds, are folded as one array."""
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "path", "start_line", "end_line", F.length("content"), F.xxhash64("content"), *[c for c in ("source",) if c in candidates.columns])
    placed = candidates.withColumn("place", F.row_number().over(order))
    item = F.struct("place", "path", "start_line", "end_line", F.length("content").alias("chars"))
    grouped = placed.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("paths"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        key = F.concat_ws(":", x["path"], x["start_line"], x["end_line"])
        outcome = F.when(F.array_contains(a["seen"], key), "duplicate").when(F.size(F.filter(a["paths"], lambda p: p == x["path"])) >= per_path, "diversity_limit").when(a["n"] >= max_items, "item_limit").when((a["used"] + x["chars"] > budget) & (a["n"] > 0), "budget_exhausted").otherwise("selected")
        took = outcome == "selected"
        return F.struct((a["used"] + F.when(took, x["chars"]).otherwise(0)).alias("used"), (a["n"] + took.cast("int")).alias("n"), F.concat(a["seen"], F.array(key)).alias("seen"),
                        F.when(took, F.concat(a["paths"], F.array(x["path"]))).otherwise(a["paths"]).alias("paths"), F.concat(a["out"], F.array(outcome)).alias("out"))

    done = grouped.select("request_id", F.aggregate("items", start, step)["out"].alias("out"))
    return placed.join(done, "request_id").withColumn("outcome", F.get("out", F.col("place") - 1)).drop("out")


def select(candidates: DataFrame, max_items: int = 6, budget: int = 3600, per_path: int = 2) -> DataFrame:
    """(request_id, rank, path, start_line, score, outcome) of ``select_rows``."""
    return select_rows(candidates, max_items, budget, per_path).select("request_id", F.col("place").alias("rank"), "path", "start_line", "score", "outcome")


def savings(baseline: Column, output: Column) -> tuple[Column, Column]:
    """C11: tokens saved, and output over baseline (raised to the output at least)."""
    return F.greatest(F.lit(0), baseline - output), F.round(output / F.greatest(baseline, output, F.lit(1)), 4)
