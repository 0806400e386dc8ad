"""Requests, lookups and rollups around packs (S, T, X, C, M, K, E, U, A and J operators
that take several tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .extract import chunks, snippets

PROFILES = ("lean", "minimal", "compact", "normal", "verbose")


def checked_requests(raw: DataFrame) -> DataFrame:
    """``raw(request_id, prompt, task, profile)`` with the prompt (task where it is
    blank), the lower-case profile, and the reason of a reject (null: accepted)."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    prompt, profile = F.coalesce(blank("prompt"), blank("task")), F.lower("profile")
    reason = F.when(prompt.isNull(), "missing_prompt").when(~profile.isin(*PROFILES), "unknown_profile")
    return raw.select("request_id", prompt.alias("prompt"), profile.alias("profile"), reason.alias("reason"))


def validated_requests(raw: DataFrame, known: tuple[str, ...], enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """``raw(request_id, fields)``, a map of texts, with the prompt (``task`` is another
    name of it), each enum field in lower case (blank: its first value), and the reason of
    a reject: fields that nobody knows, no prompt, or a value outside an enum."""
    blank = lambda c: F.nullif(F.trim(F.try_element_at("fields", F.lit(c))), F.lit(""))
    prompt = F.coalesce(blank("prompt"), blank("task"))
    unknown = F.array_sort(F.array_except(F.map_keys("fields"), T.words("prompt", "task", *known, *enums)))
    reason = F.when(F.size(unknown) > 0, F.concat(F.lit("unsupported_fields: "), F.array_join(unknown, ", "))).when(prompt.isNull(), "missing_prompt")
    values = {f: F.lower(F.coalesce(blank(f), F.lit(allowed[0]))) for f, allowed in enums.items()}
    for f, allowed in enums.items():
        reason = reason.when(~values[f].isin(*allowed), f"unknown_{f}")
    return raw.select("request_id", prompt.alias("prompt"), *[v.alias(f) for f, v in values.items()], reason.alias("reason"))


def effective_profile(profile: Column, client: Column, default: str = "compact") -> Column:
    """The given profile, else the client's, else the default."""
    return F.coalesce(profile, F.when(client == "terminal", "minimal").when(client == "editor", "normal"), F.lit(default))


def merged_categories(rows: DataFrame, key: str) -> DataFrame:
    """Whether any text of a key had a category, how many had, and which."""
    each = rows.select(key, F.size("categories").alias("n"), F.explode_outer("categories").alias("c"))
    return each.groupBy(key).agg(F.coalesce(F.bool_or(F.col("c").isNotNull()), F.lit(False)).alias("redacted"), F.count("c").alias("count"), F.array_join(F.sort_array(F.collect_set("c")), ",").alias("categories"))


def signal_counts(rows: DataFrame, key: str) -> DataFrame:
    """Texts of each key by injection category."""
    return rows.select(key, F.explode("categories").alias("category")).groupBy(key, "category").agg(F.count("*").alias("n"))


def chunk_lookup(files: DataFrame, wanted: DataFrame, width: int = 80) -> DataFrame:
    """The chunk that holds each wanted ``line``; lines past the end give none."""
    at = wanted.withColumn("start_line", (F.floor((F.col("line") - 1) / width) * width + 1).cast("int"))
    return at.join(chunks(files, width), ["path", "start_line"]).where("line <= end_line").select("path", "line", "start_line", "end_line", "chunk_id")


def chunk_texts(files: DataFrame, wanted: DataFrame, width: int = 80, most: int = 1200) -> DataFrame:
    """``chunk_lookup`` with the chunk's text, cut to ``most`` characters, redacted."""
    found = chunk_lookup(files, wanted, width)
    texts = snippets(files, found.select("path", "start_line", "end_line").distinct(), most=most)
    keys = ["path", "start_line", "end_line"]
    return found.join(texts.select(*keys, "content", "truncated", "redactions"), keys).select("path", "line", "start_line", "end_line", "chunk_id", "content", "truncated", "redactions")


def first_matching_line(content: Column, terms: list[str]) -> Column:
    """X11: number of the first line that holds any term, 1 if none does."""
    def holds(line: Column) -> Column:
        return F.exists(T.words(*terms), lambda t: F.contains(F.lower(line), t))

    return F.greatest(F.array_position(F.transform(T.lines(content), holds), True), F.lit(1)).cast("int")


def baseline_tokens() -> Column:
    """C10, an aggregate over candidates: the tokens of their evidence (path, range and
    content) as one JSON list, and one for each four characters deferred."""
    chars = F.sum(F.length(F.to_json(F.struct("content", "end_line", "path", "start_line"))) + 1) + 1  # commas and brackets
    return (F.greatest(F.lit(1), F.floor((chars + 3) / 4)) + F.floor((F.greatest(F.sum("deferred_chars"), F.lit(0)) + 3) / 4)).cast("long")


def calls_saved(selected: Column, memory: Column, omitted: Column) -> Column:
    """A call for each selected item, one for memory, one for what was omitted."""
    return selected + F.when(memory > 0, 1).otherwise(0) + F.when(omitted > 0, 1).otherwise(0)


def memory_slice(requests: DataFrame, log: DataFrame, each: int = 2, most: int = 6) -> DataFrame:
    """The first ``each`` rows of every namespace a request names, ``most`` in all.
    A namespace is cut before the join, so its size doesn't matter to it."""
    first = log.withColumn("_r", F.row_number().over(Window.partitionBy("namespace").orderBy("seq"))).where(F.col("_r") <= each).select("namespace", "seq")
    rows = requests.select("request_id", F.explode(F.array_distinct("namespaces")).alias("namespace")).join(first, "namespace")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("namespace", "seq"))).where(F.col("rank") <= most)


def request_reason(lookups: DataFrame, key: str) -> DataFrame:
    """Why a request's fragments were or weren't found, by the first that holds: its
    signature was unavailable (where ``lookups`` says so), a hit, nothing looked up, the
    one reason of all misses, a mixed miss; and hit, miss or bypass as its status."""
    known = F.bool_and(F.coalesce("signature_available", F.lit(True))) if "signature_available" in lookups.columns else F.lit(True)
    rows = lookups.groupBy(key).agg(known.alias("known"), F.bool_or("cache_hit").alias("hit"), F.min("cache_reason").alias("lo"), F.max("cache_reason").alias("hi"))
    reason = F.when(~F.col("known"), "signature_unavailable").when(F.col("hit"), "fragment_hit").when(F.col("lo").isNull(), "no_fragments").when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("fragment_miss")
    return rows.select(key, reason.alias("reason"), F.when(~F.col("known"), "bypass").when(F.col("hit"), "hit").otherwise("miss").alias("status"))


def create_references(rows: DataFrame, run_id: str, key: str, *fields: str) -> DataFrame:
    """JSON body of the fields (keys in order), its hash and size, and an id that
    the run and the row decide."""
    body = F.to_json(F.struct(*sorted(fields)))
    return rows.select(F.concat(F.lit("ref_"), T.digest(F.concat_ws(":", F.lit(run_id), key), 24)).alias("reference_id"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("size_bytes"))


def stage_latency(events: DataFrame) -> DataFrame:
    """Latencies by operation and stage of ``stage_timings``, a map; stages that an
    event didn't time don't count."""
    each = events.select("event_id", "operation", F.explode("stage_timings").alias("stage", "ms")).where("ms is not null")
    total = F.sum(F.col("ms").cast("decimal(18,6)"))
    return each.groupBy("operation", "stage").agg(F.count("*").alias("n"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.max_by("ms", "event_id").alias("last_ms"), F.round(total, 3).cast("double").alias("total_ms"), F.round(total.cast("double") / F.count("*"), 3).alias("avg_ms"))


def fragment_totals(events: DataFrame, fixed: tuple[str, ...] = ()) -> DataFrame:
    """Hits, misses and their ratio by namespace of ``fragments``, a map of
    (hits, misses), with 0 for ``fixed`` namespaces that no event has, and over all as *."""
    each = events.select(F.explode("fragments").alias("namespace", "f")).select("namespace", "f.hits", "f.misses")
    if fixed:
        each = each.unionByName(events.sparkSession.createDataFrame([(n, 0, 0) for n in fixed], "namespace string, hits long, misses long"))
    rows = each.rollup("namespace").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    zero = rows.select(F.coalesce("namespace", F.lit("*")).alias("namespace"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("misses", F.lit(0)).alias("misses"))
    return zero.withColumn("ratio", F.coalesce(F.round(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), 4), F.lit(0.0)))


def snapshot(totals: DataFrame) -> DataFrame:
    """Ratios and averages of the one row of totals."""
    n = F.greatest("n", F.lit(1))
    return totals.select(T.hit_ratio(F.col("hits"), F.col("misses")).alias("hit_ratio"), F.round(F.col("saved_tokens") / n, 4).alias("avg_saved"), F.round(F.col("candidates") / F.greatest("selected", F.lit(1)), 4).alias("candidates_per_selected"))


def pack_kpis(by_operation: DataFrame, pack: str) -> DataFrame:
    """The averages a pack of A02's row of the pack operation, 3 places."""
    per = lambda c: F.round(F.col(c) / F.greatest("n", F.lit(1)), 3)
    return by_operation.where(F.col("operation") == pack).select(
        F.col("n").alias("packs"), per("saved_tokens").alias("avg_saved"), per("baseline_tokens").alias("avg_baseline"), per("output_tokens").alias("avg_output"), "compression", per("calls_saved").alias("avg_calls_saved"), F.col("deferred_bytes").alias("bytes_deferred"),
        per("deferred_bytes").alias("avg_bytes_deferred"), per("candidates").alias("avg_candidates"), per("selected").alias("avg_selected"), "candidates_per_selected", "avg_ms", "min_ms", "max_ms", T.hit_ratio(F.col("hits"), F.col("misses")).alias("hit_ratio"))


def infer_project(hints: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """The one root that holds hinted paths of a key, ambiguous if several do, null
    if none does."""
    rows = hints.join(assigned, "path", "left").groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return rows.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), "ambiguous").alias("root"))
