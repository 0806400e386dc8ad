"""Packs with their memory, skill cards and metrics, and what each profile shows of them
(C14, M09, P09-P11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import corpus, evidence, lookup, pack

#: Rows of a namespace's memory that a pack takes, and rows in all.
EACH, MOST = 2, 6
DIAGNOSTICS = ("none", "compact", "full")
# What a summarised cache shows, and its counters
CACHE_TEXT = ("key", "namespace", "reason", "status", "expires_at")
CACHE_COUNTS = ("fragment_hits", "fragment_misses", "chunk_hits", "chunk_misses")


def memory_context(requests: DataFrame, summaries: DataFrame, decisions: DataFrame) -> DataFrame:
    """The memory of each of ``requests(request_id, route, session)``: the first two
    summaries and effective decisions of the workspace, of its route and of its session,
    six at most of each, and how many there were.  ``summaries`` and ``decisions`` have
    (namespace, seq, key, value).  A namespace is cut before the join, so its size doesn't
    matter."""
    named = F.array(F.lit("workspace"), F.concat(F.lit("route/"), "route"), F.concat(F.lit("session/"), F.coalesce(F.nullif("session", F.lit("")), F.lit("default"))))
    asked = requests.select("request_id", F.posexplode(named).alias("at", "namespace"))
    item = F.struct("at", "seq", "namespace", "key", "value")

    def of(rows: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("namespace").orderBy("seq"))
        first = rows.select("namespace", "seq", "key", "value").withColumn("_r", rank).where(F.col("_r") <= EACH)
        found = asked.join(first, "namespace").groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
        taken = F.transform(F.slice("xs", 1, MOST), lambda x: F.struct(x["namespace"].alias("namespace"), x["key"].alias("key"), x["value"].alias("value")))
        return found.select("request_id", F.size("xs").alias(f"{name}_count"), taken.alias(name))

    rows = requests.select("request_id").join(of(summaries, "summaries"), "request_id", "left").join(of(decisions, "decisions"), "request_id", "left")
    none = F.array().cast("array<struct<namespace:string,key:string,value:string>>")
    return rows.select("request_id", F.struct(F.coalesce("summaries_count", F.lit(0)).alias("summary_count"), F.coalesce("summaries", none).alias("summaries"), F.coalesce("decisions_count", F.lit(0)).alias("decision_count"), F.coalesce("decisions", none).alias("effective_decisions")).alias("memory"))


def skill_guidance(requests: DataFrame, skills: DataFrame, n: int = 3) -> DataFrame:
    """M12 with M13: (request_id, skill_cards): the cards of each request's best skills."""
    best = lookup.rank_skills(skills, requests, n).join(skills.select("skill_id", "namespace", "key", "value"), "skill_id")
    cards = lookup.skill_cards(best.select("skill_id", "namespace", "key", "value").distinct())  # a skill's card is made once
    card = F.struct("rank", *[c for c in cards.columns if c != "skill_id"])
    return best.select("request_id", "rank", "skill_id").join(cards, "skill_id").groupBy("request_id").agg(F.array_sort(F.collect_list(card)).alias("skill_cards"))


def whole_packs(packs: DataFrame, memory: DataFrame, cards: DataFrame) -> DataFrame:
    """C14: ``assemble.packs`` with memory, skill cards and metrics: tokens of the shown
    evidence against those of all candidates (raised to what is shown), what that saves,
    and the calls it spares."""
    rows = packs.join(memory, "request_id", "left").join(cards, "request_id", "left")
    none = F.array().cast(dict(cards.dtypes)["skill_cards"])
    shown = F.transform(F.coalesce("items", F.array().cast(dict(packs.dtypes)["items"])), lambda x: F.length(F.to_json(F.struct(x["content"].alias("content"), x["end_line"].alias("end_line"), x["path"].alias("path"), x["start_line"].alias("start_line")))) + 1)
    output = F.greatest(F.lit(1), F.floor((F.aggregate(shown, F.lit(1), lambda a, x: a + x) + 3) / 4)).cast("long")
    rows = rows.withColumn("skill_cards", F.coalesce("skill_cards", none)).withColumn("_out", output).withColumn("_base", F.greatest(F.coalesce("baseline_tokens", F.lit(0)), "_out"))
    saved, ratio = pack.savings(F.col("_base"), F.col("_out"))
    kept = F.col("memory.summary_count") + F.col("memory.decision_count")
    metrics = F.struct("candidate_count", "selected_count", F.col("_base").alias("baseline_tokens"), F.col("_out").alias("output_tokens"), saved.alias("tokens_saved"), ratio.alias("compression_ratio"), evidence.calls_saved(F.col("selected_count"), kept, F.size("omitted")).alias("calls_saved"))
    return rows.select("request_id", "route", "terms", "prompt_sha256", "items", "omitted", "memory", "skill_cards", metrics.alias("metrics"))


def minimal_line(route: Column, items: Column, omitted: Column, summaries: Column) -> Column:
    """One line that names the three best paths, how many rows wait, and whether
    there is memory."""
    paths = F.array_join(F.transform(F.slice(items, 1, 3), lambda x: x["path"]), ", ")
    waits = F.when(F.size(omitted) > 0, F.concat(F.lit(" "), F.size(omitted).cast("string"), F.lit(" lower-ranked items deferred."))).otherwise("")
    noted = F.when(summaries > 0, " Memory summaries available in diagnostics.").otherwise("")
    return F.when(F.size(items) > 0, F.concat(route, F.lit(" context: top evidence in "), paths, F.lit("."), waits, noted)).otherwise(F.concat(route, F.lit(" context: no matching repository evidence selected.")))


def _shown_item(x: Column, content: Column) -> Column:
    return F.struct(x["path"].alias("path"), F.array(x["start_line"], x["end_line"]).alias("lines"), x["reason_codes"].alias("reason"), corpus.confidence_bucket(x["score"], x["confidence"]).alias("confidence"), content.alias("content"))


def lean_item(x: Column, terms: Column) -> Column:
    """P10: explicit paths keep 180 characters, others 140."""
    explicit = F.array_contains(x["reason_codes"], "explicit_path")
    return _shown_item(x, F.when(explicit, lookup.lean_content(x["content"], terms, 180)).otherwise(lookup.lean_content(x["content"], terms, 140)))


def cache_summary(cache: DataFrame) -> DataFrame:
    """(request_id, cache): what a summarised cache shows; what ``cache`` lacks is
    empty or 0, and ratios follow from the counts."""
    have = set(cache.columns)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in CACHE_TEXT]
    count = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in have else F.lit(0).cast("long") for c in CACHE_COUNTS}
    ratio = lambda k: F.coalesce(F.round(F.try_divide(count[f"{k}_hits"], count[f"{k}_hits"] + count[f"{k}_misses"]), 4), F.lit(0.0)).alias(f"{k}_hit_ratio")
    hit = F.coalesce(F.col("hit"), F.lit(False)) if "hit" in have else F.lit(False)
    return cache.select("request_id", F.struct(hit.alias("hit"), *text, *[c.alias(n) for n, c in count.items()], ratio("fragment"), ratio("chunk")).alias("cache"))


def projected(whole: DataFrame, profile: str, diagnostics: str = "compact", cache: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """What a profile shows of whole packs.

    minimal: route, one line, items with confidence buckets and no scores.  lean: route,
    counts, items cut to the lines with a term.  compact, normal and verbose: the pack with
    memory, cards, the cache (whole with full diagnostics, else summarised) and metrics
    (with the retrieval plan only in full), and, unless diagnostics are none, the
    ``details(request_id, indexing, safety, retrieval_plan)``.
    """
    if profile == "minimal":
        items = F.transform("items", lambda x: _shown_item(x, x["content"]))
        return whole.select("request_id", "route", minimal_line(F.col("route"), F.col("items"), F.col("omitted"), F.col("memory.summary_count")).alias("summary"), items.alias("items"), "skill_cards")
    if profile == "lean":
        summary = F.struct(F.size("items").alias("item_count"), (F.size("omitted") > 0).alias("evidence_deferred"))
        return whole.select("request_id", "route", summary.alias("summary"), F.transform("items", lambda x: lean_item(x, F.col("terms"))).alias("items"), "skill_cards")
    if diagnostics not in DIAGNOSTICS:
        raise ValueError(f"diagnostics is one of {DIAGNOSTICS}")
    out = whole
    if cache is not None:
        shown = cache.select("request_id", F.struct(*[c for c in cache.columns if c != "request_id"]).alias("cache")) if diagnostics == "full" else cache_summary(cache)
        out = out.join(shown, "request_id", "left")
    if details is not None:
        keep = {"none": [], "compact": ["indexing", "safety"], "full": ["indexing", "safety", "retrieval_plan"]}[diagnostics]
        out = out.join(details.select("request_id", *[c for c in keep if c in details.columns]), "request_id", "left")
    return out


# Rows of a key-value state


def value_type(value: Column) -> Column:
    """The kind of a JSON value."""
    first = F.substring(F.ltrim(value), 1, 1)
    return F.when(first == "{", "dict").when(first == "[", "list").when(first == '"', "str").when(first.isin("t", "f"), "bool").when(first == "n", "NoneType").when(value.rlike("[.eE]"), "float").otherwise("int")


def row_previews(rows: DataFrame, max_chars: int) -> DataFrame:
    """For ``rows(key, value)``, JSON values: type, size of the sanitised value, the
    fields that objects have, and the sanitised text, cut to ``max_chars`` with a marker."""
    from ..functions.sanitize import sanitize_json
    from .stage import kept

    made = kept(rows.select("key", "value", sanitize_json(F.col("value"))["json"].alias("safe")), "previews")  # Python runs once
    is_object = F.ltrim("value").startswith("{")
    field = lambda name: F.coalesce(F.when(is_object, F.get_json_object("value", f"$.{name}")), F.lit("")).alias(name)
    cut = F.when(F.length("safe") <= max_chars, F.col("safe")).otherwise(F.concat(F.substring("safe", 1, max(0, max_chars - 14)), F.lit("\n...[truncated]")))
    return made.select("key", value_type(F.col("value")).alias("value_type"), F.length("safe").alias("size_chars"), *[field(n) for n in ("schema", "status", "created_at", "updated_at", "expires_at", "namespace")], cut.alias("preview"))


def state_class(key: Column, namespace: Column, schema: Column) -> Column:
    """The namespace, else what the key begins with, else what the schema does."""
    inner = F.regexp_replace(key, "^cache:", "")
    by_key = F.when(key.startswith("cache:"), F.when(inner.contains(":"), F.substring_index(inner, ":", 1)).otherwise("cache")).when(key.contains(":"), F.substring_index(key, ":", 1))
    by_schema = F.when(F.trim(schema) != "", F.substring_index(F.trim(schema), ".", 1)).otherwise("-")
    return F.when(F.trim(namespace) != "", F.trim(namespace)).otherwise(F.coalesce(by_key, by_schema))


def search_rows(previews: DataFrame, text: str, n: int) -> DataFrame:
    """The rows with ``text`` in any of ten columns, by class, newest first, by key."""
    rows = previews.withColumn("state_class", state_class(F.col("key"), F.col("namespace"), F.col("schema")))
    columns = ("key", "value_type", "schema", "status", "namespace", "created_at", "updated_at", "expires_at", "preview", "state_class")
    time = lambda c: F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))
    newest = F.coalesce(F.unix_micros(F.coalesce(time("created_at"), time("updated_at"), time("expires_at"))), F.lit(0))
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))).orderBy(F.lower("state_class"), F.desc(newest), "key").limit(n)
