"""Lookups by path and symbol, item projections, and comparisons of packs (R, P, A, J, K, M, U operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .stage import kept

EXACT_SCORE = 10_000
#: Least cold-to-warm improvement and least fragment hit ratio of a passed case.
MIN_IMPROVEMENT, MIN_HIT_RATIO = 0.3, 0.6


def promote_exact(hits: DataFrame, requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, path, score) with the file that a path-like query names put
    first; the other hits keep their scores."""
    named = requests.select("request_id", F.lower(T.path_like(F.col("query"))).alias("key")).where("key <> ''")
    exact = named.join(files.select("path", F.lower("path").alias("key")), "key").select("request_id", "path", F.lit(EXACT_SCORE).cast("double").alias("score"))
    scored = hits.select("request_id", "path", F.col("score").cast("double").alias("score"))
    return scored.unionByName(exact).groupBy("request_id", "path").agg(F.max("score").alias("score"))


def _grams(text: Column) -> Column:
    """The different runs of three characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3))))


#: Different runs of three characters of requests' terms that are broadcast.
BROADCAST_GRAMS = 200_000
#: One file of so many is searched first; what it gives bounds the search of all and replaces none of it.
SLICE = 64
#: Terms of requests and of their prompts that are broadcast to the skills (about 100 bytes each).
BROADCAST_SIDES = 300_000


def rarest_grams(texts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(term, key) of texts ``h`` that contain the term's rarest run of three characters:
    the one that fewest texts have.  Texts' runs that no term has are left where they
    are read; a run's texts are counted before its terms choose."""
    sought = terms.select("term").distinct().select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    wanted = sought.select("gram").distinct()
    if wanted.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        wanted = F.broadcast(wanted)
    lists = kept(texts.select(key, F.explode(_grams(F.col("h"))).alias("gram")).join(wanted, "gram"), "grams")
    spread = lists.groupBy("gram").agg(F.count("*").alias("n"))
    # a term with a run that no text has is in none
    least = sought.join(spread, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    return least.where("least.n > 0").select("term", "least.gram").join(lists, "gram").select("term", key)


def _searched(symbols: DataFrame) -> DataFrame:
    return symbols.select("path", "name", "line_start", F.lower(F.concat_ws(" ", "path", "name", "signature")).alias("h"))


def _in_slice() -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(SLICE)) == 0


def _runs(text: Column) -> Column:
    """``_grams`` without white space, in one pass over a long text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?=(\S{3}))"), F.lit(1)))


def _chosen_runs(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, gram): the run of three characters of each different term by which it is
    looked up.  Any does; that which a slice of the files has in fewest texts costs least."""
    sought = terms.select("term").distinct().select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    wanted = sought.select("gram").distinct()
    if wanted.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        wanted = F.broadcast(wanted)
    spread = rows.where(_in_slice()).select(F.explode(_runs(F.col("h"))).alias("gram")).join(wanted, "gram").groupBy("gram").agg(F.count("*").alias("n"))
    least = sought.join(spread, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    return kept(least.select("term", "least.gram"), "runs")


def _holding(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows(path, name, line_start, h)`` with each term of ``chosen(term, gram, last)``
    that their text holds, up to the term's last path (null: all).  Runs that no term has
    chosen are left where they are read."""
    near = F.broadcast(chosen) if chosen.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else chosen
    met = rows.withColumn("gram", F.explode(_runs(F.col("h")))).join(near, "gram")
    return met.where(F.contains("h", F.col("term")) & F.coalesce(F.col("path") <= F.col("last"), F.lit(True))).select("term", "path", "name", "line_start")


def symbol_hits(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """(request_id, path, name, line_start) of symbols whose path, name or
    signature contains a term of the request; terms have three characters at least and no
    white space."""
    rows = _searched(symbols)
    found = _holding(rows, _chosen_runs(rows, terms).withColumn("last", F.lit(None).cast("string")))
    return found.join(terms, "term").select("request_id", "path", "name", "line_start").distinct()


def first_symbol_hits(symbols: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of ``symbol_hits`` of each request by path, line and name, with
    their rank, without making the others.

    They are among the first ``n`` of its terms.  A slice of the files is searched first:
    a term's n-th hit there can't lie before its n-th hit of all, so of all files only those
    up to its path are kept for the term.  A term with fewer hits in the slice has no bound.
    """
    place = F.dense_rank().over(Window.partitionBy("term").orderBy("path", "line_start", "name"))
    first = lambda hits: hits.withColumn("place", place).where(F.col("place") <= n)
    rows = _searched(symbols)
    chosen = _chosen_runs(rows, terms)
    free = chosen.withColumn("last", F.lit(None).cast("string"))
    last = first(_holding(rows.where(_in_slice()), free)).where(F.col("place") == n).groupBy("term").agg(F.max("path").alias("last"))
    found = first(_holding(rows, kept(chosen.join(last, "term", "left"), "bounds")))
    return first_symbols(found.join(terms, "term").select("request_id", "path", "name", "line_start").distinct(), n)


def first_symbols(hits: DataFrame, n: int) -> DataFrame:
    """R09's limit: the first ``n`` of a request by path, line and name."""
    w = Window.partitionBy("request_id").orderBy("path", "line_start", "name")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def related_symbols(targets: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """Symbols found for a request in its target's file (high) or in a file of
    the same stem (medium), from the first 4 n (20 at least) hits."""
    pool = first_symbols(hits, max(4 * n, 20)).withColumnRenamed("rank", "place")
    j = pool.join(targets.select("request_id", F.col("path").alias("target")), "request_id").where((F.col("path") == F.col("target")) | (stem(F.col("path")) == stem(F.col("target"))))
    w = Window.partitionBy("request_id").orderBy("place")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("request_id", "rank", "path", "name", F.when(F.col("path") == F.col("target"), "high").otherwise("medium").alias("confidence"))


def minimal_summary(selected: DataFrame, omitted: DataFrame, route: str) -> DataFrame:
    """One line a request that names its three best paths and how many rows wait."""
    tops = selected.where("rank <= 3").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("t"))
    rest = omitted.groupBy("request_id").agg(F.count("*").alias("n"))
    tail = F.when(F.col("n") > 0, F.concat(F.lit(" "), F.col("n").cast("string"), F.lit(" lower-ranked items deferred."))).otherwise("")
    line = F.concat(F.lit(f"{route} context: top evidence in "), F.array_join("t.path", ", "), F.lit("."), tail)
    return tops.join(rest, "request_id", "left").select("request_id", line.alias("summary"))


def lean_content(content: Column, terms: Column, most: int = 140) -> Column:
    """P10: content over ``most`` characters becomes its lines that hold a term of
    three or more characters (else its first two), joined and trimmed."""
    needles = F.transform(F.filter(terms, lambda t: F.length(t) > 2), F.lower)

    def short(v: Column) -> Column:
        chosen = F.filter(v["lines"], lambda x: T.bound(F.lower(x), lambda low: F.exists(v["needles"], lambda t: F.contains(low, t))))
        return T.bound(chosen, lambda c: F.array_join(F.when(F.size(c) > 0, c).otherwise(F.slice(v["lines"], 1, 2)), " … "))

    cut = T.bound(T.bound(F.struct(T.lines(content).alias("lines"), needles.alias("needles")), short), lambda s: T.trim_text(s, most))
    return F.when(F.length(content) <= most, content).otherwise(cut)


def selected_with_term(terms: DataFrame, items: DataFrame) -> DataFrame:
    """How many of a request's selected items hold each of its terms in their path,
    title, content or reasons (as far as ``items`` has them)."""
    text = [F.array_join(c, " ") if c == "reason_codes" else F.col(c) for c in ("path", "title_hint", "content", "reason_codes") if c in items.columns]
    j = terms.join(items.select("request_id", F.lower(F.concat_ws(" ", *text)).alias("h")), "request_id")
    return j.groupBy("request_id", "term").agg(F.count_if(F.contains("h", F.lower("term"))).alias("n"))


def skill_rows(log: DataFrame, as_of: Column) -> DataFrame:
    """Live entries and summaries in ``skills/`` namespaces."""
    return log.where(F.col("namespace").startswith("skills/") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))


def skill_memory(facts: DataFrame, summaries: DataFrame, as_of: Column) -> DataFrame:
    """Live facts (by ``key``) and summaries (by ``focus``) of ``skills/`` namespaces
    with their kind, sorted by namespace, name and last change."""
    columns = ("record_kind", "namespace", "name", "seq", "text", "confidence", "updated_at")
    parts = [rows.where(F.col("namespace").startswith("skills/") & F.coalesce(F.col("expires_at") >= as_of, F.lit(True))).withColumn("record_kind", F.lit(kind)).withColumn("name", F.col(name)).withColumn("text", F.col(text)).select(*columns)
             for rows, kind, name, text in ((facts, "entry", "key", "value"), (summaries, "summary", "focus", "summary"))]
    return parts[0].unionByName(parts[1]).orderBy("namespace", "name", "updated_at", "record_kind", "seq")


def rank_skills(skills: DataFrame, requests: DataFrame, n: int = 3) -> DataFrame:
    """(request_id, skill_id, rank, score): 3 for each of a request's terms in a
    skill's text, 2 for each in its key, 2 for the route in its text, a half for each of
    the text's first 24 terms in the prompt, and its confidence; above 1, the best ``n``.
    Points are added up by the terms that one side's text holds of the other, so no text
    meets another; a skill's pairs are added up where its text lies and cut to each request's
    best before they are exchanged."""
    text = F.lower(F.concat_ws(" ", "namespace", "key", "value"))
    known = skills.select("skill_id", F.lower("key").alias("key"), text.alias("h"), T.query_terms(text, 24).alias("own"), F.least("confidence", F.lit(1.0)).alias("confidence"))
    known = kept(known, "skills")
    asked = requests.select("request_id", F.lower("prompt").alias("prompt"), T.query_terms(F.col("prompt")).alias("terms"), F.lower("route").alias("route"))
    terms, routes = asked.select("request_id", F.explode("terms").alias("term")), asked.where("route <> ''").select("request_id", F.col("route").alias("term"))
    offered = known.select(F.explode("own").alias("term")).distinct()
    prompts = asked.select("request_id", F.col("prompt").alias("h"))
    sought = terms.union(routes).select("term").distinct()
    found = rarest_grams(known, "skill_id", sought.where(F.length("term") >= 3))
    short = sought.where(F.length("term") < 3)  # a route may be
    found = found.union(known.join(F.broadcast(short), F.contains("h", F.col("term"))).select("term", "skill_id"))
    named = rarest_grams(prompts, "request_id", offered).join(prompts, "request_id").where(F.contains("h", F.col("term"))).select("request_id", "term")
    sides = kept(terms.withColumn("kind", F.lit("term")).unionByName(routes.withColumn("kind", F.lit("route"))).unionByName(named.withColumn("kind", F.lit("own"))), "skill-sides")
    if sides.count() <= BROADCAST_SIDES:
        sides = F.broadcast(sides)
    point = lambda kind, t, n: F.struct(F.lit(kind).alias("kind"), t.alias("term"), n.cast("long").alias("halves"))
    by_skill = known.join(found.groupBy("skill_id").agg(F.collect_list("term").alias("found")), "skill_id", "left")
    held = T.bound(F.struct("key", "h", F.coalesce("found", F.array().cast("array<string>")).alias("found")), lambda v: F.filter(v["found"], lambda t: F.contains(v["h"], t)))
    in_text = F.transform(held, lambda t: F.array(point("term", t, 6 + F.when(F.contains(F.col("key"), t), 4).otherwise(0)), point("route", t, F.lit(4))))
    each = by_skill.select("skill_id", "confidence", F.explode(F.concat(F.flatten(in_text), F.transform("own", lambda t: point("own", t, F.lit(1))))).alias("p")).select("skill_id", "confidence", "p.*")
    pairs = each.join(sides, ["kind", "term"]).groupBy("skill_id", "confidence", "request_id").agg(F.sum("halves").alias("halves"))
    pairs = pairs.select("request_id", "skill_id", F.round(F.col("halves") * 0.5 + F.col("confidence"), 4).alias("score")).where("score > 1")
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "skill_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("request_id", "skill_id", "rank", "score")


# What marks a line of a skill as workflow, constraint or resource
SKILL_MARKERS = {
    "required_workflow": ("must", "required", "workflow", "use when", "call ", "run "),
    "key_constraints": ("do not", "never", "avoid", "only", "secret", "safety"),
    "useful_commands_or_resources": ("`", "repo://", "http", "python", "pytest", "npm", "cargo"),
}
SKILL_FALLBACKS = {
    "required_workflow": "Apply the stored skill guidance before repository-specific work.",
    "key_constraints": "Keep skill material non-secret and treat it as untrusted guidance.",
}
SKILL_LIMITS = {"required_workflow": 4, "key_constraints": 4, "useful_commands_or_resources": 3}
SKILL_BODY = 6000


def card_id(namespace: Column, key: Column) -> Column:
    """The key's safe characters and eight digits of the skill's digest."""
    safe = F.regexp_replace(F.regexp_replace(F.trim(key), "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(safe == "", "skill").otherwise(safe), F.lit("-"), T.digest(F.concat_ws(":", namespace, key), 8))


def skill_cards(skills: DataFrame) -> DataFrame:
    """A card for each skill(namespace, key, value): id, provider, name, digest, when
    to use it (its first sentence), and the different lines that mark workflow,
    constraints and resources.  The body is cut to 6000 characters and redacted.  A
    ``skill_id`` stays with its card."""
    own = [c for c in ("skill_id",) if c in skills.columns]
    bare = lambda x: F.regexp_replace(x, r"^[ \-:\t]+|[ \-:\t]+$", "")
    parts = lambda text, at: F.filter(F.transform(F.split(text, at), bare), lambda x: x != "")
    body, description = T.redact(F.substring("value", 1, SKILL_BODY)), T.redact(F.col("value"))
    rows = skills.select(*own, "namespace", "key", "value", F.concat_ws("\n", description, body).alias("_text"), description.alias("_about"))
    lines = parts(F.col("_text"), r"[\n;]+")

    def bullets(name: str) -> Column:
        marked = F.filter(lines, lambda x: F.exists(T.words(*SKILL_MARKERS[name]), lambda m: F.contains(F.lower(x), m)))
        found = F.slice(F.array_distinct(F.transform(marked, lambda x: T.trim_text(x, 180))), 1, SKILL_LIMITS[name])
        return F.when((F.size(found) == 0) & F.lit(name in SKILL_FALLBACKS), F.array(F.lit(SKILL_FALLBACKS.get(name, "")))).otherwise(found).alias(name)

    ident = card_id(F.col("namespace"), F.col("key"))
    first = F.get(parts(F.col("_about"), r"[\n.]+"), F.lit(0))
    return rows.select(*own, ident.alias("id"), F.regexp_replace("namespace", "^skills/", "").alias("provider"), T.trim_text(F.col("key"), 80).alias("name"), F.concat(F.lit("sha256:"), F.sha2("value", 256)).alias("content_digest"),
                       F.coalesce(T.trim_text(first, 180), F.concat(F.lit("Use for tasks matching "), "key", F.lit("."))).alias("when_to_use"), *[bullets(n) for n in SKILL_MARKERS])


def miss_reasons(misses: DataFrame, entries: DataFrame) -> DataFrame:
    """K05 for misses and entries with (namespace, schema_version, signature, path) alone:
    ``misses`` with their reason."""
    from . import warm

    asked = kept(misses.withColumn("miss_id", F.monotonically_increasing_id()), "misses")
    found = warm.miss_reasons(asked.withColumnRenamed("signature", "refresh_signature"), entries.withColumnRenamed("signature", "refresh_signature"))
    return asked.join(found, "miss_id").select(*misses.columns, "reason")


def retrieval_quality(anchors: DataFrame, items: DataFrame) -> DataFrame:
    """Recall of required anchors in the first 3 and 5 items, mean first rank,
    share of items that aren't anchors, required anchors left out; one row."""
    ranked = items.groupBy("task", "path").agg(F.min("rank").alias("rank"))
    need = F.coalesce("required", F.lit(True))  # required where nothing is said
    found = anchors.join(ranked, ["task", "path"], "left").agg(
        F.count_if(need).alias("n"), F.count_if(need & (F.col("rank") <= 3)).alias("h3"), F.count_if(need & (F.col("rank") <= 5)).alias("h5"),
        F.avg("rank").alias("mean"), F.count_if(need & F.col("rank").isNull()).alias("lost"))
    noise = items.join(anchors.select("task", "path", F.lit(1).alias("_hit")).distinct(), ["task", "path"], "left").agg(F.count("*").alias("rows"), F.count_if(F.col("_hit").isNull()).alias("noise"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 4)
    # each side is one row
    return found.crossJoin(noise).select(share("h3", "n").alias("anchor_recall_at_3"), share("h5", "n").alias("anchor_recall_at_5"), F.round("mean", 4).alias("first_anchor_rank_avg"), share("noise", "rows").alias("noise_ratio"), F.col("lost").alias("required_omissions"))


def quality_report(fixtures: DataFrame, anchors: DataFrame, items: DataFrame, banned: DataFrame) -> DataFrame:
    """``retrieval_quality`` with the share of items that have a detail pointer and
    the number of ``banned(task, path, reason)`` paths that came, for each of
    ``fixtures(task)``; one row.  ``items`` has ``detail``, null without a pointer."""
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 4)
    detail = items.agg(F.count("detail").alias("d"), F.count("*").alias("rows"))
    stale = banned.join(items.select("task", "path").distinct(), ["task", "path"], "left_semi").agg(F.count("*").alias("stale"))
    # each side is one row
    rows = retrieval_quality(anchors, items).crossJoin(detail).crossJoin(stale).crossJoin(fixtures.agg(F.count("*").alias("fixtures")))
    return rows.select("fixtures", "anchor_recall_at_3", "anchor_recall_at_5", F.coalesce("first_anchor_rank_avg", F.lit(0.0)).alias("first_anchor_rank_avg"), "noise_ratio", "required_omissions", share("d", "rows").alias("detail_lookup_rate"), share("stale", "fixtures").alias("stale_rate"))


def quality_regressions(anchors: DataFrame, items: DataFrame, banned: DataFrame) -> DataFrame:
    """(task, path, reason): required anchors that no item has, and banned paths that
    one has (reason must_not_include where none is given)."""
    came = items.select("task", "path").distinct()
    lost = anchors.where(F.coalesce("required", F.lit(True))).join(came, ["task", "path"], "left_anti").select("task", "path", F.lit("required_anchor_omitted").alias("reason"))
    return lost.unionByName(banned.join(came, ["task", "path"], "left_semi").select("task", "path", F.coalesce("reason", F.lit("must_not_include")).alias("reason")))


def warm_recall(runs: DataFrame) -> DataFrame:
    """(case_id, required_anchor_recall): the least share of a case's different
    ``required`` paths among the ``selected`` of a warm run; 1 where none is required."""
    need = F.array_distinct("required")
    share = F.when(F.size(need) > 0, F.size(F.array_intersect(need, F.col("selected"))) / F.size(need)).otherwise(1.0)
    return runs.groupBy("case_id").agg(F.round(F.coalesce(F.min(F.when(F.col("phase") == "warm", F.coalesce(share, F.lit(1.0)))), F.lit(1.0)), 4).alias("required_anchor_recall"))


def cold_and_warm(runs: DataFrame) -> DataFrame:
    """Medians of cold and warm runs of a case, the improvement, the warm hit
    ratio, whether each repeat chose the same both times, and the verdict."""
    warm = F.col("phase") == "warm"
    same = runs.groupBy("case_id", "repeat").agg((F.min("selection") == F.max("selection")).alias("same")).groupBy("case_id").agg(F.bool_and("same").alias("retained"))
    sums = runs.groupBy("case_id").agg(F.median(F.when(~warm, F.col("elapsed_ms"))).alias("cold"), F.median(F.when(warm, F.col("elapsed_ms"))).alias("hot"), F.sum(F.when(warm, F.col("hits"))).alias("h"), F.sum(F.when(warm, F.col("misses"))).alias("m"))
    improvement = F.when(F.col("cold") > 0, (F.col("cold") - F.col("hot")) / F.col("cold")).otherwise(0.0)
    ratio = F.coalesce(F.try_divide(F.col("h"), F.col("h") + F.col("m")), F.lit(0.0))
    verdict = F.coalesce((ratio >= MIN_HIT_RATIO) & (improvement >= MIN_IMPROVEMENT) & F.col("retained"), F.lit(False))
    return sums.join(same, "case_id").select("case_id", F.round("cold", 3).alias("cold_median_ms"), F.round("hot", 3).alias("warm_median_ms"), F.round(improvement, 4).alias("improvement"), F.round(ratio, 4).alias("fragment_hit_ratio"), "retained", verdict.alias("passed"))


def warm_verdict(runs: DataFrame) -> DataFrame:
    """``cold_and_warm`` of runs whose selection is the ordered list ``selected``,
    with ``warm_recall``; a case passes only with all required paths in every warm run."""
    rows = cold_and_warm(runs.withColumn("selection", F.col("selected"))).join(warm_recall(runs), "case_id")
    return rows.withColumn("passed", F.col("passed") & (F.col("required_anchor_recall") >= 1))


def resolve(requests: DataFrame, known: DataFrame) -> DataFrame:
    """The project of each request: its root, else its id (which must be
    known), else the only visible root, else the inferred one, else an error."""
    rows = requests.join(known.select(F.col("project_id").alias("_known")).distinct(), F.col("project_id") == F.col("_known"), "left")
    given, by_id = F.col("root_uri") != "", F.col("project_id") != ""
    seen = F.size("visible")
    project = F.when(given, F.col("root_uri")).when(by_id, F.col("_known")).when(seen == 1, F.get("visible", F.lit(0))).when(seen > 1, F.col("inferred"))
    error = F.when(given, "").when(by_id, F.when(F.col("_known").isNull(), "unknown_project").otherwise("")).when(seen == 1, "").when(seen > 1, F.when(F.col("inferred").isNull(), "ambiguous_project").otherwise("")).otherwise("project_selection_required")
    return rows.select("request_id", project.alias("project"), error.alias("error"))


def resolve_projects(requests: DataFrame, visible: DataFrame, known: DataFrame, listing: DataFrame) -> DataFrame:
    """J03 and J04 together: (request_id, project, source, error) for each of
    ``requests(request_id, root_uri, project_id, hints)``.

    ``visible(request_id, project_id, root)`` are its roots, ``known(project_id)`` all
    others.  A root URI comes first (T16; else invalid_root_uri), then an id that is
    visible or known (else unknown_project), then the only visible root, then the one
    visible root that holds a hint: an absolute hint by its prefix, another by a file or
    folder of ``listing(path)`` under the root (else ambiguous_project).  Without visible
    roots it is project_selection_required.  Hints are bounded by the request, so the
    candidates are few; the listing is met by a semi-join."""
    uri = T.canonical_uri(F.nullif(F.col("root_uri"), F.lit("")))
    asked = requests.select("request_id", F.nullif(F.col("root_uri"), F.lit("")).alias("raw"), uri.alias("uri"), F.nullif(F.col("project_id"), F.lit("")).alias("wanted"), "hints")
    roots = visible.select("request_id", F.col("project_id").alias("pid"), T.absolute_path(F.col("root")).alias("root")).distinct()
    seen = roots.groupBy("request_id").agg(F.count_distinct("pid").alias("n"), F.min("pid").alias("only"))
    hints = asked.select("request_id", F.explode(F.array_distinct(F.transform("hints", T.strip))).alias("hint")).where("hint not in ('', '.')")
    tried = hints.join(roots, "request_id").select("request_id", "pid", "root", F.col("hint").startswith("/").alias("given"), T.absolute_path(F.when(F.col("hint").startswith("/"), F.col("hint")).otherwise(F.concat("root", F.lit("/"), "hint"))).alias("at"))
    tried = tried.where((F.col("at") == F.col("root")) | F.col("at").startswith(F.concat(F.regexp_replace("root", "/$", ""), F.lit("/"))))
    paths = listing.select(T.absolute_path(F.col("path")).alias("p"))
    up = paths.select(F.explode(F.sequence(F.lit(2), F.size(F.split("p", "/")))).alias("k"), F.split("p", "/").alias("s")).select(F.array_join(F.slice("s", F.lit(1), F.col("k")), "/").alias("at"))
    there = tried.where("not given").join(up, "at", "left_semi").select("request_id", "pid")
    held = tried.where("given").select("request_id", "pid").unionByName(there).groupBy("request_id").agg(F.count_distinct("pid").alias("held"), F.min("pid").alias("inferred"))
    ids = known.select("project_id").distinct().select(F.col("project_id").alias("wanted"), F.lit(True).alias("_known"))
    own = roots.select("request_id", F.col("pid").alias("wanted"), F.lit(True).alias("_own")).distinct()
    j = asked.join(seen, "request_id", "left").join(held, "request_id", "left").join(ids, "wanted", "left").join(own, ["request_id", "wanted"], "left")
    n, found = F.coalesce("n", F.lit(0)), F.coalesce("_own", "_known", F.lit(False))
    rule = F.when(F.col("raw").isNotNull(), "root_uri").when(F.col("wanted").isNotNull(), "project_id").when(n == 1, "visible").when(n > 1, "inferred").otherwise("none")
    project = F.when(rule == "root_uri", F.col("uri")).when((rule == "project_id") & found, F.col("wanted")).when(rule == "visible", F.col("only")).when((rule == "inferred") & (F.col("held") == 1), F.col("inferred"))
    error = F.when((rule == "root_uri") & F.col("uri").isNull(), "invalid_root_uri").when((rule == "project_id") & ~found, "unknown_project").when((rule == "inferred") & ~(F.coalesce("held", F.lit(0)) == 1), "ambiguous_project").when(rule == "none", "project_selection_required")
    return j.select("request_id", project.alias("project"), rule.alias("source"), error.alias("error"))


def project_listing(known: DataFrame, discovered: DataFrame, visible: DataFrame) -> DataFrame:
    """One row a project: the visible one, else the known, else the discovered."""
    tagged = [df.select("project_id", "root", F.lit(k).alias("_k"), F.lit(origin).alias("origin")) for k, (df, origin) in enumerate([(visible, "visible"), (known, "known"), (discovered, "discovered")])]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return rows.groupBy("project_id").agg(F.min(F.struct("_k", "root", "origin")).alias("r")).select("project_id", "r.root", "r.origin")
