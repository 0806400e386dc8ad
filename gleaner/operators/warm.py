"""What is worth making before it is asked for: hot places, tests of what was selected,
plans and how far they went (U operators), explicit paths' freshness (X15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import assemble, corpus, learn

CHUNK_LINES = 80
#: Sources a pack teaches, and tests kept for a source.
PACK_SOURCES, OWNERS = 2, 4
PRIORITY = ("hot_chunk", "test_owner", "search", "symbol")
TARGET = "struct<line_anchor:int,path:string,source:string>"


def file_token(content: Column) -> Column:
    """What stands for a file's content: 16 digits of its digest."""
    return T.digest(content, 16)


def chunk_id(path: Column, token: Column, anchor: Column) -> Column:
    """The id of the 80-line chunk around a line of a file, by path, token and range."""
    start = (F.floor((F.greatest(F.lit(1), anchor) - 1) / CHUNK_LINES) * CHUNK_LINES + 1).cast("int")
    return F.concat(F.lit("chk_"), T.digest(F.concat_ws(":", path, token, start, start + CHUNK_LINES - 1), 16))


def warm_route(route: Column) -> Column:
    return F.when(route.isin(*learn.WARM_ROUTES), route).otherwise("coding")


def hot_chunks(selections: DataFrame) -> DataFrame:
    """For each (path, anchor, route) of ``selections(seq, path, start_line, route,
    token)``, where token is the file's when it was selected (null: it wasn't there, no
    row): how often, when last, and the token and chunk of the last time."""
    anchor = F.greatest(F.lit(0), F.coalesce("start_line", F.lit(1)))
    rows = selections.where("path <> '' and token is not null").select("seq", "path", anchor.alias("anchor"), warm_route(F.col("route")).alias("route"), "token")
    out = rows.groupBy("path", "anchor", "route").agg(F.count("*").alias("selected_count"), F.max("seq").alias("last_seq"), F.max_by("token", "seq").alias("token"))
    return out.withColumn("chunk_id", chunk_id(F.col("path"), F.col("token"), F.col("anchor")))


def live_hot_targets(hot: DataFrame, files: DataFrame, scope: str, n: int) -> DataFrame:
    """(place, path, anchor, route, source): the most selected places in scope whose
    file still has the content that was selected; a changed file's are gone."""
    now = files.select("path", file_token(F.col("content")).alias("token"))
    live = hot.where(corpus.in_scope(F.col("path"), scope)).join(now, ["path", "token"], "left_semi")
    order = [F.desc("selected_count"), "path", "anchor", "route"]
    best = live.orderBy(*order).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "path", "anchor", "route", F.lit("hot_chunk").alias("source"))  # n rows


def test_owner_targets(selected: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each source of ``selected(pack_id, rank, path, route, seq)``: its
    tests (four at most, by R12), in how many packs it was among the first two sources,
    and the route of the last.  A corpus without a folder of tests gives none."""
    each = selected.where((F.col("path") != "") & ~F.col("path").rlike("^tests?/")).groupBy("pack_id", "path").agg(F.min("rank").alias("rank"), F.max("seq").alias("seq"), F.max_by("route", "seq").alias("route"))
    # ranks are cut in each task before the exchange, so a large pack isn't gathered
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy("pack_id").orderBy("rank", "path"))).where(F.col("_r") <= PACK_SOURCES)
    sources = first.groupBy(F.col("path").alias("source_path")).agg(F.count("*").alias("selected_count"), F.max_by(warm_route(F.col("route")), "seq").alias("route"))
    owners = assemble.owner_paths(sources.select(F.col("source_path").alias("request_id"), F.lit(1).alias("place"), F.col("source_path").alias("path")), files, OWNERS)
    targets = owners.groupBy(F.col("request_id").alias("source_path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path", "confidence"))), lambda x: F.struct(x["path"].alias("path"), x["confidence"].alias("confidence"))).alias("targets"))
    return sources.join(targets, "source_path")


def owner_summary_targets(owners: DataFrame, files: DataFrame, scope: str, n: int) -> DataFrame:
    """(place, path, anchor, source, source_path): the tests of sources in scope that
    still exist, by source and place, ``n`` at most."""
    each = owners.where(corpus.in_scope(F.col("source_path"), scope)).select("source_path", F.posexplode("targets").alias("at", "t")).select("source_path", "at", "t.path")
    best = each.join(files.select("path"), "path", "left_semi").orderBy("source_path", "at").limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy("source_path", "at"))).select("place", "path", F.lit(1).alias("anchor"), F.lit("test_owner").alias("source"), "source_path")  # n rows


def precompute_targets(*lists: DataFrame) -> DataFrame:
    """(place, path, anchor, source): ``lists(place, path, anchor, source)`` in the
    order of their sources' priority and their places, each (path, anchor) once."""
    both = None
    for rows in lists:
        rows = rows.where("path <> ''").select("path", F.greatest(F.lit(0), "anchor").alias("anchor"), "source", "place")
        both = rows if both is None else both.unionByName(rows)
    priority = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source"))
    first = both.groupBy("path", "anchor").agg(F.min(F.struct(priority.alias("priority"), "place", "source")).alias("at"))
    # places over ranges, so that no task holds the whole plan
    order = ["at.priority", "at.place", "path", "anchor"]
    return first.orderBy(*order).select("path", "anchor", "at.source", F.col("at.priority").alias("priority"), F.col("at.place").alias("place"))


def _once(items: Column, same) -> Column:
    """``items`` without those for which ``same`` holds of an earlier one."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, 1, i), lambda y: same(x, y)))


def request_manifest(requests: DataFrame, seeds: DataFrame, limit: int, project_id: str, signature: str) -> DataFrame:
    """What a request leaves for later runs, without its prompt: reusable terms, safe
    paths with their source (changed, then focus, then prompt paths), selected and
    remembered targets, its route's learned seeds, and a key of all but the memory.

    ``requests(request_id, route, terms, changed_files, focus_paths, explicit_paths,
    selected, memo)``: the last two are arrays of (path, start_line) and (path,
    line_anchor, source).  Lists keep their order; the key's JSON has its names sorted.
    """
    def sourced(column: str, source: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda p: F.struct(p.alias("path"), F.lit(source).alias("source")))

    paths = F.concat(sourced("changed_files", "changed_file"), sourced("focus_paths", "focus_path"), sourced("explicit_paths", "prompt_path"))
    good = F.filter(paths, lambda x: x["path"].isNotNull() & (F.trim(x["path"]) != "") & (x["path"] != ".") & corpus.is_safe(x["path"]))
    same = lambda x, y: (x["path"] == y["path"]) & (x["line_anchor"] == y["line_anchor"])
    chosen = F.transform(F.col("selected"), lambda x: F.struct(F.greatest(F.lit(0), F.coalesce(x["start_line"], F.lit(1))).cast("int").alias("line_anchor"), x["path"].alias("path"), F.lit("selected_item").alias("source")))
    usable = lambda xs: F.filter(F.coalesce(xs, F.array().cast(f"array<{TARGET}>")), lambda x: (x["path"] != "") & corpus.is_safe(x["path"]))
    memo = F.transform(F.col("memo"), lambda x: F.struct(x["line_anchor"].alias("line_anchor"), x["path"].alias("path"), x["source"].alias("source")))
    by_route = seeds.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("_seeds"))
    rows = requests.join(by_route, "route", "left").select(
        "request_id", "route", T.reusable_terms(F.col("terms"), limit).alias("prompt_terms"), good.alias("paths"), usable(chosen).alias("selected_targets"), usable(memo).alias("request_memo_targets"),
        T.reusable_terms(F.coalesce("_seeds", F.array().cast("array<string>")), limit).alias("learned_route_seeds"))
    rows = rows.withColumns({
        "paths": F.slice(_once(F.col("paths"), lambda x, y: x["path"] == y["path"]), 1, limit), "selected_targets": F.slice(_once(F.col("selected_targets"), same), 1, limit),
        "request_memo_targets": F.slice(_once(F.col("request_memo_targets"), same), 1, 2 * limit)})
    identity = F.struct("paths", F.lit(project_id).alias("project_id"), "prompt_terms", F.lit(signature).alias("refresh_signature"), "route", "selected_targets")
    return rows.withColumn("dedupe_key", T.digest(F.to_json(identity), 24))


def _labelled(rows: DataFrame, limit: int) -> DataFrame:
    """``rows(request_id, kind, place, target, early, late)`` with an outcome: ``early``
    if there is a reason not to try; else entry_cap after ``limit`` tries of a request
    and kind; else ``late`` if the try gives nothing; else completed."""
    tries = F.sum(F.when(F.col("early").isNull(), 1).otherwise(0)).over(Window.partitionBy("request_id", "kind").orderBy("place"))  # a plan of a request
    outcome = F.coalesce("early", F.when(tries > limit, "entry_cap"), "late", F.lit("completed"))
    return rows.select("request_id", "kind", "place", "target", outcome.alias("outcome"))


def plan_outcomes(manifests: DataFrame, targets: DataFrame, negative: DataFrame, results: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """An outcome for every planned entry of each request, in three kinds.

    Terms (a manifest's own, then its route's seeds): generic_term, duplicate_term,
    negative_term, entry_cap, no_results or completed.  Paths whose tests are looked up
    (the manifest's and its targets'): unavailable_path, entry_cap or completed.
    Summaries (``targets(request_id, place, path, anchor)``, each place once):
    request_memo, unavailable_path, entry_cap or completed.
    """
    terms = manifests.select("request_id", "route", F.posexplode(F.concat("prompt_terms", "learned_route_seeds")).alias("place", "raw")).withColumn("target", F.get(T.query_terms(F.col("raw"), 1), F.lit(0)))
    generic = F.col("target").isNull() | F.col("target").isin(*T.GENERIC_TERMS)
    first = F.row_number().over(Window.partitionBy("request_id", "target").orderBy("place")) == 1
    refused = negative.where("path_scope = '.'").select(F.col("term").alias("target"), "route", F.lit(True).alias("refused")).distinct()
    terms = terms.withColumn("first", first).join(refused, ["target", "route"], "left").join(results.select(F.col("term").alias("target"), "result_count"), "target", "left")
    early = F.when(generic, "generic_term").when(~F.col("first"), "duplicate_term").when(F.col("refused"), "negative_term")
    terms = terms.select("request_id", F.lit("term").alias("kind"), "place", F.coalesce("target", "raw").alias("target"), early.alias("early"), F.when(F.coalesce("result_count", F.lit(0)) <= 0, "no_results").alias("late"))
    names = F.filter(F.array_distinct(F.concat(F.transform("paths", lambda x: x["path"]), F.transform("selected_targets", lambda x: x["path"]))), lambda p: p != "")
    there = files.select(F.col("path").alias("target"), F.lit(True).alias("there"))
    owners = manifests.select("request_id", F.posexplode(names).alias("place", "target")).join(there, "target", "left")
    lost = F.when(F.col("there").isNull(), "unavailable_path")
    owners = owners.select("request_id", F.lit("owner").alias("kind"), "place", "target", lost.alias("early"), F.lit(None).cast("string").alias("late"))
    known = manifests.select("request_id", F.explode("request_memo_targets").alias("m")).select("request_id", F.col("m.path").alias("target"), F.col("m.line_anchor").alias("anchor"), F.lit(True).alias("known")).distinct()
    once = targets.where("path <> ''").groupBy("request_id", F.col("path").alias("target"), F.greatest(F.lit(0), "anchor").alias("anchor")).agg(F.min("place").alias("place"))
    made = once.join(known, ["request_id", "target", "anchor"], "left").join(there, "target", "left")
    made = made.select("request_id", F.lit("summary").alias("kind"), "place", F.concat_ws(":", "target", "anchor").alias("target"), F.when(F.col("known"), "request_memo").otherwise(lost).alias("early"), F.lit(None).cast("string").alias("late"))
    return _labelled(terms.unionByName(owners).unionByName(made), limit)


def summary_targets(manifests: DataFrame, hot: DataFrame, owners: DataFrame) -> DataFrame:
    """(request_id, place, path, anchor) of what a request's run summarises: its
    paths, its selected targets, the hot places, and tests of what was selected before."""
    own = F.concat(F.transform("paths", lambda x: F.struct(x["path"].alias("path"), F.lit(0).alias("anchor"))), F.transform("selected_targets", lambda x: F.struct(x["path"].alias("path"), x["line_anchor"].alias("anchor"))))
    first = manifests.select("request_id", F.posexplode(own).alias("place", "t")).select("request_id", "place", "t.path", "t.anchor")
    common = hot.select((F.col("place") + 1_000_000).alias("place"), "path", "anchor").unionByName(owners.select((F.col("place") + 2_000_000).alias("place"), "path", "anchor"))
    shared = manifests.select("request_id").crossJoin(F.broadcast(common))  # at most ``limit`` of each, for every request
    return first.unionByName(shared)


def coverage(outcomes: DataFrame) -> DataFrame:
    """Planned, completed, skipped, the ratio and the skips by reason of each request."""
    per = outcomes.groupBy("request_id", "outcome").agg(F.count("*").alias("n"))
    done = F.col("outcome") == "completed"
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = per.groupBy("request_id").agg(F.sum("n").alias("planned"), zero(F.sum(F.when(done, F.col("n")))).alias("completed"), zero(F.sum(F.when(~done, F.col("n")))).alias("skipped"), F.array_sort(F.collect_list(F.when(~done, F.struct("outcome", "n")))).alias("r"))
    return rows.select("request_id", "planned", "completed", "skipped", F.round(F.col("completed") / F.col("planned"), 4).alias("ratio"), F.map_from_entries("r").alias("skip_reasons"))


def explicit_freshness(paths: DataFrame, listing: DataFrame, indexed: DataFrame, whole_current: bool = False, force: bool = False) -> DataFrame:
    """Outcome and reason for each of ``paths(request_id, path)``: skipped if the
    index has the file as it is listed (a folder: any file below it, and the whole corpus
    is known to be current), refreshed if it is there and isn't so, else failed.

    ``listing`` and ``indexed`` have (path, size, mtime_ns).  A folder is what lies above
    a listed path.
    """
    parents = lambda df, name: df.select(F.split("path", "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda n: F.when(F.size("p") > 1, F.array_join(F.slice("p", 1, n), "/")))).alias("path")).where("path is not null").distinct().withColumn(name, F.lit(True))
    asked = paths.select("path").distinct()
    now = listing.select("path", F.col("size").alias("s1"), F.col("mtime_ns").alias("m1"))
    then = indexed.select("path", F.col("size").alias("s0"), F.col("mtime_ns").alias("m0"))
    j = asked.join(now, "path", "left").join(then, "path", "left").join(parents(listing, "folder"), "path", "left").join(parents(indexed, "folder_indexed"), "path", "left")
    safe, there, folder = corpus.is_safe(F.col("path")), F.col("s1").isNotNull(), F.col("folder").isNotNull() & F.col("s1").isNull()
    same = there & ~corpus.excluded(F.col("path")) & (F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1"))
    current = F.coalesce(same | (folder & F.col("folder_indexed") & F.lit(whole_current)), F.lit(False)) & F.lit(not force)
    outcome = F.when(~safe, "failed").when(current, "skipped").when(there | folder, "refreshed").otherwise("failed")
    reason = F.when(~safe, "unsafe_path").when(current, "signature_unchanged_path_current" if whole_current else "indexed_path_current").when(there | folder, "forced" if force else "scoped_refresh").otherwise("missing_path")
    return paths.join(j.select("path", outcome.alias("outcome"), reason.alias("reason")), "path").select("request_id", "path", "outcome", "reason")


def freshness_counts(rows: DataFrame) -> DataFrame:
    """Paths, refreshed, skipped and failed of each request."""
    return rows.groupBy("request_id").agg(F.count("*").alias("path_count"), *[F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in ("refreshed", "skipped", "failed")])


# Facets in the order in which they are looked at, and what is said of the first that no entry has
FACETS = (
    ("refresh_signature", "index_changed"), ("explicit_paths", "path_changed"), ("path", "path_changed"), ("cache_token", "changed_chunk_digest"), ("chunk_id", "changed_chunk_digest"), ("include_globs", "path_changed"),
    ("terms_key", "terms_changed"), ("term", "terms_changed"), ("allow_fallback", "fallback_policy_changed"), ("backend_version", "backend_changed"), ("pool_size", "limit_bucket_changed"),
)


def _facets(df: DataFrame) -> Column:
    """(facet, value) of what a row states, values as text; empty texts state nothing."""
    text = {c: F.to_json(c) if t.startswith("array") else F.col(c).cast("string") for c, t in df.dtypes}
    text = {name: text.get(name, F.lit(None).cast("string")) for name, _ in FACETS}
    return F.filter(F.array(*[F.struct(F.lit(k).alias("facet"), text[name].alias("value")) for k, (name, _) in enumerate(FACETS)]), lambda x: F.coalesce(x["value"], F.lit("")) != "")


def miss_reasons(misses: DataFrame, entries: DataFrame) -> DataFrame:
    """(miss_id, reason): why each of ``misses`` found nothing, by the first facet
    that no entry of its namespace has.  Facets after the signature look at the entries
    with the miss's signature alone (at all, if it asks for none).

    Both sides have a namespace, a schema_version, a refresh_signature and any columns of
    ``FACETS``; null and empty values of a miss ask for nothing.  Entries meet misses as different (namespace,
    signature, facet, value), so neither is multiplied.
    """
    held = entries.where("namespace is not null").select("namespace", F.coalesce("refresh_signature", F.lit("")).alias("own"), _facets(entries).alias("f"))
    held = held.select("namespace", F.array_distinct(F.array("own", F.lit(""))).alias("signatures"), F.explode("f").alias("x")).select("namespace", F.explode("signatures").alias("signature"), "x.facet", "x.value").distinct()
    tops = entries.where("namespace is not null").groupBy("namespace").agg(F.max(F.coalesce("schema_version", F.lit(0))).alias("top"))
    # the signature itself is looked for among all entries
    asked = misses.select("miss_id", "namespace", F.coalesce("refresh_signature", F.lit("")).alias("own"), F.explode(_facets(misses)).alias("x"))
    asked = asked.select("miss_id", "namespace", F.when(F.col("x.facet") == 0, "").otherwise(F.col("own")).alias("signature"), "x.facet", "x.value")
    failed = asked.join(held, ["namespace", "signature", "facet", "value"], "left_anti").groupBy("miss_id").agg(F.min("facet").alias("facet"))
    label = F.get(F.array(*[F.lit(r) for _, r in FACETS]), F.col("facet"))
    rows = misses.select("miss_id", "namespace", F.coalesce("schema_version", F.lit(0)).alias("wanted")).join(tops, "namespace", "left").join(failed, "miss_id", "left")
    reason = F.when(F.col("top").isNull(), "no_compatible_entry").when((F.col("wanted") > 0) & (F.col("top") < F.col("wanted")), "schema_version_changed").otherwise(F.coalesce(label, F.lit("no_compatible_entry")))
    return rows.select("miss_id", reason.alias("reason"))


def benchmark_runs(runs: DataFrame) -> DataFrame:
    """Runs of packs with the tokens each spared against searching and reading by hand."""
    return runs.withColumn("tokens_spared", F.greatest(F.lit(0), F.col("manual_tokens") - F.col("output_tokens")))


def benchmark_values(runs: DataFrame, contract_tokens_saved: int) -> DataFrame:
    """(key, value, samples) of one benchmark's runs, as A11's targets read them.  Runs have
    name, elapsed_ms, stage_timings (a map), candidates, selected, fragment_hits,
    fragment_misses, manual_tokens, output_tokens, calls_saved and bytes_deferred."""
    each = benchmark_runs(runs)
    ratio = lambda a, b, n: F.coalesce(F.round(F.try_divide(a, b), n), F.lit(0.0))
    s = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,6)"))
    n = F.count("*")
    stage = lambda name: F.round(F.sum(F.coalesce(F.try_element_at("stage_timings", F.lit(name)), F.lit(0.0)).cast("decimal(20,6)")) / n, 3)
    values = {
        "latency.context_pack.avg_elapsed_ms": (ratio(s("elapsed_ms"), n, 3), n), "latency.context_pack.p95_recent_ms": (F.round(F.percentile("elapsed_ms", F.lit(0.95)), 3), n),
        "latency.context_pack.index_refresh_avg_ms": (stage("index_refresh"), n), "latency.context_pack.snippet_batch_avg_ms": (stage("snippet_batch"), n), "latency.context_admin.warmup.avg_elapsed_ms": (F.lit(0.0), F.lit(0)),
        "tokens.context_pack.avg_saved_per_pack": (ratio(s("tokens_spared"), n, 3), n), "tokens.context_pack.avg_candidate_compression_per_pack": (ratio(s("tokens_spared"), n, 3), n), "tokens.context_pack.compression_ratio": (ratio(s("output_tokens"), s("manual_tokens"), 4), n),
        "retrieval.context_pack.candidates_per_selected": (ratio(s("candidates"), s("selected"), 3), n), "cache.context_pack_fragment_hit_ratio": (ratio(s("fragment_hits"), s("fragment_hits") + s("fragment_misses"), 4), s("fragment_hits") + s("fragment_misses")),
        "tooling.external_calls_saved_per_pack": (ratio(s("calls_saved"), n, 3), n), "tooling.contract_tokens_saved_est": (F.lit(float(contract_tokens_saved)), F.lit(1)), "references.bytes_deferred_est": (s("bytes_deferred").cast("double"), n),
    }
    # a benchmark has a few runs: one row, then one for each value
    row = each.agg(*[F.struct(v.cast("double").alias("value"), c.cast("long").alias("samples")).alias(f"v{k}") for k, (v, c) in enumerate(values.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(key).alias("key"), F.col(f"v{k}.value").alias("value"), F.col(f"v{k}.samples").alias("samples")) for k, key in enumerate(values)])).alias("x")).select("x.*")
