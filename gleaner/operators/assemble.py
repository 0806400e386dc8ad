"""Context packs from requests: paths, candidates, ranking, selection, packs (C and P
operators).  Requests are a table (request_id, prompt, changed_files, focus_paths)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import corpus, evidence, extract, lookup, pack, retrieve
from .stage import kept

# Fixed values
#: Characters that a profile leaves of a candidate: of an explicit path's, of others'.
PROFILES = {"lean": (180, 140), "minimal": (220, 180), "compact": (360, 260), "normal": (420, 420), "verbose": (900, 900)}
EARLY_STOP = ("minimal", "compact")
ONE_A_PATH = ("lean", "minimal", "compact")
MAX_PATHS, MAX_OWNERS = 12, 8
PROMPT_PATH = r"(?U)(?<![\w/.-])[\w./-]+\.[A-Za-z0-9]{1,8}(?=\b|:)"


def prompt_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, place, path): changed and focus paths that stay in the root,
    then path-like words of the prompt that exist, each once, 12 at most."""
    given = F.concat(F.coalesce("changed_files", F.array()), F.coalesce("focus_paths", F.array()))
    words = F.regexp_extract_all("prompt", F.lit(PROMPT_PATH), F.lit(0))
    first = requests.select("request_id", F.posexplode(given).alias("place", "path"), F.lit(0).alias("kind")).where((F.col("path") != "") & corpus.is_safe(F.col("path")))
    named = requests.select("request_id", F.posexplode(words).alias("place", "path"), F.lit(1).alias("kind")).where(corpus.is_safe(F.col("path"))).join(files.select("path"), "path", "left_semi").select("request_id", "place", "path", "kind")
    once = first.unionByName(named).groupBy("request_id", "path").agg(F.min(F.struct("kind", "place")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("at"))
    return once.select("request_id", rank.alias("place"), "path").where(F.col("place") <= MAX_PATHS)


def candidate_row(summaries: DataFrame, source: Column, reasons: Column) -> DataFrame:
    """Summaries with ``request_id`` and ``score`` as candidates."""
    score = F.round("score", 4)
    return summaries.select(
        "request_id", "path", "start_line", "end_line", score.alias("score"), pack.confidence(F.col("score")).alias("confidence"), reasons.alias("reason_codes"), source.alias("source"), "title_hint", "content",
        F.length("content").alias("raw_chars"), "source_chars", F.greatest(F.lit(0), F.col("source_chars") - F.length("content")).alias("deferred_chars"), "redactions", "signals",
        F.struct(F.lit("context_lookup").alias("tool"), F.lit("snippet").alias("mode"), "path", "start_line").alias("detail_lookup"))


def explicit_candidates(files: DataFrame, symbols: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of explicit paths by their head summaries, and the paths that
    can't be read.  Only files that a request names are summarised, each once."""
    named = files.join(paths.select("path").distinct(), "path", "left_semi")
    found = paths.select("request_id", "path").join(extract.head_summary(named, symbols), "path").withColumn("score", F.lit(12.0))
    lost = paths.join(files.select("path"), "path", "left_anti").select("request_id", "path", F.lit("unreadable_explicit_path").alias("reason_code"))
    return candidate_row(found, F.lit("explicit_path"), F.array(F.lit("explicit_path"))), lost


def _anchored(files: DataFrame, symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(request_id, path, anchor, ...)`` with summaries made once for each
    (path, anchor), of the files that are wanted only."""
    named = files.join(wanted.select("path").distinct(), "path", "left_semi")
    return wanted.join(extract.anchored_summary(named, wanted, symbols), ["path", "anchor"])


def lexical_hits(files: DataFrame, requests: DataFrame, max_items: int, index=None) -> DataFrame:
    """The merged search of C02: at most four rows an item, eight at least."""
    merged = retrieve.merge_fragments(retrieve.term_fragments(files, retrieve.request_terms(requests), index=index), requests)
    return retrieve.top(merged, max(4 * max_items, 8), "request_id")


def summary_limit(profile: str, max_items: int) -> int | None:
    return max(2 * max_items, 8) if profile in EARLY_STOP else max(3 * max_items, 12) if profile == "normal" else None


def lexical_candidates(files: DataFrame, symbols: DataFrame, hits: DataFrame, profile: str, max_items: int) -> tuple[DataFrame, DataFrame]:
    """Candidates of the best search rows by anchored summaries, score and 4; the
    rows below the profile's limit are one omitted row."""
    limit = summary_limit(profile, max_items)
    kept = hits if limit is None else hits.where(F.col("rank") <= limit)
    found = _anchored(files, symbols, kept.select("request_id", "path", F.col("line").alias("anchor"), (F.col("score") + 4.0).alias("score")))
    over = hits.groupBy("request_id").agg(F.count("*").alias("n")).where(F.lit(False) if limit is None else F.col("n") > limit)
    omitted = over.select("request_id", F.lit(None).cast("string").alias("path"), F.lit("search_summary_limit").alias("reason_code"))
    return candidate_row(found, F.lit("search"), F.array(F.lit("lexical_match"))), omitted


def symbol_candidates(files: DataFrame, symbols: DataFrame, requests: DataFrame, before: DataFrame, profile: str, max_items: int) -> tuple[DataFrame, DataFrame]:
    """Candidates of the first symbols found, score 8, unless the profile stops
    early for a request that has enough candidates and paths before (an omitted row)."""
    skipped = before.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))
    skipped = skipped.where((F.lit(profile in EARLY_STOP)) & (F.col("n") >= 2 * max_items) & (F.col("paths") >= max_items)).select("request_id")
    hits = lookup.first_symbol_hits(symbols, retrieve.request_terms(requests.join(skipped, "request_id", "left_anti")), max(max_items, 2))
    kinds = symbols.groupBy("path", "name", "line_start").agg(F.min("kind").alias("kind"))
    wanted = hits.join(kinds, ["path", "name", "line_start"]).select("request_id", "path", F.greatest(F.lit(1), F.col("line_start")).cast("int").alias("anchor"), F.lit(8.0).alias("score"), "kind")
    found = candidate_row(_anchored(files, symbols, wanted), F.lit("symbol_index"), F.array(F.lit("symbol_match"), F.col("kind")))
    return found, skipped.select("request_id", F.lit(None).cast("string").alias("path"), F.lit("early_stop_enough_ranked_candidates").alias("reason_code"))


def owner_paths(paths: DataFrame, files: DataFrame, n: int = 10) -> DataFrame:
    """(request_id, place, path, confidence): tests that name patterns give for a
    request's (path, place) sources, then tests found by a search for the source's stem,
    each once, ``n`` at most."""
    sources = paths.where(~F.col("path").rlike("^tests?/")).select("request_id", F.col("place").alias("source"), lookup.stem(F.col("path")).alias("stem"))
    named = paths.select("request_id", F.col("place").alias("at0"), "path")
    direct = retrieve.direct_owners(named, files).select("request_id", F.lit(0).alias("kind"), F.col("at0").alias("source"), F.col("pattern").alias("at"), "path")
    tests = files.where(F.col("path").rlike("^tests?/"))
    stems = sources.select(F.col("stem").alias("request_id"), F.col("stem").alias("prompt")).distinct()
    hits = retrieve.search(tests, stems, n)
    scored = retrieve.search_score(retrieve.match_features(hits.select("request_id", "path", "score"), tests, retrieve.request_terms(stems)))
    found = retrieve.top(scored, n, "request_id").select(F.col("request_id").alias("stem"), F.col("rank").alias("at"), "path")
    searched = sources.join(found, "stem").select("request_id", F.lit(1).alias("kind"), "source", "at", "path")
    once = direct.unionByName(searched).groupBy("request_id", "path").agg(F.min(F.struct("kind", "source", "at")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("at", "path"))
    return once.select("request_id", rank.alias("place"), "path", F.when(F.col("at.kind") == 0, "high").otherwise("medium").alias("confidence")).where(F.col("place") <= n)


def owner_candidates(files: DataFrame, symbols: DataFrame, owners: DataFrame, before: DataFrame) -> DataFrame:
    """Candidates of test owners that aren't candidates yet, score 10."""
    new = owners.join(before.select("request_id", "path"), ["request_id", "path"], "left_anti")
    found = _anchored(files, symbols, new.select("request_id", "path", F.lit(1).alias("anchor"), F.lit(10.0).alias("score")))
    return candidate_row(found, F.lit("test_impact"), F.array(F.lit("test_owner")))


def ranked(candidates: DataFrame, requests: DataFrame, paths: DataFrame) -> DataFrame:
    """Scores with the route's bonuses; confidence is the score's 18th."""
    about = requests.select("request_id", T.route(F.col("prompt")).alias("route"), T.query_terms(F.col("prompt")).alias("terms"))
    explicit = paths.groupBy("request_id").agg(F.collect_set("path").alias("explicit"))
    rows = candidates.join(about, "request_id").join(explicit, "request_id", "left")
    in_path = F.exists("terms", lambda t: F.contains(F.lower("path"), t))
    score = pack.route_score(F.col("score"), F.col("path"), F.col("route"), F.coalesce(F.array_contains("explicit", F.col("path")), F.lit(False)), F.array_contains("reason_codes", "test_owner"), in_path)
    return rows.withColumn("score", score).withColumn("confidence", pack.confidence(F.col("score"), 18.0)).select(*candidates.columns, "route")


def profiled(candidates: DataFrame, profile: str) -> DataFrame:
    """Contents cut to the profile's characters, lengths and signals anew."""
    explicit, other = PROFILES[profile]
    most = F.when(F.array_contains("reason_codes", "explicit_path"), explicit).otherwise(other)
    cut = candidates.withColumn("truncated", T.is_trimmed(F.col("content"), most)).withColumn("content", T.trim_text(F.col("content"), most))
    return cut.withColumns({"raw_chars": F.length("content"), "deferred_chars": F.greatest(F.lit(0), F.col("source_chars") - F.length("content")), "signals": T.injection_signals(F.col("content"))})


def candidates(files: DataFrame, symbols: DataFrame, requests: DataFrame, profile: str = "normal", max_items: int = 8, stage=kept, index=None) -> dict[str, DataFrame]:
    """C01-C06 in order: candidates, omitted rows, and the tables that C09 counts; the
    search reads ``index`` if there is one.
    ``stage(df, name)`` keeps what several parts read, so that it is made once."""
    paths = stage(prompt_paths(requests, files), "pack-paths")
    explicit, lost = explicit_candidates(files, symbols, paths)
    hits = stage(lexical_hits(files, requests, max_items, index), "pack-hits")
    lexical, over = lexical_candidates(files, symbols, hits, profile, max_items)
    before = stage(explicit.unionByName(lexical), "pack-first")
    by_symbol, skipped = symbol_candidates(files, symbols, requests, before, profile, max_items)
    with_symbols = stage(before.unionByName(by_symbol), "pack-second")
    owners = stage(owner_paths(paths, files, MAX_OWNERS), "pack-owners")
    rows = with_symbols.unionByName(owner_candidates(files, symbols, owners, with_symbols))
    return {"candidates": stage(ranked(rows, requests, paths), "pack-candidates"), "omitted": lost.unionByName(over).unionByName(skipped), "paths": paths, "hits": hits, "owners": owners, "skipped": skipped}


def plan_stats(made: dict[str, DataFrame], requests: DataFrame, profile: str = "normal", max_items: int = 8) -> DataFrame:
    """One row a request: paths, search rows and limits, summaries of each source,
    owners, and whether the symbol lookup was skipped."""
    limit, n = summary_limit(profile, max_items), F.count("*")
    sources = made["candidates"].groupBy("request_id", "source").agg(n.alias("n")).groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_counts"))
    count = lambda df, name: df.groupBy("request_id").agg(n.alias(name))
    rows = requests.select("request_id")
    for df in (count(made["paths"], "explicit_path_count"), count(made["hits"], "search_result_count"), count(made["owners"], "test_owner_path_count"), count(made["skipped"], "skipped"), sources):
        rows = rows.join(df, "request_id", "left")
    of = lambda source: F.coalesce(F.try_element_at("source_counts", F.lit(source)), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("request_id", zero("explicit_path_count").alias("explicit_path_count"), of("explicit_path").alias("explicit_summary_count"), F.lit(max(4 * max_items, 8)).alias("search_limit"), zero("search_result_count").alias("search_result_count"),
                       zero("search_result_count" if limit is None else F.least("search_result_count", F.lit(limit))).alias("search_summary_limit"), of("search").alias("search_summary_count"), F.lit(max(max_items, 2)).alias("symbol_limit"), of("symbol_index").alias("symbol_summary_count"),
                       (zero("skipped") > 0).alias("symbol_lookup_skipped"), zero("test_owner_path_count").alias("test_owner_path_count"), of("test_impact").alias("test_owner_summary_count"), "source_counts")


def minimal_items(selected: DataFrame) -> DataFrame:
    """An item as path, lines, reason, confidence bucket, content and lookup."""
    return selected.select("request_id", "rank", "path", F.array("start_line", "end_line").alias("lines"), F.col("reason_codes").alias("reason"), corpus.confidence_bucket(F.col("score"), F.col("confidence")).alias("confidence"), "content", "detail_lookup")


def packs(made: dict[str, DataFrame], requests: DataFrame, profile: str = "normal", max_items: int = 8, max_chars: int = 6000, source_tokens: int = 1200) -> DataFrame:
    """C14: one row a request: route, terms, ranked items, omitted rows, counts, tokens.
    Contents are cut to the profile (P08), then chosen within the budget (C07, C08)."""
    budget = max(500, min(max_chars - 500, 4 * source_tokens)) if profile == "minimal" else max(1000, max_chars - 2400)
    rows = profiled(made["candidates"], profile)
    chosen = pack.select_rows(rows, max_items, budget, 1 if profile in ONE_A_PATH else 2)
    picked = F.col("outcome") == "selected"
    item = F.struct("place", "path", "start_line", "end_line", "score", "confidence", "reason_codes", "source", "title_hint", "content", "detail_lookup")
    both = chosen.groupBy("request_id").agg(F.array_sort(F.collect_list(F.when(picked, item))).alias("items"), F.array_sort(F.collect_list(F.when(~picked, F.struct("place", "path", F.col("outcome").alias("reason_code"))))).alias("left"), F.count("*").alias("candidate_count"), F.count_if(picked).alias("selected_count"), evidence.baseline_tokens().alias("baseline_tokens"), F.coalesce(F.sum(F.when(picked, F.col("raw_chars"))), F.lit(0)).alias("selected_chars"))
    early = made["omitted"].groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(F.lit(0).alias("place"), "path", "reason_code"))).alias("early"))
    about = requests.select("request_id", T.route(F.col("prompt")).alias("route"), T.query_terms(F.col("prompt")).alias("terms"), T.digest(F.col("prompt")).alias("prompt_sha256"))
    none = F.array().cast("array<struct<place:int,path:string,reason_code:string>>")
    rows = about.join(both, "request_id", "left").join(early, "request_id", "left")
    return rows.select("request_id", "route", "terms", "prompt_sha256", "items", F.concat(F.coalesce("early", none), F.coalesce("left", none)).alias("omitted"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("selected_count", F.lit(0)).alias("selected_count"), "baseline_tokens", "selected_chars")


def impact(owners: DataFrame, related: DataFrame, n: int) -> DataFrame:
    """(request_id, place, path, relationship): test owners, then related symbols,
    ``n`` a request at most."""
    rows = owners.select("request_id", F.lit(0).alias("k"), F.col("place").alias("at"), "path", F.lit("test_owner").alias("relationship"))
    rows = rows.unionByName(related.select("request_id", F.lit(1).alias("k"), F.col("rank").alias("at"), "path", F.lit("related_symbol").alias("relationship")))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("k", "at"))
    return rows.select("request_id", rank.alias("place"), "path", "relationship").where(F.col("place") <= n)


def manual_baseline(files: DataFrame, focus: DataFrame, hits: DataFrame, most: int = 1200) -> DataFrame:
    """(request_id, reads, tokens) of reading each focus path and search hit once,
    ``most`` characters of each, with its path."""
    reads = focus.select("request_id", "path").unionByName(hits.select("request_id", "path")).distinct()
    text = files.join(reads.select("path").distinct(), "path", "left_semi").select("path", (F.length(T.trim_text(F.col("content"), most)) + F.length("path")).alias("chars"))
    tokens = F.greatest(F.lit(1), F.floor((F.col("chars") + 3) / 4))
    return reads.join(text, "path").groupBy("request_id").agg(F.count("*").alias("reads"), F.sum(tokens).cast("long").alias("tokens"))
