"""Queries of what is made before it is asked for (U), explicit paths (X15), miss reasons
(K05) and benchmark snapshots (A15), with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble, learn, metrics, retrieve, warm
from ..sources import derived as D
from ..sources.derived import with_tables
from .packs import _BASE, _owners
from .registry import _KPIS, _RS, _RT, ORACLE, _index, _list, _terms, add

# Selections by packs: a file's token is that of its text, of a text it had before, or null where it wasn't there.
_PICKED = """doc_id * 10 + j as seq, path, cast(doc_id * j % 200 as int) as start_line, doc_id {div} 3 as pack_id, cast(doc_id % 3 * 10 + j as int) as rank, case (doc_id + j) % 5 when 0 then 'coding' when 1 then 'review' when 2 then 'other' when 3 then 'docs' else '' end as route,
    case when doc_id % 17 = 0 then null when doc_id % 6 = 0 then 'before' else {token} end as token"""
_PICKED_SQL = "SELECT " + _PICKED.format(div="//", token="left(sha256(content), 16)") + " FROM (SELECT doc_id, path, content, unnest(range(0, doc_id % 4 + 1)) AS j FROM files0)"
_ROUTES = _list(learn.WARM_ROUTES)
_HOT = {
    "files0": D.SQL["files"], "picked": _PICKED_SQL,
    "hot0": f"SELECT path, greatest(0, start_line) AS anchor, CASE WHEN list_contains({_ROUTES}, route) THEN route ELSE 'coding' END AS route, seq, token FROM picked WHERE token IS NOT NULL",
    "hot": "SELECT path, anchor, route, count(*) AS selected_count, max(seq) AS last_seq, arg_max(token, seq) AS token FROM hot0 GROUP BY ALL",
    "live": "SELECT h.*, row_number() OVER (ORDER BY selected_count DESC, h.path, anchor, route) AS place FROM hot h JOIN files0 f ON h.path = f.path AND h.token = left(sha256(f.content), 16) WHERE starts_with(h.path, 'en/') QUALIFY place <= 40",
}
_TAUGHT = {
    "pp": "SELECT path AS request_id, 1 AS place, path FROM srcs",
    "first": "SELECT * FROM (SELECT pack_id, path, min(rank) AS rank, max(seq) AS seq, arg_max(route, seq) AS route FROM picked GROUP BY pack_id, path) QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY rank, path) <= 2",
    "srcs": f"SELECT path, count(*) AS selected_count, arg_max(CASE WHEN list_contains({_ROUTES}, route) THEN route ELSE 'coding' END, seq) AS route FROM first GROUP BY 1",
}


def _taught_sql():
    made = _HOT | {"files": _BASE["files"], "filelines": _BASE["filelines"]}
    return made | {k: _TAUGHT[k] for k in ("first", "srcs", "pp")} | _owners(4) | {
        "expanded": "SELECT o.request_id AS source_path, o.path, row_number() OVER (ORDER BY o.request_id, o.place) AS place FROM ow o WHERE starts_with(o.request_id, 'fr/') QUALIFY row_number() OVER (ORDER BY o.request_id, o.place) <= 40"}


def _picked(s, d):
    each = D.files(s, d).withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))))
    return each.selectExpr(*[c.strip() for c in _split(_PICKED.format(div="div", token="substring(sha2(content, 256), 1, 16)"))])


def _split(text: str) -> list[str]:
    """The columns of a select list: commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return out


@add("u06_hot_chunks", with_tables(ctes=_HOT, query="SELECT path, anchor, route, selected_count, last_seq, token, 'chk_' || left(sha256(concat_ws(':', path, token, (greatest(1, anchor) - 1) // 80 * 80 + 1, (greatest(1, anchor) - 1) // 80 * 80 + 80)), 16) AS chunk_id FROM hot"))
def _(s, d):
    return warm.hot_chunks(_picked(s, d))


@add("u07_live_hot_targets", with_tables(ctes=_HOT, query="SELECT place, path, anchor, route, 'hot_chunk' AS source FROM live"))
def _(s, d):
    return warm.live_hot_targets(warm.hot_chunks(_picked(s, d)), D.files(s, d), "en", 40)


@add("u08_test_owner_targets", with_tables(ctes=_taught_sql(), query="SELECT s.path AS source_path, s.selected_count, s.route, string_agg(o.path || ' ' || o.confidence, '; ' ORDER BY o.place) AS targets FROM srcs s JOIN ow o ON o.request_id = s.path GROUP BY ALL"))
def _(s, d):
    rows = warm.test_owner_targets(_picked(s, d), D.pack_files(s, d))
    return rows.select("source_path", "selected_count", "route", F.array_join(F.transform("targets", lambda x: F.concat(x["path"], F.lit(" "), x["confidence"])), "; ").alias("targets"))


@add("u08_owner_summaries", with_tables(ctes=_taught_sql(), query="SELECT place, path, 1 AS anchor, source_path FROM expanded"))
def _(s, d):
    files = D.pack_files(s, d)
    return warm.owner_summary_targets(warm.test_owner_targets(_picked(s, d), files), files, "fr", 40).drop("source")


@add("u09_precompute_targets", with_tables(ctes=_taught_sql() | {
    "flag": ORACLE["flagship_search"],
    "four": "SELECT 1 AS k, place, path, anchor FROM live UNION ALL SELECT 2, place, path, 1 FROM expanded UNION ALL SELECT 3, request_id * 10 + rank, path, rank FROM flag UNION ALL SELECT 4, doc_id, path, doc_id % 7 FROM files0 WHERE doc_id % 5 = 0",
}, query="SELECT path, anchor, (['hot_chunk', 'test_owner', 'search', 'symbol'])[k] AS source, place FROM four QUALIFY row_number() OVER (PARTITION BY path, anchor ORDER BY k, place) = 1"))
def _(s, d):
    files = D.pack_files(s, d)
    hot = warm.live_hot_targets(warm.hot_chunks(_picked(s, d)), D.files(s, d), "en", 40)
    owners = warm.owner_summary_targets(warm.test_owner_targets(_picked(s, d), files), files, "fr", 40)
    hits = retrieve.search(D.files(s, d), D.requests(s, d), index=_index(s, d)).select((F.col("request_id") * 10 + F.col("rank")).alias("place"), "path", F.col("rank").alias("anchor"), F.lit("search").alias("source"))
    symbols = D.files(s, d).where("doc_id % 5 = 0").select(F.col("doc_id").alias("place"), "path", (F.col("doc_id") % 7).alias("anchor"), F.lit("symbol").alias("source"))
    return warm.precompute_targets(hot, owners, hits, symbols).select("path", "anchor", "source", "place")


# Requests with their paths, selections and memory, and what they leave for later runs.
LIMIT = 6
_FIRST = "list_filter({0}, lambda x, i: len(list_filter(({0})[1:i - 1], lambda y: {1})) = 0)"
_SAFE_PATHS = "list_filter(list_concat([{'path': p1, 'source': 'changed_file'}, {'path': '', 'source': 'changed_file'}, {'path': '.', 'source': 'focus_path'}, {'path': p1, 'source': 'focus_path'}, {'path': '../out.txt', 'source': 'focus_path'}, {'path': 'docs/none.md', 'source': 'focus_path'}], list_transform(explicit, lambda p: {'path': p, 'source': 'prompt_path'})), lambda x: x.path NOT IN ('', '.') AND NOT starts_with(x.path, '../'))"
_GENERIC = _list(T.GENERIC_TERMS)
_MANIFEST = _BASE | {
    "flag": ORACLE["flagship_search"], "seeds": ORACLE["u04_route_seeds"],
    "routed": f"SELECT request_id, p1, {_terms('prompt', 24)} AS terms, {_RT} AS ts FROM asked a",
    "about": f"SELECT request_id, p1, terms, CASE WHEN request_id % 2 = 0 THEN {_RS} WHEN request_id % 3 = 0 THEN 'coding' ELSE 'test' END AS route FROM routed",
    "chose": "SELECT request_id, list({'line_anchor': (rank * 3 - 3)::INT, 'path': path, 'source': 'selected_item'} ORDER BY rank) AS sel, list({'line_anchor': rank::INT, 'path': path, 'source': 'search'} ORDER BY rank) FILTER (rank >= 4) AS memo FROM flag GROUP BY 1",
    "named": "SELECT request_id, list(path ORDER BY place) AS explicit FROM pp GROUP BY 1",
    "taught": "SELECT route, list(term ORDER BY rank) AS lt FROM (SELECT route, term, min(rank) AS rank FROM seeds GROUP BY route, term) GROUP BY 1",
    "raw": f"SELECT a.request_id, a.route, (list_filter(terms, lambda t: NOT list_contains({_GENERIC}, t)))[1:{LIMIT}] AS prompt_terms, {_SAFE_PATHS} AS ps, coalesce(sel, []) AS sel, coalesce(memo, []) AS memo, (list_filter(coalesce(lt, []), lambda t: NOT list_contains({_GENERIC}, t)))[1:{LIMIT}] AS learned FROM about a LEFT JOIN named USING (request_id) LEFT JOIN chose USING (request_id) LEFT JOIN taught ON taught.route = a.route",
    "manifest": f"SELECT request_id, route, prompt_terms, ({_FIRST.format('ps', 'y.path = x.path')})[1:{LIMIT}] AS paths, sel[1:{LIMIT}] AS selected_targets, memo[1:{2 * LIMIT}] AS request_memo_targets, learned AS learned_route_seeds FROM raw",
}


def _manifests(s, d):
    files, asked = D.pack_files(s, d), D.pack_requests(s, d)
    hits = retrieve.search(D.files(s, d), D.requests(s, d), index=_index(s, d))
    chosen = hits.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("h")).select(
        "request_id", F.transform("h", lambda x: F.struct(x["path"].alias("path"), (x["rank"] * 3 - 3).cast("int").alias("start_line"))).alias("selected"),
        F.transform(F.filter("h", lambda x: x["rank"] >= 4), lambda x: F.struct(x["rank"].cast("int").alias("line_anchor"), x["path"].alias("path"), F.lit("search").alias("source"))).alias("memo"))
    named = assemble.prompt_paths(asked, files).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("explicit_paths"))
    rows = asked.select("request_id", F.when(F.col("request_id") % 2 == 0, T.route(F.col("prompt"))).when(F.col("request_id") % 3 == 0, "coding").otherwise("test").alias("route"), T.query_terms(F.col("prompt"), 24).alias("terms"), "changed_files", F.concat(F.array(F.lit(".")), "focus_paths").alias("focus_paths"))
    rows = rows.join(named, "request_id", "left").join(chosen, "request_id", "left").withColumn("selected", F.coalesce("selected", F.array().cast("array<struct<path:string,start_line:int>>")))
    return warm.request_manifest(rows, learn.route_seeds(D.usage_log(s, d), "src"), LIMIT, "p0", "sig1")


@add("u11_request_manifest", with_tables(ctes=_MANIFEST, query="SELECT request_id, route, array_to_string(prompt_terms, ' ') AS prompt_terms, to_json(paths)::VARCHAR AS paths, to_json(selected_targets)::VARCHAR AS selected_targets, to_json(request_memo_targets)::VARCHAR AS request_memo_targets, array_to_string(learned_route_seeds, ' ') AS learned_route_seeds, left(sha256(to_json({'paths': paths, 'project_id': 'p0', 'prompt_terms': prompt_terms, 'refresh_signature': 'sig1', 'route': route, 'selected_targets': selected_targets})::VARCHAR), 24) AS dedupe_key FROM manifest"))
def _(s, d):
    rows = _manifests(s, d)
    return rows.select("request_id", "route", *[F.array_join(c, " ").alias(c) for c in ("prompt_terms", "learned_route_seeds")], *[F.to_json(c).alias(c) for c in ("paths", "selected_targets", "request_memo_targets")], "dedupe_key")


# Plans: the manifests' entries with some that must be skipped.
_PLAN = _MANIFEST | {k: v for k, v in _HOT.items() if k != "files0"} | {
    "m": "SELECT request_id, route, list_concat(prompt_terms, ['Fix', upper(prompt_terms[1]), 'x'], learned_route_seeds) AS raw_terms, paths, selected_targets, request_memo_targets FROM manifest",
    "refusals": "SELECT DISTINCT prompt_terms[2] AS term, route FROM manifest WHERE request_id % 5 = 0 AND prompt_terms[2] IS NOT NULL",
    "corpus": "SELECT DISTINCT term FROM (SELECT unnest(list_filter(regexp_extract_all(lower(content), '[a-z0-9_]{3,}'), lambda t: NOT regexp_matches(t, '^[0-9]+$'))) AS term FROM files0)",
    "t0": f"SELECT request_id, route, unnest(raw_terms) AS word, generate_subscripts(raw_terms, 1) AS place FROM m",
    "t1": "SELECT *, (list_filter(regexp_extract_all(lower(word), '[a-z0-9_]{3,}'), lambda t: NOT regexp_matches(t, '^[0-9]+$')))[1] AS target FROM t0",
    "t2": f"SELECT request_id, 'term' AS kind, place, coalesce(target, word) AS target, CASE WHEN target IS NULL OR list_contains({_GENERIC}, target) THEN 'generic_term' WHEN row_number() OVER (PARTITION BY request_id, target ORDER BY place) > 1 THEN 'duplicate_term' WHEN (target, route) IN (SELECT (term, route) FROM refusals) THEN 'negative_term' END AS early, CASE WHEN target NOT IN (SELECT term FROM corpus) THEN 'no_results' END AS late FROM t1",
    "n0": "SELECT request_id, list_concat(list_transform(paths, lambda x: x.path), list_transform(selected_targets, lambda x: x.path)) AS ns FROM m",
    "n1": "SELECT request_id, unnest(ns) AS target, generate_subscripts(ns, 1) AS place FROM n0",
    "n2": "SELECT request_id, 'owner' AS kind, min(place) AS place, target, CASE WHEN target NOT IN (SELECT path FROM files) THEN 'unavailable_path' END AS early, NULL AS late FROM n1 GROUP BY request_id, target",
    "s0": "SELECT request_id, list_concat(list_transform(paths, lambda x: {'path': x.path, 'anchor': 0}), list_transform(selected_targets, lambda x: {'path': x.path, 'anchor': x.line_anchor})) AS xs FROM m",
    "s1": "SELECT request_id, unnest(xs).path AS path, unnest(xs).anchor AS anchor, generate_subscripts(xs, 1) AS place FROM s0 UNION ALL SELECT m.request_id, l.path, l.anchor, 1000000 + l.place FROM m, live l WHERE l.place <= 6",
    "memos": "SELECT request_id, unnest(request_memo_targets).path AS path, unnest(request_memo_targets).line_anchor AS anchor FROM m",
    "s2": "SELECT request_id, 'summary' AS kind, min(place) AS place, path || ':' || anchor AS target, CASE WHEN (request_id, path, anchor) IN (SELECT (request_id, path, anchor) FROM memos) THEN 'request_memo' WHEN path NOT IN (SELECT path FROM files) THEN 'unavailable_path' END AS early, NULL AS late FROM s1 GROUP BY request_id, path, anchor",
    "lab": f"SELECT *, coalesce(early, CASE WHEN count(*) FILTER (early IS NULL) OVER (PARTITION BY request_id, kind ORDER BY place) > {LIMIT} THEN 'entry_cap' END, late, 'completed') AS outcome FROM (SELECT * FROM t2 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM s2)",
}


def _outcomes(s, d):
    made = _manifests(s, d)
    refusals = made.where("request_id % 5 = 0").select(F.get("prompt_terms", F.lit(1)).alias("term"), "route", F.lit(".").alias("path_scope")).where("term is not null")
    plan = made.withColumn("prompt_terms", F.concat("prompt_terms", F.array(F.lit("Fix"), F.upper(F.get("prompt_terms", F.lit(0))), F.lit("x"))))
    hot = warm.live_hot_targets(warm.hot_chunks(_picked(s, d)), D.files(s, d), "en", LIMIT)
    results = _index(s, d).terms.select("term", F.least(F.col("df"), F.lit(40)).alias("result_count"))
    none = hot.select("place", "path", "anchor").limit(0)
    return warm.plan_outcomes(plan, warm.summary_targets(plan, hot, none), refusals, results, D.pack_files(s, d), LIMIT)


@add("u10_plan_outcomes", with_tables(ctes=_PLAN, query="SELECT request_id, kind, target, outcome, count(*) AS n FROM lab GROUP BY ALL"))
def _(s, d):
    return _outcomes(s, d).groupBy("request_id", "kind", "target", "outcome").agg(F.count("*").alias("n"))


@add("u10_plan_coverage", with_tables(ctes=_PLAN | {"r": "SELECT request_id, outcome, count(*) AS n FROM lab GROUP BY ALL"}, query="SELECT request_id, sum(n)::BIGINT AS planned, coalesce(sum(n) FILTER (outcome = 'completed'), 0)::BIGINT AS completed, coalesce(sum(n) FILTER (outcome <> 'completed'), 0)::BIGINT AS skipped, round(coalesce(sum(n) FILTER (outcome = 'completed'), 0) / sum(n), 4)::DOUBLE AS ratio, string_agg(outcome || '=' || n, ' ' ORDER BY outcome) FILTER (outcome <> 'completed') AS skip_reasons FROM r GROUP BY 1"))
def _(s, d):
    rows = warm.coverage(_outcomes(s, d))
    text = F.array_join(F.transform(F.map_entries("skip_reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), " ")
    return rows.withColumn("skip_reasons", text)


# Explicit paths: files as listed now and as indexed before, folders, missing, unsafe and excluded ones.
_ASKED = "case doc_id % 12 when 0 then '../' || path when 1 then 'gone/' || doc_id when 2 then split_part(path, '/', 1) when 3 then split_part(path, '/', 1) || '/' || split_part(path, '/', 2) when 4 then 'build/' || doc_id else path end"
_FRESH = {
    "asked_paths": f"SELECT doc_id % 40 AS request_id, {_ASKED} AS path FROM files",
    "l": "SELECT path, size, mtime_ns FROM next_listing UNION ALL SELECT 'build/' || doc_id, 1, 1 FROM files WHERE doc_id % 12 = 4", "i": "SELECT path, size, mtime_ns FROM files UNION ALL SELECT 'build/' || doc_id, 1, 1 FROM files WHERE doc_id % 12 = 4",
    "x": "SELECT a.request_id, a.path, starts_with(a.path, '../') AS bad, l.path IS NOT NULL AS there, EXISTS (SELECT 1 FROM l y WHERE starts_with(y.path, a.path || '/')) AS folder, EXISTS (SELECT 1 FROM i y WHERE starts_with(y.path, a.path || '/')) AS known, l.size = i.size AND l.mtime_ns = i.mtime_ns AND NOT starts_with(a.path, 'build/') AS same FROM asked_paths a LEFT JOIN l ON l.path = a.path LEFT JOIN i ON i.path = a.path",
    "y": "SELECT request_id, path, CASE WHEN bad THEN 'failed' WHEN same OR (folder AND NOT there AND known AND {0}) THEN 'skipped' WHEN there OR folder THEN 'refreshed' ELSE 'failed' END AS outcome, CASE WHEN bad THEN 'unsafe_path' WHEN same OR (folder AND NOT there AND known AND {0}) THEN '{1}' WHEN there OR folder THEN 'scoped_refresh' ELSE 'missing_path' END AS reason FROM x",
}


def _fresh_sql(whole: bool, query: str) -> str:
    fill = lambda q: q.replace("{0}", str(whole)).replace("{1}", "signature_unchanged_path_current" if whole else "indexed_path_current")
    return with_tables("next_listing", ctes={k: fill(q) for k, q in _FRESH.items()}, query=query)


def _fresh(s, d, whole):
    f = D.files(s, d)
    more = f.where("doc_id % 12 = 4").selectExpr("'build/' || doc_id as path", "1L as size", "1L as mtime_ns")
    cols = ("path", "size", "mtime_ns")
    return warm.explicit_freshness(f.selectExpr("doc_id % 40 as request_id", f"{_ASKED} as path"), D.next_listing(s, d).select(*cols).unionByName(more), f.select(*cols).unionByName(more), whole)


@add("x15_explicit_freshness", _fresh_sql(False, "SELECT request_id, path, outcome, reason FROM y"))
def _(s, d):
    return _fresh(s, d, False)


@add("x15_freshness_counts", _fresh_sql(True, "SELECT request_id, count(*) AS path_count, count(*) FILTER (outcome = 'refreshed') AS refreshed_count, count(*) FILTER (outcome = 'skipped') AS skipped_count, count(*) FILTER (outcome = 'failed') AS failed_count FROM y GROUP BY 1"))
def _(s, d):
    return warm.freshness_counts(_fresh(s, d, True))


# Misses and entries with every facet.
_HELD = ("case when doc_id % 11 <> 0 then 'ns' || doc_id % 4 end as namespace", "cast(doc_id % 3 as int) as schema_version", "'sig' || doc_id % 5 as refresh_signature", "{0}('p' || doc_id % 6, 'q'{1} as explicit_paths", "'p' || doc_id % 7 as path", "'t' || doc_id % 9 as cache_token",
         "'c' || doc_id % 8 as chunk_id", "{0}('*.' || doc_id % 5{1} as include_globs", "'k' || doc_id % 10 as terms_key", "'w' || doc_id % 13 as term", "case when doc_id % 3 > 0 then doc_id % 5 = 0 and doc_id % 4 = 1 end as allow_fallback", "'b' || doc_id % 4 as backend_version", "cast(doc_id % 3 * 10 as int) as pool_size")
_WANTS = "doc_id % 13 = {k} or doc_id % 7 = {k} % 7"
_MISSED = ("doc_id as miss_id", "'ns' || doc_id % 5 as namespace", "cast(case when doc_id % 13 = 1 then doc_id % 5 else 0 end as int) as schema_version", "case when doc_id % 3 > 0 then 'sig' || doc_id % 6 end as refresh_signature") + tuple(
    f"case when {_WANTS.format(k=k)} then {v} end as {n}" for k, (n, v) in enumerate((("explicit_paths", "{0}('p' || doc_id % 8, 'q'{1}"), ("path", "'p' || doc_id % 9"), ("cache_token", "'t' || doc_id % 20"), ("chunk_id", "'c' || doc_id % 19"), ("include_globs", "{0}('*.' || doc_id % 8{1}"), ("terms_key", "'k' || doc_id % 21"), ("term", "'w' || doc_id % 26"), ("allow_fallback", "doc_id % 2 = 0"), ("backend_version", "'b' || doc_id % 9"), ("pool_size", "cast(doc_id % 7 * 10 as int)")), 2))
_spark = lambda cols: [c.replace("{0}", "array").replace("{1}", ")") for c in cols]
_duck = lambda cols: ", ".join(c.replace("{0}(", "[").replace("{1}", "]") for c in cols)
_MATCH = lambda name: f"NOT EXISTS (SELECT 1 FROM e WHERE e.namespace = m.namespace AND (coalesce(m.refresh_signature, '') = '' OR e.refresh_signature = m.refresh_signature) AND e.{name} = m.{name})"


@add("k05_miss_reason", with_tables(ctes={"e": f"SELECT {_duck(_HELD)} FROM documents", "m": f"SELECT {_duck(_MISSED)} FROM documents"}, query="SELECT miss_id, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.namespace = m.namespace) THEN 'no_compatible_entry' WHEN schema_version > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.namespace = m.namespace AND e.schema_version >= m.schema_version) THEN 'schema_version_changed' WHEN refresh_signature IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.namespace = m.namespace AND e.refresh_signature = m.refresh_signature) THEN 'index_changed' " + " ".join(f"WHEN {n} IS NOT NULL AND {_MATCH(n)} THEN '{r}'" for n, r in warm.FACETS[1:]) + " ELSE 'no_compatible_entry' END AS reason FROM m"))
def _(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return warm.miss_reasons(docs.selectExpr(*_spark(_MISSED)), docs.selectExpr(*_spark(_HELD)))


_RUNS = "elapsed_ms, candidates, selected, results AS fragment_hits, omitted AS fragment_misses, baseline_tokens AS manual_tokens, output_tokens, calls_saved, deferred_bytes AS bytes_deferred"
_VALUES = {"r": f"SELECT {_RUNS}, greatest(0, baseline_tokens - output_tokens) AS spared FROM event_log", "v": " UNION ALL ".join(f"SELECT '{k}' AS key, ({v})::DOUBLE AS value, ({n})::BIGINT AS n FROM r" for k, v, n in (
    ("latency.context_pack.avg_elapsed_ms", "round(sum(elapsed_ms::DECIMAL(20,6)) / count(*), 3)", "count(*)"), ("latency.context_pack.p95_recent_ms", "round(quantile_cont(elapsed_ms, 0.95), 3)", "count(*)"), ("latency.context_pack.index_refresh_avg_ms", "round(sum((candidates / 4)::DECIMAL(20,6)) / count(*), 3)", "count(*)"),
    ("latency.context_pack.snippet_batch_avg_ms", "max(0)", "count(*)"), ("latency.context_admin.warmup.avg_elapsed_ms", "max(0)", "max(0)"), ("tokens.context_pack.avg_saved_per_pack", "round(sum(spared) / count(*), 3)", "count(*)"), ("tokens.context_pack.avg_candidate_compression_per_pack", "round(sum(spared) / count(*), 3)", "count(*)"),
    ("tokens.context_pack.compression_ratio", "round(sum(output_tokens) / sum(manual_tokens), 4)", "count(*)"), ("retrieval.context_pack.candidates_per_selected", "round(sum(candidates) / sum(selected), 3)", "count(*)"), ("cache.context_pack_fragment_hit_ratio", "round(sum(fragment_hits) / (sum(fragment_hits) + sum(fragment_misses)), 4)", "sum(fragment_hits) + sum(fragment_misses)"),
    ("tooling.external_calls_saved_per_pack", "round(sum(calls_saved) / count(*), 3)", "count(*)"), ("tooling.contract_tokens_saved_est", "max(40)", "max(1)"), ("references.bytes_deferred_est", "sum(bytes_deferred)", "count(*)")))}


@add("a15_benchmark_snapshot", with_tables("event_log", ctes=_VALUES | {k: _KPIS[k] for k in ("g(key, operator, target, least)", "m")}, query="SELECT key, target, value, status FROM m"))
def _(s, d):
    runs = D.event_log(s, d).selectExpr(*[c.strip() for c in _RUNS.split(",")], "map('index_refresh', candidates / 4, 'other', 1D) as stage_timings")
    return metrics.matrix(warm.benchmark_values(runs, 40))
