"""Queries of snippets, test owners, references and evidence, of derived tables kept up
to date, and of search over written postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, evidence, extract, lookup, memory, metrics, retrieve, stage, upkeep
from ..sources import derived as D
from ..sources import textfiles
from ..sources.derived import with_tables
from ..sources.versions import Store
from .registry import _BM25, _HEADS, _SUMMARY, _SUMS, _TOKENS, _TRIM, _a, _index, _redacted, add

_MARKED_LINES = {"marked_lines": D.SQL["filelines"].replace("FROM files", "FROM marked_files")}


def _whole(col: str) -> str:
    """Redacted, host paths too: RE2 has no lookaround, so a path's neighbours are put back."""
    col = _redacted(col)
    for pattern, after in zip(T.HOST_PATHS, (3, 2), strict=True):
        spelled = pattern.replace("(?<![\\w:/.-])", "(^|[^\\p{L}\\p{N}_:/.-])").replace("(?=$|[\\s:'\",)>\\]}])", "($|[\\s:'\",)>\\]}])").replace("'", "''")
        col = f"regexp_replace({col}, '{spelled}', '\\1[REDACTED_HOST_PATH]\\{after}', 'g')"
    return col


_SIGNALS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{n}' END" for n, p in T.INJECTIONS.items()) + ")"


@add("x09_snippets", with_tables("marked_files", ctes=_MARKED_LINES | {
    "w": "SELECT doc_id, m.path, (doc_id % 4 + 1)::INT AS a, (doc_id % 4 + 2)::INT AS b, ls FROM marked_files m JOIN marked_lines USING (path)",
    "x": "SELECT path, a, b, greatest(1, a - 1) AS s, greatest(greatest(1, a - 1), least(len(ls), b + 2)) AS e, len(ls) AS total_lines, array_to_string(ls[greatest(1, a - 1):greatest(greatest(1, a - 1), least(len(ls), b + 2))], chr(10)) AS raw FROM w",
    "y": f"SELECT *, {_whole(_TRIM.format('raw', 300, 285))} AS content FROM x",
}, query=f"SELECT path, s AS start_line, e AS end_line, total_lines, content, length(raw) > 300 AS truncated, {_SIGNALS} AS signals FROM y"))
def _(s, d):
    f, a = D.marked_files(s, d), (F.col("doc_id") % 4 + 1).cast("int")
    rows = extract.snippets(f, f.select("path", a.alias("start_line"), (a + 1).alias("end_line")), 1, 2, 300)
    return rows.select("path", "start_line", "end_line", "total_lines", "content", "truncated", F.array_join("signals", ",").alias("signals"))


_BAD = "case when doc_id % 17 = 0 then 'x/' || path when doc_id % 17 = 1 then 'build/' || path else path end"


@add("x10_snippet_batch", with_tables("marked_files", ctes={
    "listed": f"SELECT path, content FROM marked_files UNION ALL SELECT {_BAD}, content FROM marked_files WHERE doc_id % 17 = 1 UNION ALL SELECT 'none/' || doc_id, NULL FROM marked_files WHERE doc_id % 17 = 2",
    "ll": D.SQL["filelines"].replace("project_id, ", "").replace("FROM files", "FROM listed"),
    "w": f"SELECT CASE WHEN doc_id % 17 = 2 THEN 'none/' || doc_id ELSE {_BAD} END AS path, (doc_id % 4)::INT AS a FROM marked_files",
    "x": "SELECT w.path, a, CASE WHEN a < 1 THEN 'invalid_range' WHEN l.path IS NULL THEN 'missing_file' WHEN starts_with(w.path, 'build/') THEN 'excluded_path' WHEN ls IS NULL THEN 'unindexed' END AS error, ls FROM w LEFT JOIN ll l ON w.path = l.path",
    "y": "SELECT path, a, error, array_to_string(ls[a:greatest(a, least(len(ls), a + 1))], chr(10)) AS raw FROM x",
}, query=f"SELECT path, a AS requested_start, error, CASE WHEN error IS NULL THEN {_whole(_TRIM.format('raw', 4000, 3985))} END AS content FROM y"))
def _(s, d):
    f = D.marked_files(s, d)
    more = f.where("doc_id % 17 = 1").selectExpr(f"{_BAD} as path", "content").unionByName(f.where("doc_id % 17 = 2").selectExpr("'none/' || doc_id as path", "cast(null as string) as content"))
    wanted = f.select(F.expr(f"if(doc_id % 17 = 2, 'none/' || doc_id, {_BAD})").alias("path"), (F.col("doc_id") % 4).cast("int").alias("start_line")).withColumn("end_line", F.col("start_line") + 1)
    return extract.snippets(f.select("path", "content").unionByName(more), wanted).select("path", "requested_start", "error", "content")


_TESTS = "case doc_id % 5 when 0 then 'tests/test_doc_' || doc_id || '.py' when 1 then 'test/test_doc_' || doc_id || '.py' when 2 then 'tests/doc_' || doc_id || '_test.py' when 3 then 'test/doc_' || doc_id || '_test.py' else 'tests/test_doc_' || doc_id || '.txt' end"


@add("r11_test_owners", with_tables("files", query="SELECT path AS source, (doc_id % 5)::INT AS pattern, " + _TESTS + " AS path FROM files WHERE doc_id % 5 < 4"))
def _(s, d):
    f = D.files(s, d).select("doc_id", "path")
    tests = f.selectExpr(f"{_TESTS} as path")
    return retrieve.direct_owners(f.select("path").unionByName(tests), f.select("path").unionByName(tests))


@add("e05_resolve", with_tables("json_refs", "wanted_refs", query="""SELECT w.reference_id, CASE k WHEN 1 THEN 'invalid_reference' WHEN 2 THEN 'expired' WHEN 3 THEN 'missing' WHEN 4 THEN 'stale' WHEN 5 THEN 'expired' WHEN 6 THEN 'stale' WHEN 7 THEN 'stale' WHEN 8 THEN 'stale' WHEN 9 THEN 'expired' WHEN 10 THEN 'invalid_reference' WHEN 11 THEN 'hash_mismatch' ELSE 'resolved' END AS outcome,
(['', 'provided_reference_expired', '', 'invalidated', 'expired', 'payload_unavailable', 'stored_hash_mismatch', 'invalid_json_payload', 'envelope_expired', '', '', ''])[k] AS reason
FROM (SELECT w.reference_id, CASE WHEN NOT regexp_full_match(w.reference_id, 'ref_[A-Za-z0-9]+') THEN 1 WHEN provided_s < 1704200000 THEN 2 WHEN r.reference_id IS NULL THEN 3 WHEN invalidated THEN 4 WHEN hours_left < 0 THEN 5 WHEN coalesce(body, '') = '' THEN 6 WHEN sha256(body) <> sha256 THEN 7 WHEN NOT json_valid(body) THEN 8
 WHEN body LIKE '%reference.envelope.v1%' AND body LIKE '%2020-%' THEN 9 WHEN body LIKE '%reference.envelope.v1%' AND body LIKE '%ref_other%' THEN 10 WHEN expected_hash <> '' AND expected_hash <> sha256(body) THEN 11 ELSE 12 END AS k FROM wanted_refs w LEFT JOIN json_refs r ON w.reference_id = r.reference_id) w"""))
def _(s, d):
    rows = memory.resolve(D.wanted_references(s, d), D.json_references(s, d), F.timestamp_seconds(F.lit(1704200000)))
    return rows.withColumn("reason", F.coalesce("reason", F.lit("")))


@add("c10_baseline_tokens", with_tables("filelines", ctes=_HEADS | {"s": _SUMMARY.format("path, ", "h")}, query="SELECT split_part(path, '/', 1) AS lang, (greatest(1, (sum(length(to_json({'content': content, 'end_line': end_line, 'path': path, 'start_line': start_line})) + 1) + 4) // 4) + (sum(greatest(0, source_chars - length(content))) + 3) // 4)::BIGINT AS tokens FROM s GROUP BY 1"))
def _(s, d):
    rows = extract.head_summary(D.files(s, d)).withColumn("deferred_chars", F.greatest(F.lit(0), F.col("source_chars") - F.length("content")))
    return rows.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("lang")).agg(evidence.baseline_tokens().alias("tokens"))


# Programs made of the documents' words: where each word's piece begins, and what it declares.
_PROGRAM = "SELECT path, 'n_' || unnest(ts) AS n, unnest(range(0, len(ts))) AS i FROM {0} WHERE doc_id % 3 = 0 AND doc_id % 20 <> 3{1}"
_PLACED = "SELECT path, n, i % 4 AS k, (1 + 7 * (i // 4) + ([0, 1, 3, 6])[i % 4 + 1])::INT AS line FROM program"
_DECLARED = "SELECT path, n AS name, CASE k WHEN 1 THEN 'function' ELSE 'class' END AS kind, line AS line_start, line + 1 AS line_end, CASE k WHEN 1 THEN 'def ' || n || '(x):' ELSE 'class ' || n || ':' END AS signature FROM placed WHERE k IN (1, 2)"
_OTHERS = " UNION ALL ".join(f"SELECT path, regexp_extract(line, '{p}', {g}) AS name, '{k}' AS kind, i AS line_start, i AS line_end, left(trim(line), 160) AS signature FROM other_lines WHERE regexp_matches(line, '{p}')" for k, p, g in (("function", r"\bfunction\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1), ("function", r"\bdef\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1), ("class", r"\b(class|struct|interface)\s+([A-Za-z_][A-Za-z0-9_]*)", 2)))


def _symbols_sql(files: str, unparsed: str = "") -> dict[str, str]:
    """Symbols and imports of ``files``; ``unparsed`` names Python files beside those made not to parse."""
    return {
        "program": _PROGRAM.format(files, unparsed), "placed": _PLACED, "declared": _DECLARED, "imported": "SELECT path, n AS module, line FROM placed WHERE k IN (0, 3)",
        "file_lines": D.SQL["filelines"].replace("project_id, ", "").replace("FROM files", f"FROM {files}"),
        "other_lines": "SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS i FROM file_lines WHERE NOT ends_with(path, '.py')", "others": _OTHERS,
    }


@add("x02_x03_python_symbols", with_tables("source_files", ctes=_symbols_sql("source_files"), query="SELECT * FROM declared UNION ALL SELECT path, module, 'import', line, line, '' FROM imported"))
def _(s, d):
    return extract.python_symbols(D.source_files(s, d).where(F.col("path").endswith(".py")))


@add("x04_generic_symbols", with_tables("source_files", ctes=_symbols_sql("source_files"), query="SELECT path, name, kind, line_start FROM others"))
def _(s, d):
    return extract.generic_symbols(D.source_files(s, d).where(~F.col("path").endswith(".py"))).select("path", "name", "kind", "line_start")


_LATER = _symbols_sql("later_sources", " AND (doc_id % 7 <> 0 OR starts_with(path, 'new/'))") | {
    "lines_of": "SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM file_lines",
    "toks": f"SELECT path, i, unnest({_TOKENS.format('line')}) AS term FROM lines_of",
    "rank_of": "SELECT path, i AS last FROM (SELECT path, term, min(i) AS i FROM toks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY i, term) = 4000",
    "posted": f"SELECT path, term, min(i) AS i, count(*) AS n FROM (SELECT t.path, term, i FROM toks t LEFT JOIN rank_of r ON t.path = r.path WHERE last IS NULL OR i <= last UNION ALL SELECT path, unnest({_TOKENS.format('path')}), 1 FROM later_sources) GROUP BY ALL",
    "four": "SELECT 'files' AS tbl, path, strlen(content) || '|' || sha256(content) AS r FROM later_sources UNION ALL SELECT 'symbols', path, concat_ws('|', name, kind, line_start, line_end, signature) FROM (SELECT * FROM declared UNION ALL SELECT * FROM others) UNION ALL SELECT 'imports', path, module || '|' || line FROM imported UNION ALL SELECT 'postings', path, concat_ws('|', term, i, n) FROM posted",
}


@add("s09_joint_update", with_tables("later_sources", ctes=_LATER, query="SELECT tbl, path, count(*) AS n, md5(string_agg(r, chr(10) ORDER BY r)) AS h FROM four GROUP BY ALL"))
def _(s, d):
    """All four tables after the later listing's changes were applied to those of the first."""
    store, old = Store(s, stage.folder(s, "derived")), stage.kept(D.source_files(s, d), "sources")
    new = D.later_sources(s, d, old)
    upkeep.apply_changes(store, 0, old.select("path", "size", "mtime_ns", "content"))
    diff = stage.kept(corpus.refresh_diff(store.read("files"), new), "diff")
    upkeep.apply_changes(store, 1, upkeep.changes_of(diff, new))
    rows = {"files": ("size", "sha256"), "symbols": ("name", "kind", "line_start", "line_end", "signature"), "imports": ("module", "line"), "postings": ("term", "first_line", "tf")}
    out = None
    for table, columns in rows.items():
        part = store.read(table).select(F.lit(table).alias("tbl"), "path", F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("r"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("tbl", "path").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("r")), "\n")).alias("h"))


_BINARY = "CASE WHEN doc_id % 9 = 0 THEN left(text, 50) || chr(0) || substr(text, 51) WHEN doc_id % 9 = 1 THEN repeat('é', 3000) || chr(0) WHEN doc_id % 9 = 2 THEN repeat('x', 5000) || chr(0) ELSE text END"
_SUFFIX = "(['.txt', '.md', '', '.bin', '.PY'])[doc_id % 5 + 1]"


@add("s01_s03_text_files", f"SELECT path, strlen(content) AS size, sha256(content) AS sha256 FROM (SELECT 'f' || doc_id % 4 || '/d_' || doc_id || {_SUFFIX} AS path, doc_id, {_BINARY} AS content FROM documents) WHERE doc_id % 5 <> 3 AND strlen(content) <= 262144 AND doc_id % 9 <> 0")
def _(s, d):
    """The documents written as files of their own and read back by S01 and S03."""
    folder = stage.folder(s, "texts")
    content = F.expr("case when doc_id % 9 = 0 then left(text, 50) || '\0' || substr(text, 51) when doc_id % 9 = 1 then repeat('é', 3000) || '\0' when doc_id % 9 = 2 then repeat('x', 5000) || '\0' else text end")
    path = F.expr("'f' || doc_id % 4 || '/d_' || doc_id || element_at(array('.txt', '.md', '', '.bin', '.PY'), cast(doc_id % 5 + 1 as int))")
    textfiles.write_files(s.read.parquet(f"{d}/documents.parquet").select(path.alias("path"), content.alias("content")), folder)
    found = textfiles.scan(s, folder)
    return found.select("path", "size", F.sha2("content", 256).alias("sha256"))


@add("s03_binary_sniff", f"SELECT doc_id, regexp_matches(left(hex(encode(c)), 8192), '^(..)*?00') AS is_binary FROM (SELECT doc_id, {_BINARY} AS c FROM documents)")
def _(s, d):
    content = F.expr("case when doc_id % 9 = 0 then left(text, 50) || '\0' || substr(text, 51) when doc_id % 9 = 1 then repeat('é', 3000) || '\0' when doc_id % 9 = 2 then repeat('x', 5000) || '\0' else text end")
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", corpus.is_binary(content.cast("binary")).alias("is_binary"))


# Rollups with their missing parts


@add("a06_a18_fragments", _a("SELECT coalesce(namespace, '*') AS namespace, sum(h)::BIGINT AS hits, sum(m)::BIGINT AS misses, coalesce(round(sum(h) / nullif(sum(h) + sum(m), 0), 4), 0)::DOUBLE AS ratio FROM (SELECT 'file_summary' AS namespace, selected AS h, candidates AS m FROM event_log UNION ALL SELECT cache_namespace, candidates, selected FROM event_log UNION ALL SELECT 'unused', 0, 0) GROUP BY ROLLUP (namespace)"))
def _(s, d):
    rows = D.event_log(s, d).withColumn("fragments", F.expr("map('file_summary', struct(selected as hits, candidates as misses), cache_namespace, struct(candidates as hits, selected as misses))"))
    return evidence.fragment_totals(rows, ("file_summary", "unused"))


@add("a09_warmup_metrics", _a("SELECT count(*) AS n, count(*) FILTER (manual) AS manual_count, count(*) FILTER (NOT manual) AS auto_count, round(sum(elapsed_ms::DECIMAL(18,6))::DOUBLE / count(*), 3) AS avg_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms, sum(results)::BIGINT AS query_count, round(sum(results)::DOUBLE / count(*), 3) AS avg_query_count, arg_max(elapsed_ms, event_id) AS last_ms, arg_max(results, event_id) AS last_query_count, CASE WHEN arg_max(manual, event_id) THEN 'manual' ELSE 'auto' END AS last_trigger, arg_max(cache_reason, event_id) FILTER (NOT manual) AS last_auto_status, max(event_id) FILTER (NOT manual) AS last_auto_event FROM event_log WHERE operation = 'signup'"))
def _(s, d):
    return metrics.warmup(D.event_log(s, d).withColumnRenamed("cache_reason", "status"), "signup")


@add("a13_across_projects", _a(f"SELECT *, coalesce(round(hits / nullif(hits + misses, 0), 4), 0)::DOUBLE AS fragment_ratio FROM (SELECT coalesce(project_id, '*') AS project_id, {_SUMS} FROM event_log GROUP BY ROLLUP (project_id))"))
def _(s, d):
    return metrics.across_projects(D.event_log(s, d))


@add("k07_request_reason", _a("SELECT event_id // 3 AS request_id, CASE WHEN bool_or(event_id // 3 % 10 = 0) THEN 'signature_unavailable' WHEN bool_or(cache_hit) THEN 'fragment_hit' WHEN min(r) IS NULL THEN 'no_fragments' WHEN min(r) = max(r) THEN min(r) ELSE 'fragment_miss' END AS reason, CASE WHEN bool_or(event_id // 3 % 10 = 0) THEN 'bypass' WHEN bool_or(cache_hit) THEN 'hit' ELSE 'miss' END AS status FROM (SELECT *, CASE WHEN event_id // 3 % 7 > 0 THEN cache_reason END AS r FROM event_log) GROUP BY 1"))
def _(s, d):
    rows = D.event_log(s, d).withColumn("request_id", F.expr("event_id div 3")).withColumn("signature_available", F.col("request_id") % 10 != 0)
    return evidence.request_reason(rows.withColumn("cache_reason", F.when(F.col("request_id") % 7 > 0, F.col("cache_reason"))), "request_id")


@add("u12_selected_with_term", _BM25 + "SELECT request_id, term, count(*) FILTER (contains(lower(path || ' ' || 'Title ' || request_id || ' ' || content || ' lexical_match'), term)) AS n FROM (SELECT * FROM rq UNION ALL SELECT DISTINCT request_id, unnest(['title', 'lexical_match']) FROM rq) JOIN ranked USING (request_id) JOIN files USING (path) WHERE rank <= 5 GROUP BY ALL")
def _(s, d):
    files, requests = D.files(s, d), D.requests(s, d)
    items = retrieve.search(files, requests, index=_index(s, d)).join(files.select("path", "content"), "path")
    items = items.withColumn("title_hint", F.concat(F.lit("Title "), "request_id")).withColumn("reason_codes", F.array(F.lit("lexical_match")))
    terms = retrieve.request_terms(requests)
    more = terms.select("request_id").distinct().select("request_id", F.explode(F.array(F.lit("title"), F.lit("lexical_match"))).alias("term"))
    return lookup.selected_with_term(terms.unionByName(more), items)


@add("s12_status_whole", with_tables("source_files", ctes=_symbols_sql("source_files") | {"named": "SELECT path, 1 AS k FROM declared UNION ALL SELECT path, 1 FROM others UNION ALL SELECT path, 2 FROM imported", "per": "SELECT path, count(*) FILTER (k = 1) AS sy, count(*) FILTER (k = 2) AS im FROM named GROUP BY 1"}, query="SELECT split_part(f.path, '/', 1) AS project_id, count(*) AS files, coalesce(sum(sy), 0)::BIGINT AS symbols, coalesce(sum(im), 0)::BIGINT AS imports, max(doc_id * 1000) AS newest FROM source_files f LEFT JOIN per USING (path) GROUP BY 1"))
def _(s, d):
    files = D.source_files(s, d).withColumn("project_id", F.split_part("path", F.lit("/"), F.lit(1)))
    made = upkeep.derived_tables(files)
    return corpus.status(files, made["symbols"], made["imports"])


@add("t15_canonical_globs", with_tables("files", query="SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform([' src\\*.py ', 'src/*.py', '', lang_glob, '**/*.md'], lambda g: replace(trim(g), '\\', '/')), lambda g: g <> ''))), '|') AS globs FROM (SELECT doc_id, project_id || '\\*' AS lang_glob FROM files)"))
def _(s, d):
    globs = F.array(F.lit(" src\\*.py "), F.lit("src/*.py"), F.lit(""), F.concat("project_id", F.lit("\\*")), F.lit("**/*.md"))
    return D.files(s, d).select("doc_id", F.array_join(T.canonical_globs(globs), "|").alias("globs"))
