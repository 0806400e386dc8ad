"""Queries of whole memory writes and reads, project selection and state, scoped search,
chunks with their text, and retrieval quality, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, evidence, lookup, memory, projects, retrieve, stage
from ..sources import derived as D
from ..sources.derived import with_tables
from ..sources.project_state import ProjectState
from .registry import _BM25, _TRIM, AS_OF, _a, _index, add
from .upkeep import _MARKED_LINES, _whole

# M: writes of every kind ------------------------------------------------------------
# one for each turn: blank, secret and padded identifiers, wild confidences, secrets and host paths in values
_WRITES = {
    "namespace": "case seq % 29 when 0 then '  ' when 1 then 'api_key=abcdef123456' when 2 then ' ns1 ' when 3 then 'skills/' || namespace else namespace end",
    "name": "case seq % 31 when 0 then null when 1 then 'token=abcdef123456' when 2 then key || ' ' else key end",
    "body": "case seq % 5 when 0 then 'see password=hunter2secret there' when 1 then 'under /home/me/x.txt now' else 'plain ' || key || ' ' || seq end",
    "sure": "case seq % 37 when 0 then null when 1 then 1.5 when 2 then -0.1 else confidence end",
    "source": "case seq % 3 when 0 then null when 1 then 'token=abcdef123456' else 'cli' end",
    "ttl": "case when ttl_days < 0 then null else ttl_days end",
}
_WRITES_SQL = "SELECT seq, written_s, decided_by, confidence, " + ", ".join(f"{v} AS {k}" for k, v in _WRITES.items() if k != "namespace") + f", {_WRITES['namespace']} AS space FROM memory_log"


def _writes(s, d):
    log = D.memory_log(s, d)
    return log.select("seq", "decided_by", F.expr(_WRITES["namespace"]).alias("namespace"), F.expr(_WRITES["name"]).alias("name"), F.expr(_WRITES["body"]).alias("body"), F.expr(_WRITES["sure"]).alias("confidence"), F.expr(_WRITES["source"]).alias("source"),
                      F.array(F.lit("a"), F.expr("if(seq % 7 = 0, 'token=abcdef123456', 'b')")).alias("tags"), F.expr(_WRITES["ttl"]).alias("ttl_days"), "written_at")


_REDACTED_BODY = "CASE seq % 5 WHEN 0 THEN 'see [REDACTED_SECRET_1] there' WHEN 1 THEN 'under [REDACTED_HOST_PATH] now' ELSE body END"
_CATEGORIES = "array_to_string(list_sort(list_distinct(list_filter([CASE seq % 5 WHEN 0 THEN 'secret_pattern_1' WHEN 1 THEN 'host_path' END, CASE WHEN seq % 3 = 1 OR seq % 7 = 0 THEN 'secret_pattern_1' END], lambda x: x IS NOT NULL))), ',')"


def _upserted_sql(name: str, bounded: bool) -> dict[str, str]:
    wild = "WHEN sure < 0 OR sure > 1 THEN 'confidence_out_of_range'" if bounded else ""
    return {
        "judged": f"SELECT *, trim(space) AS namespace, trim(coalesce(name, '')) AS key, CASE WHEN trim(space) = '' THEN 'missing_namespace' WHEN seq % 29 = 1 THEN 'sensitive_namespace' WHEN name IS NULL THEN 'missing_{name}' WHEN seq % 31 = 1 THEN 'sensitive_{name}' {wild} END AS reason FROM writes",
        "upserted": "SELECT *, min(seq) OVER w AS first_seq, arg_min(written_s, seq) OVER w AS created_s FROM judged WHERE reason IS NULL WINDOW w AS (PARTITION BY namespace, key) QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY seq DESC) = 1",
    }


_STORED = f"SELECT namespace, key AS name, seq, NULL AS reason, coalesce(sure, 1.0)::DOUBLE AS confidence, md5({_REDACTED_BODY}) AS h, CASE seq % 3 WHEN 0 THEN 'agent' WHEN 1 THEN '[REDACTED_SECRET_1]' ELSE 'cli' END AS source, 'a|' || CASE WHEN seq % 7 = 0 THEN '[REDACTED_SECRET_1]' ELSE 'b' END AS tags, first_seq, created_s, written_s AS updated_s, written_s + ttl * 86400 AS expires_s, {_CATEGORIES} AS categories FROM upserted UNION ALL SELECT NULL, NULL, seq, reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM judged WHERE reason IS NOT NULL"


def _stored(made, name, content):
    stored, rejected = made
    kept = stored.select("namespace", F.col(name).alias("name"), "seq", F.lit(None).cast("string").alias("reason"), "confidence", F.md5(content).alias("h"), "source", F.array_join("tags", "|").alias("tags"), "first_seq", F.unix_timestamp("created_at").alias("created_s"), F.unix_timestamp("updated_at").alias("updated_s"), F.unix_timestamp("expires_at").alias("expires_s"), F.array_join("categories", ",").alias("categories"))
    return kept.unionByName(rejected, allowMissingColumns=True)


def _facts(s, d):
    return memory.upserts(_writes(s, d).withColumnsRenamed({"name": "key", "body": "value"}))


def _summaries(s, d):
    return memory.summary_upserts(_writes(s, d).withColumnsRenamed({"name": "focus", "body": "summary"}))


@add("m01_fact_writes", with_tables("memory_log", ctes={"writes": _WRITES_SQL} | _upserted_sql("key", True), query=_STORED))
def _(s, d):
    return _stored(_facts(s, d), "key", "value")


@add("m02_summary_writes", with_tables("memory_log", ctes={"writes": _WRITES_SQL} | _upserted_sql("focus", False), query=_STORED))
def _(s, d):
    return _stored(_summaries(s, d), "focus", "summary")


_GET = {"writes": _WRITES_SQL} | _upserted_sql("key", True) | {k.replace("judged", "judged2").replace("upserted", "upserted2"): q.replace("FROM judged", "FROM judged2") for k, q in _upserted_sql("focus", False).items()}
_LATE = f"coalesce(written_s + ttl * 86400 < {AS_OF}, false)"


def _get_sql(most: int, shown: str) -> str:
    return with_tables("memory_log", ctes=_GET | {
        "topics": f"SELECT *, {_LATE} AS expired FROM (SELECT seq, namespace, key, decided_by, confidence, written_s, CASE WHEN ttl_days < 0 THEN NULL ELSE ttl_days END AS ttl FROM memory_log) WHERE {shown}",
        "best": "SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY CASE WHEN decided_by = 'human' THEN 0 ELSE 1 END, confidence DESC, written_s DESC, seq) = 1",
        "facts": f"SELECT *, {_LATE} AS expired FROM upserted WHERE {shown}", "sums": f"SELECT *, {_LATE} AS expired FROM upserted2 WHERE {shown}",
        "placed": "SELECT 'fact' AS kind, namespace, row_number() OVER (PARTITION BY namespace ORDER BY first_seq) AS place, key AS name, seq, expired FROM facts UNION ALL SELECT 'summary', namespace, row_number() OVER (PARTITION BY namespace ORDER BY first_seq), key, seq, expired FROM sums UNION ALL SELECT 'decision', namespace, row_number() OVER (PARTITION BY namespace ORDER BY CASE WHEN decided_by = 'human' THEN 0 ELSE 1 END, confidence DESC, written_s DESC, seq), key, seq, expired FROM best",
    }, query=f"SELECT * FROM placed WHERE place <= {most}")


def _get(s, d, most, include_expired):
    decisions = D.memory_log(s, d).select("seq", "namespace", F.col("key").alias("topic"), "decided_by", "confidence", F.col("written_at").alias("updated_at"), (F.col("written_at") + F.make_dt_interval(F.expr(_WRITES["ttl"]).cast("int"))).alias("expires_at"))
    return memory.get(_facts(s, d)[0], _summaries(s, d)[0], decisions, F.timestamp_seconds(F.lit(AS_OF)), most, include_expired)


@add("m04_three_kinds", _get_sql(5, "NOT " + _LATE))
def _(s, d):
    return _get(s, d, 5, False)


@add("m04_with_expired", _get_sql(100, "true"))
def _(s, d):
    return _get(s, d, 100, True)


@add("m08_compacted_summaries", with_tables("memory_log", ctes={
    "earlier": "SELECT namespace, min(seq) AS first_seq, arg_min(written_s, seq) AS created_s FROM memory_log WHERE conv_id % 2 = 0 GROUP BY 1".replace("conv_id", "(seq // 1000)"),
    "texts": "SELECT namespace, left(string_agg('- ' || key || ': ' || left(value, 160), chr(10) ORDER BY r), 1200) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY confidence DESC, written_s DESC, seq) AS r, count(*) OVER (PARTITION BY namespace) AS n FROM memory_log) WHERE n > 40 AND r <= 12 GROUP BY 1",
    "clean": f"SELECT namespace, {_whole('summary')} AS summary FROM texts",
}, query=f"SELECT namespace, 'auto_compact' AS focus, md5(summary) AS h, 0.9::DOUBLE AS confidence, 'auto|compact' AS tags, coalesce(created_s, {AS_OF}) AS created_s, {AS_OF} + 60 * 86400 AS expires_s FROM clean LEFT JOIN earlier USING (namespace)"))
def _(s, d):
    log, at = D.memory_log(s, d), F.timestamp_seconds(F.lit(AS_OF))
    earlier = log.where("seq div 1000 % 2 = 0").select("seq", "namespace", F.lit("auto_compact").alias("focus"), F.col("value").alias("summary"), "confidence", F.lit("cli").alias("source"), F.array(F.lit("a")).alias("tags"), F.lit(None).cast("int").alias("ttl_days"), "written_at")
    stored, _ = memory.summary_upserts(earlier.unionByName(memory.compaction_writes(log, at)))
    return stored.where(F.col("source") == "memory.compact").select("namespace", "focus", F.md5("summary").alias("h"), "confidence", F.array_join("tags", "|").alias("tags"), F.unix_timestamp("created_at").alias("created_s"), F.unix_timestamp("expires_at").alias("expires_s"))


@add("m11_skill_memory", with_tables("memory_log", ctes=_GET, query=f"SELECT 'entry' AS record_kind, namespace, key AS name, seq, coalesce(sure, 1.0)::DOUBLE AS confidence FROM upserted WHERE starts_with(namespace, 'skills/') AND NOT {_LATE} UNION ALL SELECT 'summary', namespace, key, seq, coalesce(sure, 1.0)::DOUBLE FROM upserted2 WHERE starts_with(namespace, 'skills/') AND NOT {_LATE}"))
def _(s, d):
    return lookup.skill_memory(_facts(s, d)[0], _summaries(s, d)[0], F.timestamp_seconds(F.lit(AS_OF))).select("record_kind", "namespace", "name", "seq", "confidence")


# T, J: URIs and projects -------------------------------------------------------------
_URIS = ("'file:///' || path", "'file://localhost/a//b/./' || path", "'http://h/' || path", "' FILE:///x/../' || replace(path, '_', '%5F') || ' '", "'file:///p%20q/' || path || '?v=1#top'", "'/r/' || path || '/../z+1'", "'file://other/' || path", "'file:///50%/a+b~*/' || path", "path", "''")
_URIS_SQL = "[" + ", ".join(("path", "'a/b/' || path", "NULL", "path", "'p q/' || path", "'r/' || regexp_replace(path, '/[^/]*$', '') || '/z+1'", "NULL", "'50%/a+b~*/' || path", "NULL", "NULL")) + "]"


@add("t16_canonical_uri", with_tables("files", query=f"SELECT doc_id, '/' || p AS path, 'file:///' || replace(replace(replace(replace(p, '%', '%25'), ' ', '%20'), '+', '%2B'), '*', '%2A') AS uri FROM (SELECT doc_id, ({_URIS_SQL})[doc_id % 10 + 1] AS p FROM files)"))
def _(s, d):
    f = D.files(s, d).select("doc_id", F.expr(f"element_at(array({', '.join(_URIS)}), cast(doc_id % 10 + 1 as int))").alias("uri"))
    return f.select("doc_id", T.local_uri_path(F.col("uri")).alias("path"), T.canonical_uri(F.col("uri")).alias("uri"))


@add("j01_projects_under", with_tables("files", ctes={
    "place": "SELECT path, doc_id, regexp_replace(path, '/[^/]*$', '') AS dir, split_part(path, '/', 1) AS lang FROM files",
    "paths": "SELECT path FROM place UNION SELECT dir || '/.git/HEAD' FROM place WHERE doc_id % 90 = 0 UNION SELECT dir || '/pyproject.toml' FROM place WHERE doc_id % 40 = 0 UNION SELECT dir || '/.hidden/a/pyproject.toml' FROM place WHERE doc_id % 40 = 1 UNION SELECT dir || '/1/2/3/' || doc_id || '/pyproject.toml' FROM place WHERE doc_id % 50 = 2 UNION SELECT lang || '/.git/HEAD' FROM place WHERE doc_id % 4 = 0",
    "mk": "SELECT regexp_replace(path, '/(\\.git/HEAD|pyproject\\.toml)$', '') AS dir, ends_with(path, '/HEAD') AS git FROM paths WHERE ends_with(path, '/HEAD') OR ends_with(path, '/pyproject.toml')",
    "fo": "SELECT dir, bool_or(git) AS git, bool_or(NOT git) AS other FROM mk GROUP BY 1",
    "un": "SELECT fo.*, r.lang AS root, r.mapped FROM fo JOIN (SELECT DISTINCT lang, lang < 'f' AS mapped FROM place) r ON dir = lang OR starts_with(dir, lang || '/') WHERE len(string_split(dir, '/')) <= 5 AND NOT contains(dir, '/.')",
    "ok": "SELECT * FROM un a WHERE NOT (dir = root AND mapped AND NOT other AND EXISTS (SELECT 1 FROM un b WHERE b.root = a.root AND b.dir <> b.root))",
}, query="SELECT root AS scan_root, dir AS root, CASE WHEN git THEN 'discovered_git' ELSE 'discovered_marker' END AS origin FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.root = a.root AND starts_with(a.dir, b.dir || '/')) ORDER BY a.root, string_split(a.dir, '/') LIMIT 100"))
def _(s, d):
    f = D.files(s, d).select("path", "doc_id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.split_part("path", F.lit("/"), F.lit(1)).alias("lang"))
    made = "stack(6, path, if(doc_id % 90 = 0, dir || '/.git/HEAD', null), if(doc_id % 40 = 0, dir || '/pyproject.toml', null), if(doc_id % 40 = 1, dir || '/.hidden/a/pyproject.toml', null), if(doc_id % 50 = 2, dir || '/1/2/3/' || doc_id || '/pyproject.toml', null), if(doc_id % 4 = 0, lang || '/.git/HEAD', null)) as path"
    roots = f.select(F.col("lang").alias("pos"), F.col("lang").alias("root"), (F.col("lang") < "f").alias("mapped")).distinct()
    return projects.discover_under(f.selectExpr(made).where("path is not null"), roots, [".git", "pyproject.toml"])


_ASKED = "SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'file:///w/' || path WHEN 1 THEN 'http://h/x' ELSE '' END AS root_uri, CASE doc_id % 7 WHEN 0 THEN 'p_' || project_id WHEN 1 THEN 'nobody' WHEN 2 THEN 'v_de' END AS wanted, (doc_id % 4)::INT AS v, CASE doc_id % 5 WHEN 0 THEN path[4:] WHEN 1 THEN '/en/src1' WHEN 2 THEN '../fr/' || path[4:] WHEN 3 THEN '.' ELSE 'gone.txt' END AS hint FROM files"


@add("j03_j04_project_of_request", with_tables("files", ctes={
    "asked": _ASKED,
    "vis": "SELECT doc_id, 'v_' || r AS pid, '/' || r AS root FROM asked, (VALUES ('de', 1), ('en', 2), ('fr', 3)) t(r, k) WHERE k <= v",
    "there": "SELECT DISTINCT '/' || path AS spot FROM files",
    "held": "SELECT doc_id, count(DISTINCT pid) AS held, min(pid) AS inferred FROM (SELECT doc_id, pid, root, CASE WHEN hint[1] = '/' THEN hint WHEN starts_with(hint, '../') THEN '/' || hint[4:] ELSE root || '/' || hint END AS spot, hint[1] = '/' AS given FROM asked JOIN vis USING (doc_id) WHERE hint <> '.') WHERE (spot = root OR starts_with(spot, root || '/')) AND (given OR spot IN (SELECT spot FROM there)) GROUP BY 1",
    "known": "SELECT DISTINCT 'p_' || project_id AS pid FROM files",
    "r": "SELECT a.*, coalesce(held, 0) AS held, inferred, (wanted IN (SELECT pid FROM known) OR EXISTS (SELECT 1 FROM vis w WHERE w.doc_id = a.doc_id AND w.pid = wanted)) AS found FROM asked a LEFT JOIN held USING (doc_id)",
}, query="SELECT doc_id AS request_id, CASE WHEN root_uri <> '' THEN CASE WHEN starts_with(root_uri, 'file') THEN root_uri END WHEN wanted IS NOT NULL THEN CASE WHEN found THEN wanted END WHEN v = 1 THEN 'v_de' WHEN v > 1 AND held = 1 THEN inferred END AS project, CASE WHEN root_uri <> '' THEN 'root_uri' WHEN wanted IS NOT NULL THEN 'project_id' WHEN v = 1 THEN 'visible' WHEN v > 1 THEN 'inferred' ELSE 'none' END AS source, CASE WHEN root_uri <> '' THEN CASE WHEN NOT starts_with(root_uri, 'file') THEN 'invalid_root_uri' END WHEN wanted IS NOT NULL THEN CASE WHEN NOT found THEN 'unknown_project' END WHEN v = 0 THEN 'project_selection_required' WHEN v > 1 AND held <> 1 THEN 'ambiguous_project' END AS error FROM r"))
def _(s, d):
    f = D.files(s, d).select("doc_id", "project_id", "path")
    asked = f.select(
        F.col("doc_id").alias("request_id"), F.expr("case doc_id % 11 when 0 then 'file:///w/' || path when 1 then 'http://h/x' else '' end").alias("root_uri"), F.expr("case doc_id % 7 when 0 then 'p_' || project_id when 1 then 'nobody' when 2 then 'v_de' end").alias("project_id"),
        F.array(F.expr("case doc_id % 5 when 0 then substring(path, 4) when 1 then '/en/src1' when 2 then '../fr/' || substring(path, 4) when 3 then '.' else 'gone.txt' end")).alias("hints"))
    visible = f.select(F.col("doc_id").alias("request_id"), F.explode(F.expr("slice(array('de', 'en', 'fr'), 1, cast(doc_id % 4 as int))")).alias("r")).select("request_id", F.concat(F.lit("v_"), "r").alias("project_id"), F.concat(F.lit("/"), "r").alias("root"))
    return lookup.resolve_projects(asked, visible, f.select(F.concat(F.lit("p_"), "project_id").alias("project_id")), f.select(F.concat(F.lit("/"), "path").alias("path")))


@add("j08_project_state", with_tables("files", "entries", query="SELECT 'files' AS tbl, project_id, count(*) AS n FROM files WHERE project_id <> 'fr' GROUP BY 2 UNION ALL SELECT 'entries', project_id, count(*) FROM entries WHERE project_id <> 'fr' GROUP BY 2"))
def _(s, d):
    state = ProjectState(s, stage.folder(s, "project-state"))
    tables = {"files": D.files(s, d).select("path", "size", "project_id"), "entries": D.entries(s, d).select("key", "project_id")}
    for name, rows in tables.items():
        state.write(name, rows)
    state.prune("fr")
    parts = [state.read(name, rows.schema).groupBy("project_id").count().select(F.lit(name).alias("tbl"), "project_id", F.col("count").alias("n")) for name, rows in tables.items()]
    return parts[0].unionByName(parts[1])


# R, X: bounds and chunks ---------------------------------------------------------------
@add("r04_bounded_search", _BM25 + ", sc AS (SELECT item_id AS request_id, CASE item_id % 3 WHEN 0 THEN 'en/src1' WHEN 1 THEN '.' ELSE 'fr' END AS scope, item_id % 4 AS g FROM benchmark) SELECT request_id, path, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, path) AS rank FROM hit JOIN sc USING (request_id) WHERE (scope = '.' OR starts_with(path, scope || '/')) AND (g = 0 OR (g = 1 AND (path LIKE '%/doc\\_%1.txt' ESCAPE '\\' OR path LIKE 'de/%')) OR (g = 2 AND regexp_matches(path, '^(?s:.*)/doc_[0-4][^5-9]?\\.txt$')) OR (g = 3 AND regexp_matches(path, '^(?s:.*)/doc_..\\.txt$'))) QUALIFY rank <= 4".replace("[0-4][^5-9]?\\.", "[0-4][^5-9](?s:.*)\\."))
def _(s, d):
    rq = D.requests(s, d)
    globs = F.when(F.col("request_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("request_id") % 4 == 1, T.words("*/doc_*1.txt", "de/*")).when(F.col("request_id") % 4 == 2, T.words("*/doc_[0-4][!5-9]*.txt")).otherwise(T.words("*/doc_??.txt", "[zz"))
    scope = F.when(F.col("request_id") % 3 == 0, "en/src1/").when(F.col("request_id") % 3 == 1, ".").otherwise("fr")
    return retrieve.scoped_search(rq.select("request_id", scope.alias("scope"), globs.alias("globs")), rq, 4, _index(s, d)).select("request_id", "path", "rank")


@add("x08_chunk_texts", with_tables("marked_files", ctes=_MARKED_LINES | {
    "w": "SELECT m.path, (doc_id % 100 + 1)::INT AS line, len(ls) AS n, ls, left(sha256(content), 16) AS t FROM marked_files m JOIN marked_lines USING (path)",
    "c": "SELECT *, ((line - 1) // 80 * 80 + 1)::INT AS a FROM w WHERE line <= n", "x": "SELECT *, least(a + 79, n) AS e, array_to_string(ls[a:least(a + 79, n)], chr(10)) AS raw FROM c",
}, query=f"SELECT path, line, a AS start_line, e AS end_line, 'chk_' || left(sha256(path || ':' || t || ':' || a || ':' || e), 16) AS chunk_id, {_whole(_TRIM.format('raw', 1200, 1185))} AS content, length(raw) > 1200 AS truncated FROM x"))
def _(s, d):
    f = D.marked_files(s, d)
    return evidence.chunk_texts(f, f.select("path", (F.col("doc_id") % 100 + 1).cast("int").alias("line"))).drop("redactions")


# A: quality ------------------------------------------------------------------------------
_QUALITY = _BM25 + ", an AS (SELECT request_id, path, rank % 4 <> 0 AS required FROM ranked WHERE rank <= 8 AND rank % 2 = 0), it AS (SELECT request_id, path, rank, CASE WHEN rank <> 3 THEN path END AS detail FROM ranked WHERE rank <= 5), bn AS (SELECT request_id, path, CASE WHEN rank = 5 THEN 'outdated' END AS reason FROM ranked WHERE rank IN (5, 7) OR (rank = 1 AND request_id % 2 = 0))"


def _quality(s, d):
    hits = retrieve.search(D.files(s, d), D.requests(s, d), 8, _index(s, d)).withColumnRenamed("request_id", "task")
    hits = stage.kept(hits.select("task", "path", "rank"), "quality-hits")
    anchors = hits.where("rank % 2 = 0").select("task", "path", F.expr("rank % 4 <> 0").alias("required"))
    items = hits.where("rank <= 5").select("task", "path", "rank", F.expr("if(rank <> 3, path, null)").alias("detail"))
    return anchors, items, hits.where("rank in (5, 7) or (rank = 1 and task % 2 = 0)").select("task", "path", F.expr("if(rank = 5, 'outdated', null)").alias("reason"))


@add("a16_quality_report", _QUALITY + ", j AS (SELECT required, rank FROM an LEFT JOIN it USING (request_id, path)), q AS (SELECT count(*) FILTER (required) AS n, count(*) FILTER (required AND rank <= 3) AS h3, count(*) FILTER (required AND rank <= 5) AS h5, avg(rank) AS mean, count(*) FILTER (required AND rank IS NULL) AS lost FROM j), o AS (SELECT count(*) AS rows, count(*) FILTER (an.path IS NULL) AS noise, count(detail) AS d FROM it LEFT JOIN an USING (request_id, path)), st AS (SELECT count(*) AS stale FROM bn SEMI JOIN it USING (request_id, path)), fx AS (SELECT count(*) AS fixtures FROM benchmark) SELECT fixtures, round(h3 / greatest(1, n), 4) AS anchor_recall_at_3, round(h5 / greatest(1, n), 4) AS anchor_recall_at_5, coalesce(round(mean, 4), 0) AS first_anchor_rank_avg, round(noise / greatest(1, rows), 4) AS noise_ratio, lost AS required_omissions, round(d / greatest(1, rows), 4) AS detail_lookup_rate, round(stale / greatest(1, fixtures), 4) AS stale_rate FROM q, o, st, fx")
def _(s, d):
    return lookup.quality_report(D.requests(s, d).select(F.col("request_id").alias("task")), *_quality(s, d))


@add("a16_regressions", _QUALITY + " SELECT request_id AS task, path, 'required_anchor_omitted' AS reason FROM an ANTI JOIN it USING (request_id, path) WHERE required UNION ALL SELECT request_id, path, coalesce(reason, 'must_not_include') FROM bn SEMI JOIN it USING (request_id, path)")
def _(s, d):
    return lookup.quality_regressions(*_quality(s, d))


_RUNS = ", r AS (SELECT operation AS case_id, event_id // 2 AS repeat, event_id % 2 AS warm, elapsed_ms, candidates AS hits, selected AS misses, ['a' || candidates % 3, 'b', 'c' || results] AS sel, CASE WHEN operation = 'view' THEN [] ELSE ['b', 'a' || results % 2, 'b'] END AS req FROM event_log)"


@add("a17_warm_recall", _a(_RUNS + ", k AS (SELECT case_id, bool_and(same) AS retained FROM (SELECT case_id, repeat, min(sel) = max(sel) AS same FROM r GROUP BY ALL) GROUP BY 1), g AS (SELECT case_id, median(elapsed_ms) FILTER (warm = 0) AS cold, median(elapsed_ms) FILTER (warm = 1) AS hot, sum(hits) FILTER (warm = 1) AS h, sum(misses) FILTER (warm = 1) AS m, min(CASE WHEN len(req) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(req), sel)) / len(list_distinct(req)) END) FILTER (warm = 1) AS rc FROM r GROUP BY 1) SELECT case_id, round((cold - hot) / cold, 4) AS improvement, round(h / (h + m), 4) AS fragment_hit_ratio, retained, round(rc, 4) AS required_anchor_recall, h / (h + m) >= 0.6 AND (cold - hot) / cold >= 0.3 AND retained AND rc >= 1 AS passed FROM g JOIN k USING (case_id)").replace(") , r AS", "), r AS"))
def _(s, d):
    runs = D.event_log(s, d).select(
        F.col("operation").alias("case_id"), F.expr("event_id div 2").alias("repeat"), F.expr("if(event_id % 2 = 1, 'warm', 'cold')").alias("phase"), "elapsed_ms", F.col("candidates").alias("hits"), F.col("selected").alias("misses"),
        F.expr("array('a' || candidates % 3, 'b', 'c' || results)").alias("selected"), F.expr("if(operation = 'view', array(), array('b', 'a' || results % 2, 'b'))").cast("array<string>").alias("required"))
    return lookup.warm_verdict(runs).select("case_id", "improvement", "fragment_hit_ratio", "retained", "required_anchor_recall", "passed")
