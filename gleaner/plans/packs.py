"""Queries of pack assembly over requests with paths, and the SQL that checks them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import assemble, extract, index, lookup, pack, stage
from ..sources import derived as D
from ..sources.derived import with_tables
from .registry import _HEADS, _STRIP, _SUMMARY, _TRIM, _bm25, _fragments, _route_sql, _terms, add, selection_sql

MAX_ITEMS = 8

_TERMS8 = _terms("prompt", 8)
_LINES = D.SQL["filelines"].replace("project_id, ", "")
#: The pack's files and requests under the names that other tables read.
_BASE = {
    "files0": D.SQL["files"],
    "files": "SELECT path, content FROM files0 UNION ALL SELECT CASE WHEN doc_id % 4 = 0 THEN 'tests/test_doc_' ELSE 'tests/check_' END || doc_id || '.py', 'def test_doc_' || doc_id || '():' || chr(10) || '    check doc_' || doc_id || ' ' || project_id || chr(10) FROM files0 WHERE doc_id % 4 < 2",
    "filelines": _LINES,
    "asked": "SELECT item_id AS request_id, b.path || ' and gone/file.txt: ' || text AS prompt, a.path AS p1 FROM benchmark JOIN files0 a ON a.doc_id = item_id JOIN files0 b ON b.doc_id = item_id + 1",
    "pp0": "SELECT request_id, 0 AS kind, unnest([0, 1, 2, 3, 4]) AS pos, unnest([p1, '', p1, '../out.txt', 'docs/none.md']) AS path FROM asked UNION ALL SELECT request_id, 1, generate_subscripts(ws, 1), unnest(ws) FROM (SELECT request_id, regexp_extract_all(prompt, '(?:^|[^\\p{L}\\p{N}_/.-])([\\p{L}\\p{N}_./-]+\\.[A-Za-z0-9]{1,8})\\b', 1) AS ws FROM asked)",
    "pp": "SELECT request_id, path, row_number() OVER (PARTITION BY request_id ORDER BY min({'k': kind, 'a': pos})) AS place FROM pp0 WHERE path <> '' AND path NOT LIKE '../%' AND (kind = 0 OR path IN (SELECT path FROM files)) GROUP BY request_id, path QUALIFY place <= 12",
}
_SYMBOLS = {
    "sl": "SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_start FROM filelines",
    "sy": " UNION ALL ".join(f"SELECT path, regexp_extract(line, '{p}', {g}) AS name, '{k}' AS kind, line_start, left(trim(line), 160) AS signature FROM sl WHERE regexp_matches(line, '{p}')" for k, p, g in (("function", r"\bfunction\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1), ("function", r"\bdef\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1), ("class", r"\b(class|struct|interface)\s+([A-Za-z_][A-Za-z0-9_]*)", 2))),
    "sh": f"SELECT DISTINCT request_id, path, name, line_start FROM sy JOIN (SELECT request_id, unnest({_TERMS8}) AS term FROM asked) ON contains(lower(concat_ws(' ', path, name, signature)), term)",
    "sr": "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY path, line_start, name) AS rank FROM sh",
}


def _anchored(name: str, wanted: str) -> dict[str, str]:
    """Anchored summaries of ``wanted`` (a select with path and anchor)."""
    return {
        f"{name}_wanted": wanted,
        f"{name}_lines": f"SELECT path, anchor, ls, length(content) AS chars, greatest(1, least(anchor, greatest(1, len(ls))) - 2)::INT AS start_line FROM (SELECT DISTINCT path, anchor FROM {name}_wanted) JOIN filelines USING (path) JOIN files USING (path)",
        f"{name}_picked": f"SELECT path, anchor, chars, start_line, least(start_line + 5, len(ls))::INT AS end_line, ls[start_line:start_line + 5] AS picked FROM {name}_lines",
        f"{name}_made": _SUMMARY.format("path, anchor, ", f"{name}_picked"),
    }


_EXPLICIT = _HEADS | {"hs": _SUMMARY.format("path, ", "h"), "c1": "SELECT request_id, path, start_line, end_line, 12.0::DOUBLE AS score, 'explicit_path' AS source, content, source_chars FROM pp JOIN hs USING (path)"}
_LEXICAL = _bm25("asked") | _fragments() | {"lx": "SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, path) AS rank FROM mg QUALIFY rank <= 32"} | _anchored("lex", "SELECT request_id, path, line AS anchor, score + 4.0 AS score FROM lx WHERE rank <= 24") | {"c2": "SELECT request_id, path, start_line, end_line, round(score, 4) AS score, 'search' AS source, content, source_chars FROM lex_wanted JOIN lex_made USING (path, anchor)"}
_BY_SYMBOL = _SYMBOLS | _anchored("sym", "SELECT request_id, path, line_start::INT AS anchor, 8.0::DOUBLE AS score FROM sr WHERE rank <= 8") | {"c3": "SELECT request_id, path, start_line, end_line, score, 'symbol_index' AS source, content, source_chars FROM sym_wanted JOIN sym_made USING (path, anchor)"}
_OLD_NAMES = "rq|tk|dl|tot|tf|df|part|hit|ranked"
_STEMS = {k: re.sub(r"\bfiles\b", "tfiles", v) for k, v in ((re.sub(f"^({_OLD_NAMES})$", r"t_\1", n), re.sub(rf"\b({_OLD_NAMES})\b", r"t_\1", q)) for n, q in _bm25("stems").items())}
_OWNERS = {
    "src": "SELECT request_id, place, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM pp WHERE NOT regexp_matches(path, '^tests?/')",
    "stems": "SELECT DISTINCT stem AS request_id, stem AS prompt FROM src", "tfiles": "SELECT * FROM files WHERE regexp_matches(path, '^tests?/')",
} | _STEMS | {
    "tx": "SELECT r.request_id AS stem, r.path, CAST(r.score AS DECIMAL(18,6)) AS base, " + _terms("r.request_id", 8) + " AS ts, lower(path || chr(10) || content) AS h, fl.ls, content FROM t_ranked r JOIN tfiles USING (path) JOIN filelines fl USING (path) WHERE rank <= {n}",
    "ty": "SELECT *, coalesce(left(" + _STRIP.format("ls[nullif(list_position(list_transform(ls, lambda l: len(list_filter(ts, lambda t: contains(lower(l), t))) > 0), true), 0)]") + ", 240), path) AS excerpt FROM tx",
    "tz": "SELECT stem, path, row_number() OVER (PARTITION BY stem ORDER BY round(base + CAST(0.25 * (8 * len(list_filter(ts, lambda t: contains(lower(path), t))) + 4 * len(list_filter(ts, lambda t: contains(lower(excerpt), t))) + 10 * len(list_filter(ts, lambda t: contains(h, t))) + least(8, list_sum(list_transform(ts, lambda t: (length(h) - length(replace(h, t, ''))) // length(t))))) AS DECIMAL(18,2)), 4) DESC, path) AS pos FROM ty",
    "ow0": "SELECT request_id, 0 AS kind, place, unnest([0, 1, 2, 3]) AS pos, unnest(['tests/test_' || stem || '.py', 'test/test_' || stem || '.py', 'tests/' || stem || '_test.py', 'test/' || stem || '_test.py']) AS path FROM src UNION ALL SELECT request_id, 1, place, pos, path FROM src JOIN tz USING (stem)",
    "ow1": "SELECT request_id, path, min({'k': kind, 's': place, 'a': pos}) AS pos FROM ow0 WHERE path IN (SELECT path FROM files) GROUP BY ALL",
    "ow": "SELECT request_id, path, row_number() OVER (PARTITION BY request_id ORDER BY pos, path) AS place, CASE WHEN pos.k = 0 THEN 'high' ELSE 'medium' END AS confidence FROM ow1 QUALIFY place <= {n}",
}


def _owners(n: int) -> dict[str, str]:
    return {k: v.replace("{n}", str(n)) for k, v in _OWNERS.items()}


_BY_OWNER = _owners(8) | _anchored("own", "SELECT request_id, path, 1 AS anchor, 10.0::DOUBLE AS score FROM ow WHERE (request_id, path) NOT IN (SELECT (request_id, path) FROM c1 UNION ALL SELECT (request_id, path) FROM c2 UNION ALL SELECT (request_id, path) FROM c3)") | {"c4": "SELECT request_id, path, start_line, end_line, score, 'test_impact' AS source, content, source_chars FROM own_wanted JOIN own_made USING (path, anchor)"}
_ROUTE_TERMS, _ROUTE = _route_sql("prompt")
_TESTED = "route IN ('coding', 'review', 'debug', 'test')"
_RANKED = {
    "ab": f"SELECT request_id, {_ROUTE_TERMS} AS ts, {_TERMS8} AS terms FROM asked", "ar": f"SELECT request_id, terms, {_ROUTE} AS route FROM ab",
    "c": "SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4",
    "cr": f"SELECT c.* EXCLUDE (score), route, round(score + CASE WHEN (request_id, path) IN (SELECT (request_id, path) FROM pp) THEN 6.0 ELSE 0 END + CASE WHEN source = 'test_impact' THEN CASE WHEN {_TESTED} THEN 4.0 ELSE 1.0 END ELSE 0 END + CASE WHEN regexp_matches(path, '^tests?/') AND {_TESTED} THEN 2.0 ELSE 0 END + CASE WHEN route = 'docs' AND regexp_matches(lower(path), '^(readme|docs/)') THEN 5.0 ELSE 0 END + CASE WHEN route = 'security' AND regexp_matches(lower(path), 'auth|security|secret|token|config|path') THEN 3.0 ELSE 0 END + CASE WHEN len(list_filter(terms, lambda t: contains(lower(path), t))) > 0 THEN 1.0 ELSE 0 END, 4) AS score FROM c JOIN ar USING (request_id)",
}


def _cut(profile: str) -> dict[str, str]:
    explicit, other = assemble.PROFILES[profile]
    return {"cp": "SELECT * EXCLUDE (content), CASE WHEN source = 'explicit_path' THEN " + _TRIM.format("content", explicit, explicit - 15) + " ELSE " + _TRIM.format("content", other, other - 15) + " END AS content FROM cr"}


_ALL = _BASE | _EXPLICIT | _LEXICAL | _BY_SYMBOL | _BY_OWNER | _RANKED
# the order of equal scores: path, range, length; what is equal in those is alike for the selection
_PLACES = {"oc": "SELECT *, length(content) AS chars, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, path, start_line, end_line, length(content)) AS place FROM cp"}


def _sql(ctes, query, recursive=False):
    return with_tables(ctes=ctes, query=query, recursive=recursive)


def _tables(s, d):
    files = D.pack_files(s, d)
    # many steps read the symbols: the files are searched for them once
    symbols = stage.kept_once(s, f"{d} pack symbols", lambda: extract.generic_symbols(files))
    return files, symbols, stage.kept_once(s, f"{d} pack requests", lambda: D.pack_requests(s, d))


def _index(s, d):
    return index.index_of(s, f"{d} with tests", lambda: D.pack_files(s, d))


def _flat(df):
    return df.select("request_id", "path", "start_line", "end_line", "score", "source", F.md5("content").alias("h"), "source_chars")


_FLAT = "SELECT request_id, path, start_line, end_line, score, source, md5(content) AS h, source_chars FROM "


@add("p12_prompt_paths", _sql(_BASE, "SELECT request_id, place, path FROM pp"))
def _(s, d):
    return assemble.prompt_paths(D.pack_requests(s, d), D.pack_files(s, d))


@add("c01_explicit", _sql(_BASE | _EXPLICIT, _FLAT + "c1"))
def _(s, d):
    files, symbols, requests = _tables(s, d)
    return _flat(assemble.explicit_candidates(files, symbols, assemble.prompt_paths(requests, files))[0])


@add("c01_unreadable", _sql(_BASE, "SELECT request_id, path, 'unreadable_explicit_path' AS reason_code FROM pp WHERE path NOT IN (SELECT path FROM files)"))
def _(s, d):
    files, symbols, requests = _tables(s, d)
    return assemble.explicit_candidates(files, symbols, assemble.prompt_paths(requests, files))[1]


@add("c02_lexical", _sql(_BASE | _LEXICAL, _FLAT + "c2"))
def _(s, d):
    files, symbols, requests = _tables(s, d)
    return _flat(assemble.lexical_candidates(files, symbols, assemble.lexical_hits(files, requests, MAX_ITEMS, _index(s, d)), "normal", MAX_ITEMS)[0])


@add("c03_symbols", _sql(_BASE | _BY_SYMBOL, _FLAT + "c3"))
def _(s, d):
    files, symbols, requests = _tables(s, d)
    none = requests.select("request_id", F.lit("").alias("path")).limit(0)
    return _flat(assemble.symbol_candidates(files, symbols, requests, none, "normal", MAX_ITEMS)[0])


@add("c03_early_stop", _sql(_BASE | _EXPLICIT | _LEXICAL, "SELECT request_id FROM (SELECT request_id, path FROM c1 UNION ALL SELECT request_id, path FROM lx WHERE rank <= 16) GROUP BY 1 HAVING count(*) >= 16 AND count(DISTINCT path) >= 8"))
def _(s, d):
    files, symbols, requests = _tables(s, d)
    before = assemble.explicit_candidates(files, symbols, assemble.prompt_paths(requests, files))[0].unionByName(assemble.lexical_candidates(files, symbols, assemble.lexical_hits(files, requests, MAX_ITEMS, _index(s, d)), "minimal", MAX_ITEMS)[0])
    return assemble.symbol_candidates(files, symbols, requests, before, "minimal", MAX_ITEMS)[1].select("request_id")


@add("r12_searched_owners", _sql(_BASE | _owners(10), "SELECT request_id, place, path, confidence FROM ow"))
def _(s, d):
    files, _, requests = _tables(s, d)
    return assemble.owner_paths(assemble.prompt_paths(requests, files), files, 10)


@add("r13_impact", _sql(_BASE | _owners(10) | _SYMBOLS | {
    "rl": "SELECT DISTINCT s.path, s.name, s.line_start, a.request_id FROM asked a JOIN sy s ON contains(lower(concat_ws(' ', s.path, s.name, s.signature)), 'doc_' || a.request_id) QUALIFY row_number() OVER (PARTITION BY a.request_id ORDER BY s.path, s.line_start, s.name) <= 40",
    "rs": "SELECT request_id, path, name, row_number() OVER (PARTITION BY request_id ORDER BY path, line_start, name) AS pos FROM rl JOIN asked USING (request_id) WHERE path = p1 OR regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) = regexp_extract(p1, '([^/]+?)(\\.[^./]*)?$', 1)",
    "u": "SELECT request_id, 0 AS k, place AS pos, path, 'test_owner' AS relationship FROM ow UNION ALL SELECT request_id, 1, pos, path, 'related_symbol' FROM rs WHERE pos <= 10",
}, "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY k, pos) AS place, path, relationship FROM u QUALIFY place <= 10"))
def _(s, d):
    files, symbols, requests = _tables(s, d)
    owners = assemble.owner_paths(assemble.prompt_paths(requests, files), files, 10)
    targets = requests.select("request_id", F.col("changed_files")[0].alias("path"))
    hits = lookup.first_symbol_hits(symbols, targets.select("request_id", F.concat(F.lit("doc_"), "request_id").alias("term")), 40).drop("rank")
    return assemble.impact(owners, lookup.related_symbols(targets, hits, 10), 10)


@add("r14_manual_baseline", _sql(_BASE | _LEXICAL | {
    "rd0": "SELECT request_id, p1 AS path, 0 AS k, 0 AS pos FROM asked UNION ALL SELECT request_id, path, 1, rank FROM lx WHERE rank <= 8",
    "rd": "SELECT DISTINCT request_id, path FROM rd0",
    "tk8": "SELECT request_id, greatest(1, (length(" + _TRIM.format("content", 1200, 1185) + ") + length(path) + 3) // 4) AS tokens FROM rd JOIN files USING (path)",
}, "SELECT request_id, count(*) AS reads, sum(tokens)::BIGINT AS tokens FROM tk8 GROUP BY 1"))
def _(s, d):
    files, _, requests = _tables(s, d)
    return assemble.manual_baseline(files, requests.select("request_id", F.col("changed_files")[0].alias("path")), assemble.lexical_hits(files, requests, MAX_ITEMS, _index(s, d)).where(F.col("rank") <= MAX_ITEMS))


@add("c04_owner_candidates", _sql(_BASE | _EXPLICIT | _LEXICAL | _BY_SYMBOL | _BY_OWNER, _FLAT + "c4"))
def _(s, d):
    return _flat(assemble.candidates(*_tables(s, d), "normal", MAX_ITEMS, index=_index(s, d))["candidates"].where("source = 'test_impact'").withColumn("score", F.lit(10.0)))


@add("c06_ranked_candidates", _sql(_ALL, "SELECT request_id, path, start_line, end_line, score, round(least(0.99, greatest(0.1, score / 18.0)), 3) AS confidence, source, md5(content) AS h, source_chars FROM cr"))
def _(s, d):
    return assemble.candidates(*_tables(s, d), "normal", MAX_ITEMS, index=_index(s, d))["candidates"].select("request_id", "path", "start_line", "end_line", "score", "confidence", "source", F.md5("content").alias("h"), "source_chars")


@add("p08_profiles", _sql(_ALL | _cut("lean"), "SELECT request_id, path, start_line, score, source, md5(content) AS h, length(content) AS raw_chars, greatest(0, source_chars - length(content)) AS deferred_chars FROM cp"))
def _(s, d):
    made = assemble.candidates(*_tables(s, d), "normal", MAX_ITEMS, index=_index(s, d))
    return assemble.profiled(made["candidates"], "lean").select("request_id", "path", "start_line", "score", "source", F.md5("content").alias("h"), "raw_chars", "deferred_chars")


@add("c09_plan_stats", _sql(_ALL | {"z": "SELECT request_id, count(*) AS n, count(*) FILTER (source = 'explicit_path') AS e, count(*) FILTER (source = 'search') AS l, count(*) FILTER (source = 'symbol_index') AS y, count(*) FILTER (source = 'test_impact') AS t FROM cr GROUP BY 1"}, "SELECT request_id, (SELECT count(*) FROM pp WHERE pp.request_id = a.request_id) AS explicit_path_count, coalesce(e, 0) AS explicit_summary_count, 32 AS search_limit, (SELECT count(*) FROM lx WHERE lx.request_id = a.request_id) AS search_result_count, least(24, (SELECT count(*) FROM lx WHERE lx.request_id = a.request_id)) AS search_summary_limit, coalesce(l, 0) AS search_summary_count, 8 AS symbol_limit, coalesce(y, 0) AS symbol_summary_count, false AS symbol_lookup_skipped, (SELECT count(*) FROM ow WHERE ow.request_id = a.request_id) AS test_owner_path_count, coalesce(t, 0) AS test_owner_summary_count FROM asked a LEFT JOIN z USING (request_id)"))
def _(s, d):
    files, symbols, requests = _tables(s, d)
    return assemble.plan_stats(assemble.candidates(files, symbols, requests, "normal", MAX_ITEMS, index=_index(s, d)), requests, "normal", MAX_ITEMS).drop("source_counts")


@add("c14_packs", _sql(_ALL | _cut("normal") | _PLACES | selection_sql(MAX_ITEMS, 3600, 2) | {
    "om": "SELECT request_id, path, 'unreadable_explicit_path' AS reason FROM pp WHERE path NOT IN (SELECT path FROM files) UNION ALL SELECT request_id, NULL, 'search_summary_limit' FROM lx GROUP BY 1 HAVING count(*) > 24 UNION ALL SELECT request_id, path, outcome FROM chosen WHERE outcome <> 'selected'",
    "ev": "SELECT request_id, greatest(1, (sum(length(to_json({'content': content, 'end_line': end_line, 'path': path, 'start_line': start_line})) + 1) + 4) // 4) + (sum(greatest(0, source_chars - length(content))) + 3) // 4 AS tokens FROM cp GROUP BY 1",
}, "SELECT a.request_id, route, array_to_string(terms, ' ') AS terms, (SELECT string_agg(place || ' ' || path || ':' || start_line || ' ' || score, '; ' ORDER BY place) FROM chosen c WHERE c.request_id = a.request_id AND outcome = 'selected') AS items, (SELECT string_agg(coalesce(path, '') || ' ' || reason, '; ' ORDER BY coalesce(path, ''), reason) FROM om WHERE om.request_id = a.request_id) AS omitted, (SELECT count(*) FROM cr WHERE cr.request_id = a.request_id) AS candidate_count, (SELECT tokens FROM ev WHERE ev.request_id = a.request_id)::BIGINT AS baseline_tokens FROM asked a JOIN ar USING (request_id)", recursive=True))
def _(s, d):
    files, symbols, requests = _tables(s, d)
    rows = assemble.packs(assemble.candidates(files, symbols, requests, "normal", MAX_ITEMS, index=_index(s, d)), requests, "normal", MAX_ITEMS)
    item = lambda x: F.concat(x["place"].cast("string"), F.lit(" "), x["path"], F.lit(":"), x["start_line"].cast("string"), F.lit(" "), x["score"].cast("string"))
    left = lambda x: F.concat(F.coalesce(x["path"], F.lit("")), F.lit(" "), x["reason_code"])
    return rows.select("request_id", "route", F.array_join("terms", " ").alias("terms"), F.array_join(F.transform("items", item), "; ").alias("items"), F.array_join(F.array_sort(F.transform("omitted", left)), "; ").alias("omitted"), "candidate_count", "baseline_tokens")


@add("p09_minimal_items", _sql(_ALL | _cut("minimal") | _PLACES | selection_sql(4, 1300, 1), "SELECT request_id, place AS rank, path, start_line, end_line, source, CASE WHEN greatest(score / 14, least(0.99, greatest(0.1, score / 18.0))) >= 0.8 THEN 'high' WHEN greatest(score / 14, least(0.99, greatest(0.1, score / 18.0))) >= 0.45 THEN 'medium' ELSE 'low' END AS confidence, md5(content) AS h FROM chosen WHERE outcome = 'selected'", recursive=True))
def _(s, d):
    made = assemble.candidates(*_tables(s, d), "normal", MAX_ITEMS, index=_index(s, d))
    chosen = pack.select_rows(assemble.profiled(made["candidates"], "minimal"), 4, 1300, 1).where("outcome = 'selected'").withColumnRenamed("place", "rank")
    items = assemble.minimal_items(chosen).join(chosen.select("request_id", "rank", "source"), ["request_id", "rank"])
    return items.select("request_id", "rank", "path", F.col("lines")[0].alias("start_line"), F.col("lines")[1].alias("end_line"), "source", "confidence", F.md5("content").alias("h"))
