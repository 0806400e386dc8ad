"""Queries of whole packs, their projections and state rows, and the SQL that checks them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble, respond
from ..sources import derived as D
from ..sources.derived import with_tables
from .packs import _ALL, _PLACES, MAX_ITEMS, _cut, _index, _tables
from .registry import _SKILLS, _TRIM, add, selection_sql

# Memory of the workspace, of routes and of sessions, from the conversations' turns.
_NAMESPACE = "case conv_id % 5 when 0 then 'workspace' when 1 then 'route/' || ({0})[cast(conv_id {1} 5 % 3{2} as int)] else 'session/s' || conv_id % 9 end"
_MEMORY = {
    "mem": "SELECT conv_id * 1000 + turn AS seq, " + _NAMESPACE.format("['general', 'coding', 'security']", "//", " + 1") + " AS namespace, 't' || turn AS key, text AS value, conv_id % 2 AS kind FROM conversations",
    "cut": "SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY kind, namespace ORDER BY seq) <= 2",
    "spaces": "SELECT request_id, route, unnest([0, 1, 2]) AS pos, unnest(['workspace', 'route/' || route, 'session/' || CASE WHEN request_id % 4 = 0 THEN 'default' ELSE 's' || request_id % 9 END]) AS namespace FROM ar",
    "memo": "SELECT request_id, count(*) FILTER (kind = 0) AS summary_count, count(*) FILTER (kind = 1) AS decision_count, string_agg(namespace || ' ' || key || ' ' || seq, ';' ORDER BY kind, pos, seq) AS shown FROM spaces JOIN cut USING (namespace) GROUP BY 1",
}


def _memory(s, d, requests):
    c = s.read.parquet(f"{d}/conversations.parquet")
    rows = c.selectExpr("conv_id * 1000 + turn as seq", _NAMESPACE.format("array('general', 'coding', 'security')", "div", "") + " as namespace", "'t' || turn as key", "text as value", "conv_id % 2 as kind")
    about = requests.select("request_id", T.route(F.col("prompt")).alias("route"), F.when(F.col("request_id") % 4 == 0, "").otherwise(F.concat(F.lit("s"), F.col("request_id") % 9)).alias("session"))
    return respond.memory_context(about, rows.where("kind = 0"), rows.where("kind = 1").withColumn("value", F.col("seq").cast("string")))


def _renamed(query: str) -> str:
    return re.sub(r"\b(sk|rq|m0|mt|m|x)\b(?!:)", r"k_\1", query)


_CARDS = {"k_sk": _SKILLS["sk"], "k_rq": "SELECT request_id, lower(prompt) AS prompt, terms AS ts, route FROM asked JOIN ar USING (request_id)", "k_m0": _renamed(_SKILLS["m0"]), "k_mt": _renamed(_SKILLS["mt"]), "k_m": _renamed(_SKILLS["m"]), "k_x": _renamed(_SKILLS["x"].replace("contains(h, 'coding')", "contains(h, route)")),
          "top": "SELECT request_id, skill_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, skill_id) AS rank FROM k_x WHERE score > 1.0 QUALIFY rank <= 3",
          "cards": "SELECT request_id, string_agg(regexp_replace(key, '[^A-Za-z0-9_.-]+', '-', 'g') || '-' || left(sha256(namespace || ':' || key), 8), ' ' ORDER BY rank) AS ids FROM top JOIN k_sk USING (skill_id) GROUP BY 1"}
_JSON = "length(to_json({'content': content, 'end_line': end_line, 'path': path, 'start_line': start_line})) + 1"


def _pack_sql(profile, items, budget, each):
    return _ALL | _cut(profile) | _PLACES | selection_sql(items, budget, each) | {"memory_log": D.SQL["memory_log"]} | _MEMORY | _CARDS | {
        "om": "SELECT request_id, path, 'unreadable_explicit_path' AS reason FROM pp WHERE path NOT IN (SELECT path FROM files) UNION ALL SELECT request_id, NULL, 'search_summary_limit' FROM lx GROUP BY 1 HAVING count(*) > 24 UNION ALL SELECT request_id, path, outcome FROM chosen WHERE outcome <> 'selected'",
        "ev": f"SELECT request_id, count(*) AS candidates, greatest(1, (sum({_JSON}) + 4) // 4) + (sum(greatest(0, source_chars - length(content))) + 3) // 4 AS tokens FROM cp GROUP BY 1",
        "sl0": f"SELECT request_id, count(*) AS n, greatest(1, (sum({_JSON}) + 4) // 4) AS tokens, list(path ORDER BY place) AS paths FROM chosen WHERE outcome = 'selected' GROUP BY 1",
        "w": "SELECT a.request_id, route, coalesce(n, 0) AS selected_count, coalesce(s.tokens, 1) AS output_tokens, greatest(coalesce(ev.tokens, 0), coalesce(s.tokens, 1)) AS baseline_tokens, coalesce(candidates, 0) AS candidate_count, paths, coalesce(o.n_omitted, 0) AS n_omitted, coalesce(summary_count, 0) AS summary_count, coalesce(decision_count, 0) AS decision_count, coalesce(shown, '') AS shown, coalesce(ids, '') AS cards FROM ar a LEFT JOIN sl0 s USING (request_id) LEFT JOIN ev USING (request_id) LEFT JOIN memo USING (request_id) LEFT JOIN cards USING (request_id) LEFT JOIN (SELECT request_id, count(*) AS n_omitted FROM om GROUP BY 1) o USING (request_id)",
    }


def _whole(s, d, profile="normal", items=MAX_ITEMS):
    """Packs of the requests with memory, cards and metrics."""
    files, symbols, requests = _tables(s, d)
    made = assemble.candidates(files, symbols, requests, "normal", MAX_ITEMS, index=_index(s, d))
    packs = assemble.packs(made, requests, profile, items)
    skills = D.memory_log(s, d).select(F.col("seq").alias("skill_id"), F.concat(F.lit("skills/"), "namespace").alias("namespace"), "key", "value", "confidence")
    guided = respond.skill_guidance(requests.select("request_id", "prompt", T.route(F.col("prompt")).alias("route")), skills)
    return respond.whole_packs(packs, _memory(s, d, requests), guided)


_FLAT_METRICS = "selected_count, candidate_count, baseline_tokens::BIGINT AS baseline_tokens, output_tokens::BIGINT AS output_tokens, greatest(0, baseline_tokens - output_tokens)::BIGINT AS tokens_saved, round(output_tokens / greatest(baseline_tokens, output_tokens, 1), 4)::DOUBLE AS compression_ratio, selected_count + CASE WHEN summary_count + decision_count > 0 THEN 1 ELSE 0 END + CASE WHEN n_omitted > 0 THEN 1 ELSE 0 END AS calls_saved"


def _metrics(df):
    return df.select("*", *[F.col(f"metrics.{c}").alias(c) for c in ("selected_count", "candidate_count", "baseline_tokens", "output_tokens", "tokens_saved", "compression_ratio", "calls_saved")])


@add("c14_whole_packs", with_tables(ctes=_pack_sql("normal", MAX_ITEMS, 3600, 2), query=f"SELECT request_id, route, {_FLAT_METRICS}, summary_count, decision_count, cards FROM w", recursive=True))
def _(s, d):
    rows = _metrics(_whole(s, d))
    return rows.select("request_id", "route", "selected_count", "candidate_count", "baseline_tokens", "output_tokens", "tokens_saved", "compression_ratio", "calls_saved", F.col("memory.summary_count").alias("summary_count"), F.col("memory.decision_count").alias("decision_count"), F.array_join(F.transform("skill_cards", lambda x: x["id"]), " ").alias("cards"))


@add("m09_pack_memory", with_tables(ctes=_ALL | _MEMORY, query="SELECT request_id, count(*) AS n, string_agg(namespace || ' ' || key, ';' ORDER BY kind, pos, seq) AS shown FROM spaces JOIN cut USING (namespace) GROUP BY 1"))
def _(s, d):
    rows = _memory(s, d, D.pack_requests(s, d)).select("request_id", F.concat("memory.summaries", "memory.effective_decisions").alias("xs")).where(F.size("xs") > 0)
    return rows.select("request_id", F.size("xs").cast("long").alias("n"), F.array_join(F.transform("xs", lambda x: F.concat(x["namespace"], F.lit(" "), x["key"])), ";").alias("shown"))


@add("p09_minimal_summary", with_tables(ctes=_pack_sql("minimal", 4, 4800, 1), query="SELECT request_id, CASE WHEN selected_count = 0 THEN route || ' context: no matching repository evidence selected.' ELSE route || ' context: top evidence in ' || array_to_string(paths[1:3], ', ') || '.' || CASE WHEN n_omitted > 0 THEN ' ' || n_omitted || ' lower-ranked items deferred.' ELSE '' END || CASE WHEN summary_count > 0 THEN ' Memory summaries available in diagnostics.' ELSE '' END END AS summary, selected_count::INT AS items FROM w", recursive=True))
def _(s, d):
    return respond.projected(_whole(s, d, "minimal", 4), "minimal").select("request_id", "summary", F.size("items").alias("items"))


_LEAN = {
    "lc": "SELECT c.request_id, place, path, content, terms, CASE WHEN source = 'explicit_path' THEN 180 ELSE 140 END AS most, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM (SELECT *, string_split_regex(content, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM chosen WHERE outcome = 'selected') c JOIN ar USING (request_id)",
    "ld": "SELECT *, list_filter(ls, lambda x: len(list_filter(terms, lambda t: contains(lower(x), t))) > 0) AS ch FROM lc",
    "le": "SELECT request_id, place, path, content, most, array_to_string(CASE WHEN len(ch) > 0 THEN ch ELSE ls[1:2] END, ' … ') AS c FROM ld",
}


@add("p10_lean_items", with_tables(ctes=_pack_sql("normal", MAX_ITEMS, 3600, 2) | _LEAN, query="SELECT request_id, path, md5(CASE WHEN length(content) <= most THEN content WHEN most = 180 THEN " + _TRIM.format("c", 180, 165) + " ELSE " + _TRIM.format("c", 140, 125) + " END) AS h FROM le", recursive=True))
def _(s, d):
    return respond.projected(_whole(s, d), "lean").select("request_id", F.explode("items").alias("x")).select("request_id", "x.path", F.md5("x.content").alias("h"))


_CACHE = "item_id AS request_id, item_id % 3 = 0 AS hit, 'k' || item_id AS key, 'reason' || item_id % 4 AS reason, item_id % 7 AS fragment_hits, item_id % 5 AS fragment_misses, 'private' AS debug"


@add("p11_projections", with_tables(ctes=_pack_sql("normal", MAX_ITEMS, 3600, 2) | {"ca": f"SELECT {_CACHE} FROM benchmark", "levels": "SELECT unnest(['none', 'compact', 'full']) AS diagnostics"}, query="SELECT request_id, diagnostics, selected_count, w.summary_count, hit, key, reason, fragment_hits, CASE WHEN diagnostics <> 'full' THEN coalesce(round(fragment_hits / nullif(fragment_hits + fragment_misses, 0), 4), 0.0) END::DOUBLE AS fragment_hit_ratio, CASE WHEN diagnostics <> 'none' THEN request_id % 11 END AS indexed, CASE WHEN diagnostics = 'full' THEN 'plan' || request_id END AS plan, CASE WHEN diagnostics = 'full' THEN debug END AS debug FROM w JOIN ca USING (request_id), levels", recursive=True))
def _(s, d):
    from ..operators.stage import kept

    whole = kept(_whole(s, d), "whole-packs")
    asked = s.read.parquet(f"{d}/benchmark.parquet")
    cache = asked.selectExpr(*[c.strip() for c in _CACHE.split(",")])
    details = asked.select(F.col("item_id").alias("request_id"), F.struct((F.col("item_id") % 11).alias("files")).alias("indexing"), F.struct(F.lit(0).alias("signals")).alias("safety"), F.concat(F.lit("plan"), "item_id").alias("retrieval_plan"))
    out = None
    for level in respond.DIAGNOSTICS:
        rows = _metrics(respond.projected(whole, "compact", level, cache, details))
        has = set(rows.columns)
        part = rows.select("request_id", F.lit(level).alias("diagnostics"), "selected_count", F.col("memory.summary_count").alias("summary_count"), "cache.hit", "cache.key", "cache.reason", "cache.fragment_hits", (F.col("cache.fragment_hit_ratio") if level != "full" else F.lit(None).cast("double")).alias("fragment_hit_ratio"),
                           (F.col("indexing.files") if "indexing" in has else F.lit(None).cast("long")).alias("indexed"), (F.col("retrieval_plan") if "retrieval_plan" in has else F.lit(None).cast("string")).alias("plan"), (F.col("cache.debug") if level == "full" else F.lit(None).cast("string")).alias("debug"))
        out = part if out is None else out.unionByName(part)
    return out


# Rows of a state: values of all kinds.
_KEY = "case doc_id % 4 when 0 then 'cache:' || lang || ':' || doc_id when 1 then 'index:file:' || doc_id when 2 then 'cache:' || doc_id else 'plain' || doc_id end"
_VALUE = """case doc_id % 7 when 0 then '[1,' || doc_id || ',"' || lang || '"]' when 1 then '"' || source || '"' when 2 then cast(doc_id as {text}) when 3 then 'true' when 4 then 'null' when 5 then '1.5'
    else '{open}"created_at":"' || if(doc_id % 3 = 0, '', '2024-01-' || lpad(cast(doc_id % 28 + 1 as {text}), 2, '0') || 'T00:00:00Z') || '","namespace":"' || if(doc_id % 5 = 0, lang, '') || '","schema":"' || source || '.v1","status":"active","updated_at":"2023-05-0' || (doc_id % 9 + 1) || 'T00:00:00Z"{close}' end"""
_STATE = {
    "st": "SELECT " + _KEY + " AS key, " + _VALUE.format(text="VARCHAR", open="{", close="}") + " AS value FROM documents",
    "pv": "SELECT key, CASE left(value, 1) WHEN '{' THEN 'dict' WHEN '[' THEN 'list' WHEN '\"' THEN 'str' WHEN 't' THEN 'bool' WHEN 'n' THEN 'NoneType' ELSE CASE WHEN contains(value, '.') THEN 'float' ELSE 'int' END END AS value_type, length(value) AS size_chars, " + ", ".join(f"coalesce(CASE WHEN value LIKE '{{%' THEN json_extract_string(value, '$.{n}') END, '') AS {n}" for n in ("schema", "status", "created_at", "updated_at", "expires_at", "namespace")) + ", CASE WHEN length(value) <= 60 THEN value ELSE left(value, 46) || chr(10) || '...[truncated]' END AS preview FROM st",
}


def _previews(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").selectExpr(f"{_KEY} as key", _VALUE.format(text="string", open="{", close="}") + " as value")
    return respond.row_previews(rows, 60)


@add("k09_row_previews", with_tables(ctes=_STATE, query="SELECT * FROM pv"))
def _(s, d):
    return _previews(s, d)


@add("k10_row_search", with_tables(ctes=_STATE | {"cl": "SELECT *, CASE WHEN namespace <> '' THEN namespace WHEN starts_with(key, 'cache:') THEN CASE WHEN contains(key[7:], ':') THEN split_part(key[7:], ':', 1) ELSE 'cache' END WHEN contains(key, ':') THEN split_part(key, ':', 1) WHEN schema <> '' THEN split_part(schema, '.', 1) ELSE '-' END AS state_class FROM pv"}, query="SELECT key, state_class FROM cl WHERE contains(lower(concat_ws(' ', key, value_type, schema, status, namespace, created_at, updated_at, expires_at, preview, state_class)), 'src1') ORDER BY lower(state_class), coalesce(epoch(try_cast(nullif(created_at, '') AS TIMESTAMPTZ)), epoch(try_cast(nullif(updated_at, '') AS TIMESTAMPTZ)), 0) DESC, key LIMIT 50"))
def _(s, d):
    return respond.search_rows(_previews(s, d), "SRC1", 50).select("key", "state_class")
