"""Hot places, plans, freshness, miss reasons, memory and projections on small tables."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import entries, respond, warm

FILES = [("src/a.py", "one"), ("src/b.py", "two"), ("tests/test_a.py", "def test_a(): pass")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string")


def test_hot_targets_of_changed_files_vanish(spark, files):
    token = {r["path"]: r["t"] for r in files.select("path", warm.file_token(F.col("content")).alias("t")).collect()}
    rows = [(1, "src/a.py", 5, "coding", token["src/a.py"]), (2, "src/a.py", 5, "odd", token["src/a.py"]), (3, "src/b.py", None, "docs", "before"), (4, "gone.py", 1, "docs", None), (5, "src/b.py", 90, "docs", token["src/b.py"])]
    hot = warm.hot_chunks(spark.createDataFrame(rows, "seq long, path string, start_line int, route string, token string"))
    got = {(r["path"], r["anchor"], r["route"]): (r["selected_count"], r["last_seq"]) for r in hot.collect()}
    assert got == {("src/a.py", 5, "coding"): (2, 2), ("src/b.py", 1, "docs"): (1, 3), ("src/b.py", 90, "docs"): (1, 5)}
    live = warm.live_hot_targets(hot, files, "src", 10).collect()
    assert [(r["place"], r["path"], r["anchor"]) for r in live] == [(1, "src/a.py", 5), (2, "src/b.py", 90)]
    changed = files.withColumn("content", F.concat("content", F.lit("!")))
    assert warm.live_hot_targets(hot, changed, ".", 10).count() == 0


def test_owner_targets(spark, files):
    rows = [(1, k, p, "coding", 10 + k) for k, p in enumerate(["tests/test_a.py", "src/a.py", "src/b.py", "src/c.py"])] + [(2, 0, "src/a.py", "odd", 20)]
    owners = warm.test_owner_targets(spark.createDataFrame(rows, "pack_id long, rank int, path string, route string, seq long"), files)
    got = {r["source_path"]: (r["selected_count"], [t["path"] for t in r["targets"]]) for r in owners.collect()}
    assert got == {"src/a.py": (2, ["tests/test_a.py"])}
    assert [tuple(r)[:3] for r in warm.owner_summary_targets(owners, files, "src", 5).collect()] == [(1, "tests/test_a.py", 1)]


def test_plan_outcomes_and_coverage(spark, files):
    target = "array<struct<line_anchor:int,path:string,source:string>>"
    schema = f"request_id long, route string, prompt_terms array<string>, learned_route_seeds array<string>, paths array<struct<path:string,source:string>>, selected_targets {target}, request_memo_targets {target}"
    made = spark.createDataFrame([(1, "coding", ["alpha", "fix", "ALPHA", "bad", "beta", "gamma"], ["delta"], [("src/a.py", "changed_file"), ("gone.py", "focus_path")], [(3, "src/b.py", "selected_item")], [(3, "src/b.py", "search")])], schema)
    negative = spark.createDataFrame([("bad", "coding", "."), ("beta", "docs", ".")], "term string, route string, path_scope string")
    results = spark.createDataFrame([("alpha", 4), ("beta", 0), ("gamma", 1), ("delta", 2)], "term string, result_count int")
    none = spark.createDataFrame([], "place int, path string, anchor int")
    got = warm.plan_outcomes(made, warm.summary_targets(made, none, none), negative, results, files, 2)
    outcome = {(r["kind"], r["place"]): r["outcome"] for r in got.collect()}
    assert [outcome["term", k] for k in range(7)] == ["completed", "generic_term", "duplicate_term", "negative_term", "no_results", "entry_cap", "entry_cap"]
    assert [outcome["owner", k] for k in range(3)] == ["completed", "unavailable_path", "completed"]
    assert [outcome["summary", k] for k in range(3)] == ["completed", "unavailable_path", "request_memo"]
    row = warm.coverage(got).first()
    assert (row["planned"], row["completed"], row["skipped"], row["ratio"]) == (13, 4, 9, 0.3077)
    assert row["skip_reasons"]["entry_cap"] == 2 and sum(row["skip_reasons"].values()) == 9


def test_explicit_freshness(spark):
    listing = spark.createDataFrame([("src/a.py", 1, 1), ("src/b.py", 2, 2), ("build/x.py", 1, 1)], "path string, size long, mtime_ns long")
    indexed = spark.createDataFrame([("src/a.py", 1, 1), ("src/b.py", 2, 1), ("build/x.py", 1, 1)], "path string, size long, mtime_ns long")
    asked = spark.createDataFrame([(1, p) for p in ("src/a.py", "src/b.py", "gone.py", "../x", "src", "build/x.py")], "request_id long, path string")
    outcome = lambda *a: {r["path"]: r["outcome"] for r in warm.explicit_freshness(asked, listing, indexed, *a).collect()}
    assert outcome() == {"src/a.py": "skipped", "src/b.py": "refreshed", "gone.py": "failed", "../x": "failed", "src": "refreshed", "build/x.py": "refreshed"}
    assert outcome(True)["src"] == "skipped" and outcome(False, True)["src/a.py"] == "refreshed"
    row = warm.freshness_counts(warm.explicit_freshness(asked, listing, indexed)).first()
    assert (row["path_count"], row["refreshed_count"], row["skipped_count"], row["failed_count"]) == (6, 3, 1, 2)


def test_each_facet_of_a_miss(spark):
    schema = "namespace string, schema_version int, refresh_signature string, explicit_paths array<string>, path string, cache_token string, chunk_id string, include_globs array<string>, terms_key string, term string, allow_fallback boolean, backend_version string, pool_size int"
    held = ("n", 2, "s", ["a"], "p", "t", "c", ["*"], "k", "w", True, "b", 40)
    other = ("n", 1, "old", ["z"], "q", "u", "d", ["!"], "l", "x", False, "a", 10)
    names = [f.split()[0] for f in schema.split(", ")]
    wrong = dict(explicit_paths=["z"], path="q", cache_token="u", chunk_id="d", include_globs=["!"], terms_key="l", term="x", allow_fallback=False, backend_version="a", pool_size=10)
    cases = [("m", dict(namespace="other"), "no_compatible_entry"), ("m", dict(schema_version=3), "schema_version_changed"), ("m", dict(refresh_signature="none"), "index_changed"), ("m", {}, "no_compatible_entry"), ("m", dict(refresh_signature="", path="q"), "no_compatible_entry")]
    cases += [("m", {n: wrong[n]}, r) for n, r in warm.FACETS[1:]] + [("m", dict(path="q", pool_size=10), "path_changed")]
    rows = [(k, *[{**dict(zip(names, held, strict=True)), **change}[n] for n in names]) for k, (_, change, _) in enumerate(cases)]
    got = {r["miss_id"]: r["reason"] for r in warm.miss_reasons(spark.createDataFrame(rows, f"miss_id long, {schema}"), spark.createDataFrame([held, other], schema)).collect()}
    assert got == {k: reason for k, (_, _, reason) in enumerate(cases)}


def test_entry_status_rules(spark):
    schema = "key string, namespace string, schema_version int, signature string, invalidated boolean, ttl_left_days int, backend string"
    rows = [("a", "ns0", 2, "s", False, 1, "b1"), ("b", "ns0", 2, "s", True, 1, "b1"), ("c", "ns3", 2, "s", False, 1, "b1"), ("d", "ns1", 1, "s", False, 1, ""), ("e", "ns1", 2, "", False, 1, ""), ("f", "ns0", 2, "s", False, 1, ""), ("g", "ns0", 2, "s", False, 1, "b0"), ("h", "ns1", 2, "s", False, -1, ""), ("i", None, 0, "", False, 1, None)]
    got = {r["key"]: r["reason"] for r in entries.with_status(spark.createDataFrame(rows, schema)).collect()}
    assert list(got.values()) == ["active", "invalidated", "unsupported_namespace", "legacy_schema", "signature_missing", "backend_missing", "backend_changed", "expired", "active"]


def test_memory_of_a_pack(spark):
    rows = spark.createDataFrame([(n, s, f"k{s}", "v") for n in ("workspace", "route/docs", "session/default", "session/x") for s in range(4)], "namespace string, seq long, key string, value string")
    asked = spark.createDataFrame([(1, "docs", ""), (2, "coding", "x"), (3, "none", None)], "request_id long, route string, session string")
    got = {r["request_id"]: r["memory"] for r in respond.memory_context(asked, rows, rows.where("namespace = 'workspace'")).collect()}
    assert [(s["namespace"], s["key"]) for s in got[1]["summaries"]] == [(n, k) for n in ("workspace", "route/docs", "session/default") for k in ("k0", "k1")]
    assert got[2]["summary_count"] == 4 and got[2]["decision_count"] == 2 and got[3]["summary_count"] == 4


def test_state_rows(spark):
    rows = spark.createDataFrame([("cache:one:x", '{"status":"active","created_at":"2024-01-02T00:00:00Z"}'), ("cache:two", "[1,2]"), ("plain", '"token=abcdefgh12345 and more text to cut"'), ("a:b", "null")], "key string, value string")
    seen = respond.row_previews(rows, 20)
    got = {r["key"]: r for r in seen.collect()}
    assert [got[k]["value_type"] for k in ("cache:one:x", "cache:two", "plain", "a:b")] == ["dict", "list", "str", "NoneType"]
    assert "abcdefgh" not in got["plain"]["preview"] and got["plain"]["preview"].endswith("...[truncated]")
    assert [(r["key"], r["state_class"]) for r in respond.search_rows(seen, "", 9).collect()] == [("plain", "-"), ("a:b", "a"), ("cache:two", "cache"), ("cache:one:x", "one")]
