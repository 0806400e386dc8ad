"""Memory writes, projects, globs and URIs against plain Python on small tables."""

import datetime as dt
import fnmatch
import posixpath
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import corpus, lookup, memory, projects, retrieve
from gleaner.operators.index import write_index
from gleaner.sources.project_state import ProjectState

WRITES = "seq long, namespace string, key string, value string, confidence double, source string, tags array<string>, ttl_days int, written_at timestamp"
DAY = dt.datetime(2024, 1, 1)


def _write(seq, namespace="n", key="k", value="v", confidence=0.5, source="cli", tags=None, ttl=None):
    return (seq, namespace, key, value, confidence, source, tags, ttl, DAY + dt.timedelta(days=seq))


def test_upserts_keep_the_first_time_and_the_last_value(spark):
    rows = [
        _write(1, value="first", tags=["a"]), _write(2, namespace=" n ", value="password=hunter2secret", ttl=3), _write(3, confidence=1.5), _write(4, confidence=float("nan")), _write(5, namespace=None),
        _write(6, key="  "), _write(7, key="token=abcdef123456"), _write(8, key="bare", value=None, confidence=None, source=None), _write(9, namespace="api_key=abcdef123456"),
    ]
    stored, rejected = memory.upserts(spark.createDataFrame(rows, WRITES))
    got = {r["key"]: r for r in stored.collect()}
    assert set(got) == {"k", "bare"}
    k = got["k"]
    assert (k["seq"], k["first_seq"], k["namespace"], k["value"], k["tags"]) == (2, 1, "n", "[REDACTED_SECRET_1]", [])
    assert (k["created_at"], k["updated_at"], k["expires_at"]) == (DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=2), DAY + dt.timedelta(days=5))
    assert k["redacted"] and k["categories"] == ["secret_pattern_1"]
    bare = got["bare"]
    assert (bare["value"], bare["confidence"], bare["source"], bare["expires_at"], bare["redacted"]) == (None, 1.0, "agent", None, False)
    assert {r["seq"]: r["reason"] for r in rejected.collect()} == {3: "confidence_out_of_range", 4: "confidence_out_of_range", 5: "missing_namespace", 6: "missing_key", 7: "sensitive_key", 9: "sensitive_namespace"}


def test_upserts_of_nothing(spark):
    stored, rejected = memory.upserts(spark.createDataFrame([], WRITES))
    assert stored.count() == 0 and rejected.count() == 0


def test_summaries_take_any_confidence(spark):
    rows = spark.createDataFrame([_write(1, confidence=7.0)], WRITES).withColumnsRenamed({"key": "focus", "value": "summary"})
    stored, rejected = memory.summary_upserts(rows)
    assert [r["confidence"] for r in stored.collect()] == [7.0] and rejected.count() == 0


def test_get_gives_three_kinds(spark):
    facts, _ = memory.upserts(spark.createDataFrame([_write(1, key="a"), _write(2, key="b"), _write(3, key="a"), _write(4, key="c", ttl=1), _write(5, key="d")], WRITES))
    summaries, _ = memory.summary_upserts(spark.createDataFrame([_write(6, key="s")], WRITES).withColumnsRenamed({"key": "focus", "value": "summary"}))
    said = [(1, "n", "t", "llm", 0.9, DAY, None), (2, "n", "t", "human", 0.1, DAY, None), (3, "n", "u", "llm", 0.9, DAY, DAY), (4, "n", "w", "llm", 0.9, DAY, None), (5, "n", "w", "llm", 0.9, DAY, None)]
    decisions = spark.createDataFrame(said, "seq long, namespace string, topic string, decided_by string, confidence double, updated_at timestamp, expires_at timestamp")
    as_of = F.lit(DAY + dt.timedelta(days=30))
    rows = memory.get(facts, summaries, decisions, as_of, most=2)
    assert sorted((r["kind"], r["place"], r["name"], r["seq"]) for r in rows.collect()) == [("decision", 1, "t", 2), ("decision", 2, "w", 4), ("fact", 1, "a", 3), ("fact", 2, "b", 2), ("summary", 1, "s", 6)]
    everything = memory.get(facts, summaries, decisions, as_of, include_expired=True).collect()
    assert sorted(r["name"] for r in everything if r["expired"]) == ["c", "u"]


def test_compaction_becomes_a_summary(spark):
    log = spark.createDataFrame([(k, "n", f"key{k:02d}", "x" * 200, k / 100, DAY) for k in range(41)] + [(50, "few", "k", "v", 1.0, DAY)], "seq long, namespace string, key string, value string, confidence double, written_at timestamp")
    stored, _ = memory.summary_upserts(memory.compaction_writes(log, F.lit(DAY)))
    [row] = stored.collect()
    best = "\n".join(f"- key{k:02d}: {'x' * 160}" for k in range(40, 28, -1))[:1200]
    assert (row["namespace"], row["focus"], row["confidence"], row["summary"], row["expires_at"]) == ("n", "auto_compact", 0.9, best, DAY + dt.timedelta(days=60))


def _normal(path):
    out = posixpath.normpath(path.replace("\\", "/"))
    return (out if out.startswith("/") else "/" + out).rstrip("/") or "/"


def _plain_uri(uri):
    raw = uri.strip()
    parts = urlparse(raw)
    if not parts.scheme:
        return "file://" + quote(_normal(raw)) if raw.startswith("/") else None
    if parts.scheme != "file" or parts.netloc not in ("", "localhost"):
        return None
    return "file://" + quote(_normal(unquote(parts.path)))


def test_uris_as_the_standard_library(spark):
    uris = ["file:///a/b", " file://localhost/a/./b/../c/ ", "FILE:///x", "http://a/b", "file://host/a", "/a//b", "a/b", "", "file:///a%20b/%2e%2e/c+d", "file:///50%/x%zz", "file:///%C3%A9/~*()!'", "file:///a?q=1#f", "file:///a#f?q", "file:///../..", "file:///a\\b", "file:////two//b", "file:a/../../b", "file://", "/q?x", "/é \U0001f600"]
    got = spark.createDataFrame([(u,) for u in [*uris, None]], "u string").select("u", T.canonical_uri(F.col("u")).alias("c")).collect()
    fixed = {"/q?x": "file:///q%3Fx"}  # a path without a scheme is taken whole
    for r in got:
        want = None if r["u"] is None else fixed.get(r["u"], _plain_uri(r["u"]))
        assert r["c"] == want, r["u"]


def test_globs_as_the_standard_library(spark):
    globs = ["*.py", "src/*", "doc_[0-9].txt", "doc_[!0-4].txt", "a?c", "[zz", "a+b(c).{d}", "*", "", "x[*?]y", "a&&b", "$^|", "[a-c]*"]
    paths = ["a.py", "src/x/y.py", "doc_3.txt", "doc_7.txt", "abc", "a/c", "[zz", "a+b(c).{d}", "", "x*y", "x?y", "xay", "a&&b", "$^|", "c\nd", "b"]
    rows = spark.createDataFrame([(g, p) for g in globs for p in paths], "g string, p string")
    for r in rows.select("g", "p", F.regexp_like("p", corpus.glob_pattern(F.col("g"))).alias("m")).collect():
        assert r["m"] == fnmatch.fnmatchcase(r["p"], r["g"]), (r["g"], r["p"])


def test_bounds_come_before_the_cut(spark, tmp_path):
    files = spark.createDataFrame([(f"{'in' if k == 7 else 'out'}/f{k}.txt", "alpha " * (20 - k) + "beta") for k in range(10)], "path string, content string")
    index = write_index(files, f"{tmp_path}/index")
    requests = spark.createDataFrame([(1, "alpha"), (2, "alpha"), (3, "alpha")], "request_id long, prompt string")
    scopes = spark.createDataFrame([(1, "in/", None), (2, ".", ["out/f[12].txt"])], "request_id long, scope string, globs array<string>")
    got = {}
    for r in retrieve.scoped_search(scopes, requests, 2, index).collect():
        got.setdefault(r["request_id"], set()).add(r["path"])
    assert got[1] == {"in/f7.txt"} and got[2] == {"out/f1.txt", "out/f2.txt"} and len(got[3]) == 2


def test_projects_under_scan_roots(spark):
    listing = ["w/.git/HEAD", "w/a/pyproject.toml", "w/a/sub/pyproject.toml", "w/.dot/pyproject.toml", "w/b/c/.git", "w/1/2/3/4/5/pyproject.toml", "v/.git/HEAD", "v/x.txt", "w2/pyproject.toml", "w2/k/.git/HEAD", "none.txt"]
    roots = spark.createDataFrame([(1, "w", True), (2, "v", True), (3, "w2", True), (4, "w/b", False)], "pos int, root string, mapped boolean")
    paths = spark.createDataFrame([(p,) for p in listing], "path string")
    got = [(r["scan_root"], r["root"], r["origin"]) for r in projects.discover_under(paths, roots, [".git", "pyproject.toml"]).collect()]
    assert got == [("w", "w/a", "discovered_marker"), ("w", "w/b/c", "discovered_git"), ("v", "v", "discovered_git"), ("w2", "w2", "discovered_marker")]
    assert projects.discover_under(paths, roots, [".git", "pyproject.toml"], most=1).count() == 1


def test_requests_find_their_project(spark):
    asked = [(1, "file:///r/../s p", None, None), (2, "ftp://x", "p1", None), (3, None, "p1", None), (4, "", "v1", []), (5, None, "zz", None), (6, None, None, None), (7, None, None, ["a.txt"]), (8, None, None, ["dir", "."]), (9, None, None, ["/two/any"]), (10, None, None, ["../none/b.txt"]), (11, None, None, ["both.txt"]), (12, None, None, None)]
    requests = spark.createDataFrame(asked, "request_id long, root_uri string, project_id string, hints array<string>")
    seen = spark.createDataFrame([(k, p, r) for k in (4, 7, 8, 9, 10, 11) for p, r in (("v1", "/one"), ("v2", "/two/"))] + [(12, "v9", "/nine")], "request_id long, project_id string, root string")
    listing = spark.createDataFrame([("/one/a.txt",), ("/two/dir/x",), ("/two/b.txt",), ("/one/both.txt",), ("/two/both.txt",)], "path string")
    got = {r["request_id"]: (r["project"], r["source"], r["error"]) for r in lookup.resolve_projects(requests, seen, spark.createDataFrame([("p1",)], "project_id string"), listing).collect()}
    assert got == {
        1: ("file:///s%20p", "root_uri", None), 2: (None, "root_uri", "invalid_root_uri"), 3: ("p1", "project_id", None), 4: ("v1", "project_id", None), 5: (None, "project_id", "unknown_project"), 6: (None, "none", "project_selection_required"),
        7: ("v1", "inferred", None), 8: ("v2", "inferred", None), 9: ("v2", "inferred", None), 10: (None, "inferred", "ambiguous_project"), 11: (None, "inferred", "ambiguous_project"), 12: ("v9", "visible", None),
    }


def test_a_project_goes_alone(spark, tmp_path):
    state = ProjectState(spark, f"{tmp_path}/state")
    rows = spark.createDataFrame([("a/b", 1), ("c", 2), (None, 3)], "project_id string, x int").select("x", "project_id")
    state.write("one", rows)
    state.write("two", rows.where("x > 1"))
    state.write("one", rows.where("x = 2").withColumn("x", F.lit(20)))  # replaces c alone
    assert sorted(r["x"] for r in state.read("one", rows.schema).collect()) == [1, 3, 20]
    assert state.prune("a/b") and not state.prune("a/b") and state.prune(None)
    assert [r["x"] for r in state.read("one", rows.schema).collect()] == [20] and [r["x"] for r in state.read("two", rows.schema).collect()] == [2]


def test_quality_and_recall(spark):
    anchors = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (2, "d", None)], "task long, path string, required boolean")
    items = spark.createDataFrame([(1, "a", 1, "x"), (1, "z", 2, None), (2, "old", 1, "x")], "task long, path string, rank int, detail string")
    banned = spark.createDataFrame([(2, "old", None), (2, "none", "r"), (1, "z", "stale")], "task long, path string, reason string")
    [row] = lookup.quality_report(spark.createDataFrame([(1,), (2,)], "task long"), anchors, items, banned).collect()
    assert (row["fixtures"], row["anchor_recall_at_3"], row["first_anchor_rank_avg"], row["noise_ratio"], row["detail_lookup_rate"], row["stale_rate"]) == (2, 0.3333, 1.0, 0.6667, 0.6667, 1.0)
    got = sorted(tuple(r) for r in lookup.quality_regressions(anchors, items, banned).collect())
    assert got == [(1, "b", "required_anchor_omitted"), (1, "z", "stale"), (2, "d", "required_anchor_omitted"), (2, "old", "must_not_include")]
    runs = spark.createDataFrame([("k", "warm", ["a"], ["a", "b", "b"]), ("k", "cold", [], ["a"]), ("m", "warm", [], [])], "case_id string, phase string, selected array<string>, required array<string>")
    assert {r["case_id"]: r["required_anchor_recall"] for r in lookup.warm_recall(runs).collect()} == {"k": 0.5, "m": 1.0}
