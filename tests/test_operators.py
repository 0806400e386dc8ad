"""Order-dependent and pattern operators against plain Python."""

import random
import re

from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import corpus, evidence, extract, pack, projects
from gleaner.streaming import streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_redaction(spark):
    texts = ["see file:///home/a/b.py now", "see file://localhost/C:\\x\\y now", "open /home/me/x.txt please", "at C:\\Users\\me\\f", "é/home/z", "api_key = 'abc'", "Bearer abcdefghijklmnop", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(T.redact(F.col("x")).alias("r"), T.redaction_categories(F.col("x")).alias("c")).collect()
    assert rows[0]["r"] == "see file://[REDACTED_HOST_PATH] now" and rows[0]["c"] == ["host_path_uri"]
    assert rows[2]["r"] == "open [REDACTED_HOST_PATH] please" and rows[2]["c"] == ["host_path"]
    assert "REDACTED_HOST_PATH" in rows[3]["r"] and rows[4]["r"] == "é/home/z"
    assert rows[5]["c"] == ["secret_pattern_1"] and rows[6]["c"] == ["secret_pattern_2"]
    assert rows[7]["r"] is None and rows[8]["c"] == []


def test_lines_like_splitlines(spark):
    for t in ["a\nb\r\nc\x0bd\u2028e\n", "", "\n", "a\n\nb", "x\r"]:
        got = one(spark, T.lines(F.col("x")), t)
        assert got == [x for x in re.split("\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]", t)][: len(t.splitlines())]


def test_selection_against_a_loop(spark):
    rnd = random.Random(5)
    rows = [(r, f"p{rnd.randrange(4)}", rnd.randrange(3), 9, round(rnd.random() * 10, 2), "x" * rnd.randrange(1, 900)) for r in range(20) for _ in range(rnd.randrange(1, 15))]
    df = spark.createDataFrame(rows, "request_id int, path string, start_line int, end_line int, score double, content string")
    got = {}
    for x in pack.select(df, 4, 1500, 2).orderBy("request_id", "rank").collect():
        got.setdefault(x["request_id"], []).append(x["outcome"])
    for r, outcomes in got.items():
        mine = sorted([x for x in rows if x[0] == r], key=lambda x: (-x[4], x[1], x[2], x[3], len(x[5])))
        seen, per, used, n, want = set(), {}, 0, 0, []
        for _, p, a, b, _, c in mine:
            if (p, a, b) in seen:
                want.append("duplicate")
                continue
            seen.add((p, a, b))
            if per.get(p, 0) >= 2:
                want.append("diversity_limit")
            elif n >= 4:
                want.append("item_limit")
            elif used + len(c) > 1500 and n:
                want.append("budget_exhausted")
            else:
                want.append("selected")
                used, n, per[p] = used + len(c), n + 1, per.get(p, 0) + 1
        assert outcomes == want


def test_diff_twice_is_no_change(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "path string, size long, mtime_ns long")
    assert {r["change"] for r in corpus.refresh_diff(df, df).collect()} == {"unchanged"}


def test_paths(spark):
    assert one(spark, corpus.is_safe(F.col("x")), "a/../../b") is False
    assert one(spark, corpus.is_safe(F.col("x")), "a/../b") is True
    assert one(spark, corpus.excluded(F.col("x")), "a/.git/config") is True
    assert one(spark, corpus.excluded(F.col("x")), "a/key.pem") is True
    assert one(spark, corpus.excluded(F.col("x")), "src/a.py") is False
    assert one(spark, T.path_like(F.col("x")), ".\\src\\a.py") == "src/a.py"


def test_routes(spark):
    for t, r in [("please debug this", "debug"), ("open a PR to merge", "general"), ("implement the api", "coding"), ("unit coverage", "test"), ("hello world", "general"), ("guide for me", "docs")]:
        assert one(spark, T.route(F.col("x")), t) == (r if t != "open a PR to merge" else "review")


def test_python_symbols(spark):
    files = spark.createDataFrame([("a.py", "import os.path\nclass A:\n    def f(self):\n        pass\n"), ("b.py", "def ("), ("c.py", None)], "path string, content string")
    assert sorted((r["path"], r["name"], r["kind"]) for r in extract.python_symbols(files).collect()) == [("a.py", "A", "class"), ("a.py", "f", "function"), ("a.py", "os", "import")]


def test_nested_projects(spark):
    files = spark.createDataFrame([("a/pyproject.toml",), ("a/b/pyproject.toml",), ("c/d/pyproject.toml",), ("c/d/x.py",)], "path string")
    roots = projects.discover(files, ["pyproject.toml"])
    assert sorted(r["path"] for r in roots.collect()) == ["a", "c/d"]
    assert {(r["path"], r["root"]) for r in projects.assign(files, roots).collect()} >= {("a/b/pyproject.toml", "a"), ("c/d/x.py", "c/d")}


def test_event_stream_equals_batch(spark, tmp_path):
    batch = spark.range(50).selectExpr("id % 30 as event_id", "id % 3 as k")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    streams.append_events(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "log")).select("event_id").collect()) == list(range(30))


def test_requests_with_nulls(spark):
    raw = spark.createDataFrame([(1, None, "t", None), (2, " ", None, "LEAN"), (3, "p", "t", "odd")], "request_id int, prompt string, task string, profile string")
    assert [tuple(r) for r in evidence.checked_requests(raw).orderBy("request_id").collect()] == [(1, "t", None, None), (2, None, "lean", "missing_prompt"), (3, "p", "odd", "unknown_profile")]


def test_lookups_and_rollups(spark):
    assert one(spark, evidence.first_matching_line(F.col("x"), ["b"]), "a\nxB\nb") == 2
    assert one(spark, evidence.first_matching_line(F.col("x"), ["z"]), "a\nb") == 1
    rows = spark.createDataFrame([(1, ["b", "a"]), (1, ["a"]), (2, []), (3, None)], "k int, categories array<string>")
    assert [tuple(r) for r in evidence.merged_categories(rows, "k").orderBy("k").collect()] == [(1, True, 3, "a,b"), (2, False, 0, ""), (3, False, 0, "")]
    assert sorted(tuple(r) for r in evidence.signal_counts(rows, "k").collect()) == [(1, "a", 2), (1, "b", 1)]


def test_lookups_and_reasons(spark):
    from gleaner.operators import lookup

    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    hits = table([(1, "a/x.py", 2.0), (2, "b.py", 1.0)], "request_id int, path string, score double")
    asked = table([(1, "A/Y.py"), (2, None), (3, "plain words")], "request_id int, query string")
    files = table([("a/x.py",), ("a/y.py",), (None,)], "path string")
    got = {(r[0], r[1]): r[2] for r in lookup.promote_exact(hits, asked, files).collect()}
    assert got == {(1, "a/x.py"): 2.0, (1, "a/y.py"): 10_000.0, (2, "b.py"): 1.0}
    entries = table([("n", 2, "s", "p"), ("n", 1, "t", "q"), (None, 9, "s", "p")], "namespace string, schema_version int, signature string, path string")
    misses = table([("n", 3, "s", "p"), ("n", 1, "z", "p"), ("n", 1, "s", "q"), ("n", 1, "", "q"), ("m", 1, "s", "p"), (None, 1, "s", "p")], "namespace string, schema_version int, signature string, path string")
    reasons = {tuple(r)[:4]: r["reason"] for r in lookup.miss_reasons(misses, entries).collect()}
    assert list(map(reasons.get, map(tuple, misses.collect()))) == ["schema_version_changed", "index_changed", "path_changed", "no_compatible_entry", "no_compatible_entry", "no_compatible_entry"]
    symbols = table([("a/x.py", "load", 1, "def load"), ("b/x.txt", "loader", 2, "loader"), ("c.py", None, 3, None)], "path string, name string, line_start int, signature string")
    found = lookup.symbol_hits(symbols, table([(1, "load"), (2, "zzz")], "request_id int, term string"))
    related = lookup.related_symbols(table([(1, "a/x.py")], "request_id int, path string"), found, 5).orderBy("rank").collect()
    assert [(r["path"], r["confidence"]) for r in related] == [("a/x.py", "high"), ("b/x.txt", "medium")]
    assert lookup.symbol_hits(symbols.limit(0), table([(1, "load")], "request_id int, term string")).isEmpty()


def test_terms_of_whole_texts(spark, tmp_path):
    from gleaner.plans.registry import QUERIES

    text = "same line\n" * 400 + " ".join(f"term{k}" for k in range(30))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {q: QUERIES[q](spark, str(tmp_path)).first()["terms"].split() for q in ("t01_query_terms", "t14_reusable_terms")}
    assert got["t01_query_terms"] == ["same", "line", *[f"term{k}" for k in range(6)]]
    assert len(got["t14_reusable_terms"]) == 8


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from gleaner.operators import memory

    files = [(f"p{k % 7}", k, f"alpha beta{k}\nalpha") for k in range(20)]
    for k in range(4):  # four files, so four batches
        spark.createDataFrame(files[k * 5 : k * 5 + 5], "path string, mtime_ns long, content string").coalesce(1).write.parquet(str(tmp_path / f"files/{k}"))
    stream = spark.readStream.schema("path string, mtime_ns long, content string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "files"))
    streams.refresh_corpus(stream, str(tmp_path / "postings"), str(tmp_path / "c1")).awaitTermination()
    last = {}
    for p, k, c in files:
        last[p] = c
    want = extract.postings(spark.createDataFrame(list(last.items()), "path string, content string"))
    row = lambda df: sorted(tuple(r) for r in df.select("path", "term", "first_line", "tf").collect())
    assert row(streams.last_version(spark, str(tmp_path / "postings"))) == row(want)
    writes = [(k, f"n{k % 2}", f"k{k % 3}", f"v{k}", k) for k in range(20)]
    made = "seq long, namespace string, key string, value string, t long"
    for k in range(4):
        spark.createDataFrame(writes[k * 5 : k * 5 + 5], made).selectExpr("*", "timestamp_seconds(t) as written_at").coalesce(1).write.parquet(str(tmp_path / f"memory/{k}"))
    log = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "memory"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "memory"))
    streams.upsert_memory(stream, str(tmp_path / "latest"), str(tmp_path / "c2"), "namespace", "key").awaitTermination()
    pick = lambda df: sorted(tuple(r) for r in df.select("namespace", "key", "value", "created_at").collect())
    assert pick(streams.last_version(spark, str(tmp_path / "latest"))) == pick(memory.latest(log, "namespace", "key"))


def test_redaction_of_other_scripts_and_json(spark):
    from gleaner.functions import sanitize

    assert one(spark, T.redact(F.col("x")), "password\u00a0=\u00a0hunter2") == "[REDACTED_SECRET_1]"
    assert one(spark, F.size(T.injection_signals(F.col("x"))), "ignore\u00a0all previous") == 1
    assert one(spark, T.trim_text(F.col("x"), 30), "a" * 10 + " \n\t" * 10) == "a" * 10 + "\n...[truncated]"
    assert one(spark, corpus.excluded(F.col("x")), "a/ID_RSA") and one(spark, corpus.excluded(F.col("x")), ".ENV") and not one(spark, corpus.excluded(F.col("x")), "a/b.py")
    assert sanitize.sanitized(None) == (None, 0, [])
    assert sanitize.sanitized('{"a":["see /home/me/x",{"api_key=abc":1}],"n":2}') == ('{"a":["see [REDACTED_HOST_PATH]",{"[REDACTED_SECRET_1]":1}],"n":2}', 2, ["host_path", "secret_pattern_1"])
    assert sanitize.sanitized("not json") == ("not json", 0, [])
