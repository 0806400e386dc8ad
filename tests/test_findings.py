"""What a review found on odd and larger tables."""

import random
import re
import time

from gleaner.operators import extract, index, lookup
from gleaner.plans import registry

DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, folder, texts):
    spark.createDataFrame([(i, t, "en", "src") for i, t in enumerate(texts)], DOCS).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_texts_without_reusable_terms_have_none(spark, tmp_path):
    d = documents(spark, tmp_path, ["alpha fix the beta", "the code", "", None])
    got = {r["doc_id"]: r["terms"] for r in registry.QUERIES["t14_reusable_terms"](spark, d).collect()}
    assert got == {0: "alpha beta", 1: None, 2: None, 3: None}


def test_streamed_postings_hold_all_terms(spark, tmp_path):
    d = documents(spark, tmp_path, ["\n".join(f"w{i:05d} w{i:05d}" for i in range(4500)), "one two"])
    got = {r["path"]: (r["terms"], r["tf"]) for r in registry.QUERIES["w02_corpus_stream"](spark, d).collect()}
    assert got == {"en/src/doc_0.txt": (4500 + 3, 9000 + 3), "en/src/doc_1.txt": (2 + 3, 2 + 3)}


def test_lean_content_is_linear_in_a_text(spark, tmp_path):
    lines = [f"w{i:05d} here" for i in range(20000)]
    d = documents(spark, tmp_path, ["\n".join(lines), "short one"])
    began = time.time()
    got = {r["path"]: r["content"] for r in registry.QUERIES["p10_lean_content"](spark, d).collect()}
    assert time.time() - began < 60  # minutes, with the terms made anew for each line
    assert got["en/src/doc_1.txt"] == "short one"
    assert got["en/src/doc_0.txt"] == " … ".join(lines)[:125].rstrip() + "\n...[truncated]"


def test_index_counts_lie_by_file(spark, tmp_path):
    files = spark.createDataFrame([("a", "one two one"), ("b", "two"), ("c", ""), ("d", None)], "path string, content string")
    made = index.write_index(files, str(tmp_path / "index"), 4)
    counts = {r["path"]: [tuple(c) for c in r["counts"]] for r in spark.read.parquet(str(tmp_path / "index/counts")).collect()}
    assert counts == {"a": [("one", 2), ("two", 1)], "b": [("two", 1)]}  # no exchange by (file, term)
    assert {(r["term"], r["path"]) for r in made.postings.collect()} == {("one", "a"), ("two", "a"), ("two", "b")}


def test_skills_are_ranked_without_meeting_texts(spark):
    words = ["alpha", "beta", "gamma", "qa", "delta", "the"]
    skills = [(i, "skills/n", words[i % 6], " ".join(words[(i * k) % 6] for k in range(1, 5)), (i % 5) / 4) for i in range(40)]
    asked = [(0, "alpha the thing", "qa"), (1, "delta", ""), (2, None, None), (3, "nothing here", "qa")]
    got = lookup.rank_skills(spark.createDataFrame(skills, "skill_id long, namespace string, key string, value string, confidence double"), spark.createDataFrame(asked, "request_id long, prompt string, route string"), 3)
    terms = lambda x: list(dict.fromkeys(re.findall("[a-z0-9_]{3,}", (x or "").lower())))
    want = set()
    for r, prompt, route in asked:
        scored = []
        for s, ns, key, value, confidence in skills:
            h = f"{ns} {key} {value}"
            score = sum(3 * (t in h) + 2 * (t in key) for t in terms(prompt)[:8]) + 2 * (bool(route) and route in h) + 0.5 * sum(t in (prompt or "") for t in terms(h)[:24]) + confidence
            scored += [(-round(score, 4), s)] if score > 1 else []
        want |= {(r, s, k + 1, -score) for k, (score, s) in enumerate(sorted(scored)[:3])}
    assert {tuple(x) for x in got.select("request_id", "skill_id", "rank", "score").collect()} == want


def test_python_rows_are_handed_on_before_a_batch_ends(spark):
    text = "".join(f"import m{i}\n" for i in range(6000))
    rows = extract.python_symbols(spark.createDataFrame([(f"f{i}.py", text) for i in range(4)], "path string, content string").coalesce(1))
    assert rows.count() == 24000 and extract.PYTHON_ROWS <= 10_000


def test_python_symbols_of_all_kinds_of_blocks(spark):
    blocks = ["if a:", "else:", "while a:", "try:", "except E:", "else:", "finally:", "with a:", "match a:\n  case 1:", "async def f():", "class C:", "@d\ndef g(x=lambda: 1):"]
    text = "".join(f"{b}\n   import m{i}\n   def h{i}(): pass\n" for i, b in enumerate(blocks))
    got = {(r["kind"], r["name"]) for r in extract.python_symbols(spark.createDataFrame([("a.py", text)], "path string, content string")).collect()}
    names = {("function", n) for n in ("f", "g")} | {("class", "C")}
    assert got == names | {x for i in range(len(blocks)) for x in (("import", f"m{i}"), ("function", f"h{i}"))}


def test_first_symbols_of_a_request_are_found_without_all_its_hits(spark):
    rnd = random.Random(3)
    rows = [(f"{'ab'[i % 2]}/f{i % 211:03d}.py", "".join(rnd.choices("abcd", k=5)), "def x" if i % 3 else None, i % 9) for i in range(4000)]
    symbols = spark.createDataFrame(rows + rows[:50] + [(f"b/{'r' * k}are", "rare", "é rare", k) for k in range(9)], "path string, name string, signature string, line_start int")
    terms = [(i, "".join(rnd.choices("abcd", k=3 + i % 3))) for i in range(30)] + [(i, "def") for i in range(10)] + [(40, "rare"), (41, "zzz"), (42, "f01")]
    asked = spark.createDataFrame(terms, "request_id long, term string")
    want = {tuple(r) for r in lookup.first_symbols(lookup.symbol_hits(symbols, asked), 7).collect()}
    got = lookup.first_symbol_hits(symbols, asked, 7)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_search_exchanges_no_request_rows(spark, tmp_path):
    files = spark.createDataFrame([(f"p{i:03d}", f"one w{i % 7} w{i % 5}") for i in range(200)], "path string, content string")
    made = index.write_index(files, str(tmp_path / "index"), 4)
    asked = spark.createDataFrame([(i, t) for i in range(9) for t in ("one", f"w{i}")], "request_id long, term string")
    found = index.search(made, asked, 2)
    assert not re.search(r"hashpartitioning\(request_id#\d+L?, path", found._jdf.queryExecution().executedPlan().toString())
    assert not (tmp_path / "index/postings").exists()  # lists of all terms are not exchanged
    assert found.select("request_id").distinct().count() == 9
