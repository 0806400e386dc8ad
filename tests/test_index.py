"""Written postings give the rows that counting every token gives."""

import random

import pytest

from gleaner.operators import index, lookup, retrieve


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(7)
    words = [f"w{k:03d}" for k in range(60)]
    texts = [" ".join(rnd.choices(words, weights=[60 - k for k in range(60)], k=rnd.randrange(0, 80))) for _ in range(120)] + ["", None, "12 345", "w000 w000"]
    texts += [texts[3]] * 5  # ties
    return spark.createDataFrame([(f"p{i:03d}", t) for i, t in enumerate(texts)], "path string, content string")


@pytest.fixture(scope="module")
def requests(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.sample([f"w{k:03d}" for k in range(60)], rnd.randrange(1, 8)))) for i in range(40)]
    return spark.createDataFrame(rows + [(90, "absent words only"), (91, ""), (92, None)], "request_id long, prompt string")


@pytest.fixture(scope="module")
def made(corpus, tmp_path_factory):
    return index.write_index(corpus, str(tmp_path_factory.mktemp("index")), 8)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_threshold_search_equals_full_scores(corpus, requests, made, n):
    key = lambda r: (r["request_id"], r["rank"], r["path"], r["score"])
    want = sorted(map(key, retrieve.search(corpus, requests, n).collect()))
    assert sorted(map(key, retrieve.search(corpus, requests, n, made).collect())) == want and want


def test_thresholds_cut_candidates(requests, made):
    terms = retrieve.request_terms(requests)
    assert index.search(made, terms, 1).count() < index.parts(made, terms).select("request_id", "path").distinct().count()


def test_pools(corpus, requests, made):
    terms = retrieve.request_terms(requests)
    key = lambda r: tuple(r)
    assert sorted(map(key, retrieve.term_fragments(corpus, terms, 5, made).collect())) == sorted(map(key, retrieve.term_fragments(corpus, terms, 5).collect()))
    with pytest.raises(ValueError):
        index.pools(made, terms, index.BEST + 1)


def test_symbol_hits_by_rarest_run(spark):
    rnd = random.Random(1)
    rows = [(f"a/f{i % 7}.py", "".join(rnd.choices("abcd", k=6)), "def x", i % 3) for i in range(300)] + [("p", None, None, 1)]
    symbols = spark.createDataFrame(rows, "path string, name string, signature string, line_start int")
    terms = [(i, "".join(rnd.choices("abcd", k=rnd.randrange(3, 6)))) for i in range(60)] + [(99, "def"), (98, "zzz")]
    got = lookup.symbol_hits(symbols, spark.createDataFrame(terms, "request_id long, term string"))
    want = {(t, p, n, line) for t, term in terms for p, n, s, line in rows if term in " ".join(x for x in (p, n, s) if x is not None).lower()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
