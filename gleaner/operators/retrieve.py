"""Ranked search over postings (R operators); requests are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import corpus
from . import index as written
from .index import SearchIndex

K1, B = 1.2, 0.75


def request_terms(requests: DataFrame, most: int = 8) -> DataFrame:
    return requests.select("request_id", F.explode(T.query_terms(F.col("prompt"), most)).alias("term"))


def bm25(files: DataFrame, terms: DataFrame) -> DataFrame:
    """(request_id, path, term, part) contributions of each request term.  Texts
    are tokenised once: a file's tokens come with their number and with one empty token
    that stands for the file itself; only those and the requests' terms are counted.
    The requests' terms are broadcast while Spark finds them small and joined otherwise.
    The counts feed the totals, the document frequencies and the scores; no branch
    filters or narrows them, so that their exchange is made once."""
    wanted = terms.select("term").union(terms.select(F.lit("").alias("term"))).distinct()
    tokens = files.select("path", T.index_tokens(F.col("content")).alias("ts")).select("path", F.size("ts").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "ts")).alias("term"))
    tf = tokens.where("term is not null and dl > 0").join(wanted, "term").groupBy("path", "dl", "term").agg(F.count("*").alias("tf"))
    file = (F.col("term") == "") & (F.col("tf") > 0)
    totals = tf.agg(F.count_if(file).alias("n"), F.avg(F.when(file, F.col("dl"))).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") + F.col("dl") > 0).alias("df"))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = tf.join(df, "term").crossJoin(F.broadcast(totals))  # totals: one row
    return weighed.select("path", "term", part.cast("decimal(18,9)").alias("part")).join(terms, "term")


def top(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The best ``n`` of each group by score, then path."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "path")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def search(files: DataFrame, requests: DataFrame, n: int = 5, index: SearchIndex | None = None) -> DataFrame:
    """R01 with R04: the best ``n`` files of each request, from the corpus's written
    postings if there are any (the same rows)."""
    terms = request_terms(requests)
    scores = written.search(index, terms, n) if index else bm25(files, terms).groupBy("request_id", "path").agg(F.sum("part").alias("score"))
    return top(scores, n, "request_id")


def scoped_search(scopes: DataFrame, requests: DataFrame, n: int, index: SearchIndex) -> DataFrame:
    """The best ``n`` files of each request within its ``scopes(request_id, scope,
    globs)``; a request without a row there has no bounds.  Bounds come before the cut,
    so a list of ``n`` is full if enough files are within."""
    terms = request_terms(requests)
    about = written.near(requests.select("request_id").join(scopes, "request_id", "left"), terms)
    within = written.scores(index, terms).join(about, "request_id").where(corpus.within(F.col("path"), F.col("scope"), F.col("globs"))).select("request_id", "path", "score")
    return top(written.reaching(within, n, "request_id", terms), n, "request_id")


def occurrences(haystack: Column, term: Column) -> Column:
    """How often ``term`` occurs in ``haystack``, without overlaps."""
    return ((F.length(haystack) - F.length(F.replace(haystack, term, F.lit("")))) / F.length(term)).cast("long")


def first_match(lines: Column, terms: Column) -> Column:
    """X11: number of the first line with any of the terms, null if none has one."""
    at = F.array_position(F.transform(lines, lambda x: F.exists(terms, lambda t: F.contains(F.lower(x), t))), True)
    return F.when(at > 0, at.cast("int"))


def _excerpt(lines: Column, line: Column, path: Column) -> Column:
    """240 characters of a line; a file without a match shows its path."""
    return F.coalesce(F.substring(T.strip(F.get(lines, line - 1)), 1, 240), path)


def match_features(hits: DataFrame, files: DataFrame, terms: DataFrame) -> DataFrame:
    """``hits(request_id, path, score)`` plus terms found in path or content
    (term_hits), their occurrences (term_count), the first line with one of them and
    its excerpt, and the request's terms."""
    lists = terms.groupBy("request_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    j = hits.join(lists, "request_id").join(files.select("path", F.lower(F.concat_ws("\n", "path", "content")).alias("h"), T.lines(F.col("content")).alias("ls")), "path")
    count = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + occurrences(F.col("h"), t))
    j = j.withColumn("line", first_match(F.col("ls"), F.col("terms"))).withColumn("term_hits", F.size(F.filter("terms", lambda t: F.contains(F.col("h"), t)))).withColumn("term_count", count)
    return j.select("request_id", "path", "score", F.coalesce("line", F.lit(1)).alias("line"), _excerpt(F.col("ls"), F.col("line"), F.col("path")).alias("excerpt"), "term_hits", "term_count", "terms")


def search_score(features: DataFrame, exact: Column | None = None) -> DataFrame:
    """Base, 10 000 for the file that the query names, 2 for each term in the path,
    1 for each in the excerpt, 2.5 for each term found, a quarter for each of at most 8
    occurrences."""
    within = lambda text: F.size(F.filter("terms", lambda t: F.contains(F.lower(text), t)))
    quarters = 8 * within(F.col("path")) + 4 * within(F.col("excerpt")) + 10 * F.col("term_hits") + F.least(F.col("term_count"), F.lit(8))
    if exact is not None:
        quarters = quarters + F.when(exact, 40_000).otherwise(0)
    # decimals, so that equal sums are equal and halves round one way
    score = F.col("score").cast("decimal(18,6)") + (quarters * 0.25).cast("decimal(18,2)")
    return features.withColumn("score", F.round(score, 4).cast("double"))


def term_fragments(files: DataFrame, terms: DataFrame, n: int = 40, index: SearchIndex | None = None) -> DataFrame:
    """Each different term's own pool of its ``n`` best files, with base score (6
    places), occurrences, first line and excerpt: (term, path, rank, score, term_count,
    line, excerpt).  However many requests share a term, its pool is made once."""
    each = terms.select("term").distinct()
    pool = written.pools(index, each, n) if index else top(bm25(files, each).select("term", "path", F.col("part").alias("score")), n, "term")
    pool = pool.withColumn("score", F.col("score").cast("decimal(18,6)"))
    # a file's lines and lower-case text are made once, however many terms found it
    by_file = pool.groupBy("path").agg(F.collect_list(F.struct("term", "rank", "score")).alias("found"))
    j = by_file.join(files.select("path", "content"), "path").select("path", F.lower(F.concat_ws("\n", "path", "content")).alias("h"), T.lines(F.col("content")).alias("ls"), "found")
    j = j.select("path", "h", "ls", F.explode("found").alias("f")).select("path", "h", "ls", "f.*")
    j = j.withColumn("line", first_match(F.col("ls"), F.array("term")))
    return j.select("term", "path", "rank", "score", F.greatest(F.lit(1), occurrences(F.col("h"), F.col("term"))).alias("term_count"), F.coalesce("line", F.lit(1)).alias("line"), _excerpt(F.col("ls"), F.col("line"), F.col("path")).alias("excerpt"))


def merge_fragments(fragments: DataFrame, requests: DataFrame, most: int = 8) -> DataFrame:
    """One row for each request and path of its terms' pools: hits and occurrences
    added up, the best base score, the earliest line and its excerpt, scored as R03."""
    asked = requests.select("request_id", F.lower(T.path_like(F.col("prompt"))).alias("named"), T.query_terms(F.col("prompt"), most).alias("terms"))
    each = asked.select("request_id", F.explode("terms").alias("term")).join(fragments, "term")
    rows = each.groupBy("request_id", "path").agg(F.count("*").alias("term_hits"), F.sum("term_count").alias("term_count"), F.max("score").alias("score"), F.min(F.struct("line", "excerpt")).alias("first"))
    rows = rows.select("request_id", "path", "term_hits", "term_count", "score", "first.line", "first.excerpt").join(asked, "request_id")
    return search_score(rows, (F.col("named") != "") & (F.lower("path") == F.col("named"))).drop("named", "terms")


def exact_files(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, path, score) of the files that path-like requests name, scored
    as R03 without a base score."""
    named = requests.select("request_id", "prompt", F.lower(T.path_like(F.col("prompt"))).alias("key")).where("key <> ''")
    hits = named.join(files.select("path", F.lower("path").alias("key")), "key").select("request_id", "path", F.lit(0.0).alias("score"))
    return search_score(match_features(hits, files, request_terms(named)), F.lit(True)).select("request_id", "path", "line", "score")


def lookup_search(files: DataFrame, requests: DataFrame, n: int = 5, index: SearchIndex | None = None) -> DataFrame:
    """(request_id, rank, path, line, score): the requests' terms, their pools, the
    merged and rescored rows, the file that the request names first, the best ``n``."""
    merged = merge_fragments(term_fragments(files, request_terms(requests), index=index), requests).select("request_id", "path", "line", "score")
    named = exact_files(files, requests)
    both = merged.unionByName(named.join(merged.select("request_id", "path"), ["request_id", "path"], "left_anti"))
    return top(both, n, "request_id").select("request_id", "rank", "path", "line", "score")


def direct_owners(sources: DataFrame, files: DataFrame) -> DataFrame:
    """``sources(path, ...)`` with each existing Python test that four name patterns
    give for a source's stem, whatever its own suffix: source, pattern (0 to 3), path.
    Tests are no sources."""
    stem = F.regexp_extract(F.col("path"), r"([^/]+?)(\.[^./]*)?$", 1)
    made = F.array(*[F.concat(F.lit(a), stem, F.lit(b)) for a, b in (("tests/test_", ".py"), ("test/test_", ".py"), ("tests/", "_test.py"), ("test/", "_test.py"))])
    rest = [c for c in sources.columns if c != "path"]
    each = sources.where(~F.col("path").rlike("^tests?/")).select(*rest, F.col("path").alias("source"), F.posexplode(made).alias("pattern", "path"))
    return each.join(files.select("path"), "path", "left_semi")
