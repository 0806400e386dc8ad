"""Search over written postings: a corpus's tokens are counted once, by file, and a query
takes the counts of its terms alone.

Two tables: ``counts`` (path, dl, counts), a row for each file, and ``terms`` (term, df), in
folders by hash of the term.  Counts never meet an exchange as a whole: those of other terms
are left where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .stage import folder

K1, B = 1.2, 0.75
#: Folders of terms, and the longest pool of a term.
BUCKETS, BEST = 64, 40
#: Terms of requests that are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_TERMS = 50_000
#: One file of so many is scored first; its scores bound those of all and replace none.
SLICE = 16
PART = "decimal(18,9)"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class SearchIndex:
    counts: DataFrame
    terms: DataFrame
    totals: DataFrame
    buckets: int

    @property
    def postings(self) -> DataFrame:
        """(term, path, part) of all terms."""
        return self._weighed(self.terms.drop("bucket"))

    def _weighed(self, known: DataFrame) -> DataFrame:
        tf = self.counts.select("path", "dl", F.explode("counts").alias("c")).select("path", "dl", "c.term", "c.tf")
        part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return tf.join(known, "term").crossJoin(F.broadcast(self.totals)).select("term", "path", part.cast(PART).alias("part"))  # totals: one row

    def of(self, terms: DataFrame) -> DataFrame:
        """Lists of the different ``terms``, as (term, path, part)."""
        wanted = near(terms.select("term").distinct().withColumn("bucket", _bucket(F.col("term"), self.buckets)), terms)
        return self._weighed(near(self.terms.join(wanted, ["bucket", "term"]).drop("bucket"), terms))


def near(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows``, of which a term of a request has one at most, broadcast while the terms are few."""
    return F.broadcast(rows) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else rows


def write_index(files: DataFrame, path: str, buckets: int = BUCKETS) -> SearchIndex:
    """Write the search tables of ``files(path, content)`` under ``path``.  A file's tokens
    are counted in its own row; only the terms' numbers of files are exchanged."""
    spark = files.sparkSession
    counted = files.select("path", T.bound(T.index_tokens(F.col("content")), lambda ts: F.struct(F.size(ts).alias("dl"), T.token_counts(ts).alias("counts"))).alias("c"))
    counted.select("path", "c.dl", "c.counts").where("dl > 0").write.mode("overwrite").parquet(f"{path}/counts")
    counted = spark.read.parquet(f"{path}/counts")
    counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")
    df = counted.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).withColumn("bucket", _bucket(F.col("term"), buckets))
    df.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    return SearchIndex(counted, spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/totals"), buckets)


_WRITTEN: dict[tuple[str, str], SearchIndex] = {}


def index_of(spark: SparkSession, name: str, files) -> SearchIndex:
    """The session's index named ``name``, written from ``files()`` when first asked for."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = write_index(files(), folder(spark, "search-index"))
    return _WRITTEN[key]


def parts(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """(request_id, path, term, part) of all files with a term of a request."""
    return index.of(terms).join(near(terms, terms), "term").select("request_id", "path", "term", "part")


def scores(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """(request_id, path, score) of all files with a term of a request.  Lists are dealt
    by file before they meet the requests, so that requests multiply nothing that is exchanged."""
    return index.of(terms).repartition("path").join(near(terms, terms), "term").groupBy("request_id", "path").agg(F.sum("part").alias("score"))


def reaching(rows: DataFrame, n: int, key: str, terms: DataFrame) -> DataFrame:
    """``rows(key, path, score)`` without most that aren't among the best ``n`` of their key:
    the n-th score of a slice of the files is reached by n files, so what lies below it can't be."""
    some = rows.where(F.pmod(F.xxhash64("path"), F.lit(SLICE)) == 0)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "path"))
    floors = some.withColumn("place", nth).where(F.col("place") <= n).where(F.col("place") == n).select(key, F.col("score").alias("floor"))
    return rows.join(near(floors, terms), key, "left").where(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).drop("floor")


def pools(index: SearchIndex, terms: DataFrame, n: int) -> DataFrame:
    """(term, rank, path, score): the ``n`` best files of each different term."""
    if n > BEST:
        raise ValueError(f"pools hold {BEST} files a term at most")
    rows = reaching(index.of(terms).select("term", "path", F.col("part").alias("score")), n, "term", terms)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "path"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("term", "rank", "path", "score")


def search(index: SearchIndex, terms: DataFrame, n: int) -> DataFrame:
    """(request_id, path, score) of files among which are the best ``n`` of each
    request, with their whole scores."""
    return reaching(scores(index, terms), n, "request_id", terms)
