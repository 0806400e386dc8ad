"""Uniform shuffle into shards of exact size, by a communication matrix.

Each input partition learns how many of its rows go to each shard (one row of a
matrix with the multivariate hypergeometric law), deals its rows out in a local
random order, and after the exchange each shard is put into a random order
again.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage, uniform

#: Input partitions whose matrix rows are drawn by one fold.
GROUP = 1024
#: Rows that one bucket of the second permutation holds on average.
BUCKET_ROWS = 2048
#: The matrix is broadcast up to this many input partitions (about 100 bytes each).
BROADCAST_PARTITIONS = 100_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _hypergeometric(total: Column, good: Column, n: Column, u: Column) -> Column:
    """How many of ``n`` rows drawn without replacement from ``total`` are among
    the ``good``.  Inverse of the distribution function, walked over the support
    within 12 standard deviations of the mode (the rest is below 1e-30); weights
    come from the ratio of neighbours, so no factorials are needed."""
    d = lambda c: c.cast("double")
    none = F.array().cast("array<bigint>")
    low = F.greatest(F.lit(0).cast("long"), n - (total - good))
    mode = F.least(F.greatest(F.floor((d(n) + 1) * (d(good) + 1) / (d(total) + 2)).cast("long"), low), F.least(n, good))
    share = d(good) / d(total)
    reach = F.ceil(F.sqrt(d(n) * share * (1 - share)) * 12 + 12).cast("long")
    around = F.struct(F.greatest(low, mode - reach).alias("first"), mode.alias("mode"), F.least(n, good, mode + reach).alias("last"))

    def up(k: Column) -> Column:  # weight(k) / weight(k - 1)
        return d(good - k + 1) * d(n - k + 1) / (d(k) * d(total - good - n + k))

    def weigh(ks: Column, ratio) -> Column:  # the last weight and the sum, from 1 at the mode
        return F.aggregate(ks, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")), lambda a, k: _let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))))

    def invert(x: Column) -> Column:
        down = weigh(F.when(x["first"] < x["mode"], F.sequence(x["mode"], x["first"] + 1, F.lit(-1).cast("long"))).otherwise(none), lambda k: 1.0 / up(k))
        above = weigh(F.when(x["last"] > x["mode"], F.sequence(x["mode"] + 1, x["last"])).otherwise(none), up)["sum"] - 1.0
        bounds = _let(down, lambda y: F.struct(y["w"].alias("w"), (u * (y["sum"] + above)).alias("want")))

        def walk(y: Column) -> Column:  # up from the first k until the sum passes what is wanted
            start = F.struct(y["w"].alias("w"), y["w"].alias("sum"), x["first"].alias("k"))
            ks = F.when(x["last"] > x["first"], F.sequence(x["first"] + 1, x["last"])).otherwise(none)
            return F.aggregate(ks, start, lambda a, k: _let(a["w"] * up(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.when(a["sum"] <= y["want"], k).otherwise(a["k"]).alias("k"))))["k"]

        return _let(bounds, walk)

    return _let(around, invert)


def _deal(caps: Column, n: Column, shards: int, seed: int, level: str, key: Column) -> Column:
    """Draw how many of the next ``n`` rows go to each shard, given the shards'
    free places ``caps``."""
    start = F.struct(F.aggregate(caps, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), n.alias("n"), F.array().cast("array<bigint>").alias("out"))

    def one(a: Column, s: Column) -> Column:
        good = F.element_at(caps, s + 1)
        k = F.when(a["n"] <= 0, F.lit(0).cast("long")).when(a["total"] <= good, a["n"]).otherwise(
            _hypergeometric(a["total"], good, a["n"], uniform(F.lit(seed), F.lit(level), key, s)))
        return _let(k, lambda x: F.struct((a["total"] - good).alias("total"), (a["n"] - x).alias("n"), F.concat(a["out"], F.array(x)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, one)["out"]


def _fold(items: Column, caps: Column, shards: int, seed: int, level: str) -> Column:
    """Rows of the matrix for ``items`` (structs of id, n), one after another."""
    start = F.struct(caps.alias("caps"), F.array().cast("array<struct<id:bigint,n:bigint,deal:array<bigint>>>").alias("rows"))

    def one(a: Column, x: Column) -> Column:
        return _let(_deal(a["caps"], x["n"], shards, seed, level, x["id"]), lambda d: F.struct(
            F.zip_with(a["caps"], d, lambda c, y: c - y).alias("caps"),
            F.concat(a["rows"], F.array(F.struct(x["id"].alias("id"), x["n"].alias("n"), d.alias("deal")))).alias("rows")))

    return F.aggregate(items, start, one)["rows"]


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``counts(pid, n)`` -> ``(pid, n, deal)``: ``deal[s]`` rows of partition
    ``pid`` go to shard ``s``; rows sum to n, columns to the shard sizes, which
    differ by one at most.  Drawn in two levels, groups of ``GROUP`` partitions
    first, then within each group, so no fold is longer than about a thousand."""
    grouped = counts.groupBy(F.expr(f"pid div {GROUP}").alias("g")).agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("pid").cast("long").alias("id"), F.col("n").cast("long").alias("n")))).alias("items"))
    tops = grouped.agg(F.sort_array(F.collect_list(F.struct(F.col("g").cast("long").alias("id"), F.col("n").cast("long").alias("n")))).alias("groups"), F.sum("n").alias("rows"))
    caps = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr(f"rows div {shards}") + F.when(s < F.col("rows") % shards, 1).otherwise(0).cast("long"))
    tops = tops.where("rows > 0").select(F.explode(_fold(F.col("groups"), caps, shards, seed, "group")).alias("r")).select(F.col("r.id").alias("g"), F.col("r.deal").alias("caps"))
    rows = grouped.join(tops, "g").select(F.explode(_fold(F.col("items"), F.col("caps"), shards, seed, "partition")).alias("r"))
    return rows.select(F.col("r.id").cast("int").alias("pid"), F.col("r.n").alias("n"), F.col("r.deal").alias("deal"))


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240501, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Shuffle ``docs`` uniformly into ``shards`` shards whose row counts differ by
    one at most: all columns of ``docs`` plus ``_shard`` int and ``_slot`` long
    (gapless from 0 in each shard).

    ``docs`` must be a file scan (with any row-wise columns on top): its
    partitions and their row order are then the same each time they are read.
    Nulls, empty and very long texts are rows like any others; repeated rows are
    dealt out one by one, so a large group of copies spreads evenly; an empty
    table gives an empty result.  Columns named ``_shard`` or ``_slot`` are
    replaced; all others come back as they are.
    """
    docs = docs.drop("_shard", "_slot")
    columns = docs.columns
    # under names of our own, so that no column of theirs clashes with ours
    docs = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    counts = stage(docs.groupBy(F.spark_partition_id().alias("pid")).agg(F.count("*").alias("n")), "shard-counts")
    matrix = stage(communication_matrix(counts, shards, seed), "shard-matrix")
    known = matrix.agg(F.count("*").alias("p"), F.sum("n").alias("rows")).first()
    rows = known["rows"] or 0
    deal = matrix.select(F.col("pid").alias("_pid"), F.col("deal").alias("_deal"))
    if known["p"] <= BROADCAST_PARTITIONS:
        deal = F.broadcast(deal)
    # Local permutation: a random key for each row of the scan, a sort within the
    # partition, and the place after the sort.
    keyed = docs.withColumn("_pid", F.spark_partition_id()).withColumn("_key", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    local = keyed.sortWithinPartitions("_key").withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    # The shard is the one whose share of the partition's places holds this place.
    pick = F.aggregate(F.col("_deal"), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).alias("s")),
                       lambda a, x: F.struct((a["end"] + x).alias("end"), (a["s"] + F.when(F.col("_local") >= a["end"] + x, 1).otherwise(0)).alias("s")))["s"]
    buckets = max(16, -(-rows // (shards * bucket_rows)))
    again = F.xxhash64(F.lit(seed + 1), F.col("_key"))
    dealt = local.join(deal, "_pid").withColumn("_shard", pick).withColumn("_key", again).withColumn(
        "_bucket", F.floor(uniform(F.lit(seed + 2), F.col("_key")) * buckets).cast("int")).drop("_pid", "_deal", "_local")
    # Second permutation: random buckets of a shard, a random order in each.
    sizes = dealt.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = stage(sizes.select("_shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")), "shard-offsets")
    place = F.row_number().over(Window.partitionBy("_shard", "_bucket").orderBy("_key")) - 1
    out = dealt.withColumn("_place", place).join(sizes, ["_shard", "_bucket"])
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)], F.col("_shard").cast("int").alias("_shard"), (F.col("_before") + F.col("_place")).cast("long").alias("_slot"))


def op3_sharding(spark, sf_dir):
    """All documents into shards 0 to 7 under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
