"""Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers are runs of ``k`` words.  Each is numbered by its occurrence, so
that repeats count, and hashed.  The circle of hashes is turned by 0, 1, 2, ... of
``bins`` equal steps: each turn is a permutation, under which the ``keep`` smallest
numbered k-mers are selected, put back into text order, and hashed as a tuple.  A text
with ``keep`` k-mers or more so has ``bins`` whole tuples, however short it is.
Column expressions only: a text is handled in its own row, without an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

K, BINS, KEEP = 2, 64, 2
#: A numbered k-mer is one long: hash bits above, word position below (a string has
#: fewer than 2**31 bytes, so fewer than 2**30 words).
POSITION_BITS = 30
HASH_BITS = 33
POSITION_MASK = (1 << POSITION_BITS) - 1
SIGNATURE_BITS = 32


def _keyed(h: Column, pos: Column) -> Column:
    """Top bits of a 64-bit hash and a position as a non-negative long."""
    return F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), POSITION_BITS).bitwiseOR(pos.cast("long").bitwiseAND(F.lit(POSITION_MASK)))


def _hash_of(key: Column) -> Column:
    return F.shiftright(key, POSITION_BITS)


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i.cast("int"))


def signatures(df: DataFrame, text: str, out: str, k: int = K, bins: int = BINS, keep: int = KEEP) -> DataFrame:
    """``df`` plus ``out``: an array of ``bins`` longs ``turn << 32 | tuple hash``, in
    the order of turns.  Texts of fewer than ``k`` words are one k-mer; texts of fewer
    than ``keep`` k-mers have shorter tuples; texts without words give an empty array."""
    bin_shift = POSITION_BITS + HASH_BITS - (bins - 1).bit_length()
    empty = F.array().cast("array<bigint>")
    none = F.array().cast("array<int>")
    keep_columns = [f"`{c}`" for c in df.columns]
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    df = df.select(*keep_columns, words.alias("_w"))
    n = F.size("_w")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: _keyed(F.xxhash64(*[F.coalesce(_at("_w", F.least(i + j, F.lit(2**31 - 1))), F.lit("")) for j in range(k)]), i))
    # In hash order, so that equal k-mers are neighbours, in text order among themselves.
    df = df.select(*keep_columns, F.when(n > 0, F.sort_array(grams)).otherwise(empty).alias("_s"))
    many = F.size("_s")
    indexes = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(none)
    first = F.filter(indexes, lambda i: (i == 0) | (_hash_of(_at("_s", i)) != _hash_of(_at("_s", F.greatest(i - 1, F.lit(0))))))
    df = df.select(*keep_columns, "_s", first.alias("_f"))
    # Occurrence numbers: 0, 1, ... within each run of equal k-mers.
    occurrence = F.flatten(F.transform(F.col("_f"), lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get(F.col("_f"), j + 1), F.size("_s")) - s - 1)))
    numbered = F.zip_with(F.col("_s"), occurrence, lambda x, o: F.when(o == 0, x).otherwise(_keyed(F.xxhash64(_hash_of(x), o), x.bitwiseAND(F.lit(POSITION_MASK)))))
    # most texts repeat few k-mers: if none, the order is right already
    df = df.select(*keep_columns, F.when(F.size("_f") == many, F.col("_s")).otherwise(F.sort_array(numbered)).alias("_n"))
    bin_of = lambda x: F.shiftright(x, bin_shift)
    least = F.filter(F.col("_n"), lambda x, i: (i < keep) | (bin_of(_at("_n", F.greatest(i - keep, F.lit(0)))) != bin_of(x)))
    df = df.select(*keep_columns, least.alias("_m"))
    # Where the smallest k-mers of each turn begin: the turns' own first hashes, sorted in
    # among the least ones, stand behind as many turns as came before them.
    turns = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.shiftleft(b.cast("long"), bin_shift))
    df = df.select(*keep_columns, "_m", F.concat("_m", F.slice("_m", 1, keep)).alias("_c"), turns.alias("_t"))
    df = df.select(*keep_columns, "_m", "_c", "_t", F.sort_array(F.concat("_m", "_t")).alias("_o"))

    def tuple_hash(turn: Column, b: Column) -> Column:
        members = F.slice(F.col("_c"), (F.array_position(F.col("_o"), turn) - b).cast("int"), F.least(F.size("_m"), F.lit(keep)))
        by_text = F.sort_array(F.transform(members, lambda x: F.shiftleft(x.bitwiseAND(F.lit(POSITION_MASK)), HASH_BITS).bitwiseOR(_hash_of(x))))
        hashes = F.transform(by_text, lambda x: x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
        return F.shiftleft(b.cast("long"), SIGNATURE_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(hashes), 64 - SIGNATURE_BITS))

    return df.select(*keep_columns, F.when(F.size("_m") > 0, F.transform(F.col("_t"), tuple_hash)).otherwise(empty).alias(out))


def fingerprint(signature: Column) -> Column:
    """A string that two texts share if their signatures are equal: for each turn
    two hex digits and the first six of its tuple hash."""
    digits = F.transform(signature, lambda x: F.lpad(F.hex(F.shiftright(x, SIGNATURE_BITS - 24)), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the turns whose tuples are equal; 1 for two texts without words, 0 for
    one without and one with some."""
    turns = F.greatest(F.size(a), F.size(b))
    return F.when(turns == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / turns)


def with_next(docs: DataFrame, k: int = K, bins: int = BINS, keep: int = KEEP) -> DataFrame:
    """``docs(doc_id, text)`` plus row ids and signatures: (_row, doc_id, text, _ts,
    _chars, _previous, _previous_chars).  The order is by doc_id over the whole table: a
    range exchange of ids alone, ranks within its partitions, and their ends
    joined up by a table of one row for each partition.

    ``docs`` must be a file scan, so that its row ids stay the same.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    narrow = rows.select("_row", "doc_id", F.length("text").cast("long").alias("_chars"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_row")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "id-order")
    ends = placed.groupBy("_part").agg(F.max("_at").alias("last_at"))
    edge = lambda at, side: placed.select(F.col("_at").alias(at), F.col("_row").alias(f"{side}_row"), F.col("_chars").alias(f"{side}_chars"))
    ends = ends.join(edge("last_at", "last"), "last_at").select("_part", "last_row", "last_chars")
    # One row a partition: before the first comes the last.
    ring = Window.orderBy("_part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_part", F.coalesce(F.lag("last_row").over(ring), F.last("last_row").over(whole)).alias("before"), F.coalesce(F.lag("last_chars").over(ring), F.last("last_chars").over(whole)).alias("before_chars"))
    within = Window.partitionBy("_part").orderBy("_at")
    linked = placed.select("_row", "_part", "_chars", F.lag("_row").over(within).alias("p"), F.lag("_chars").over(within).alias("c")).join(ends, "_part")
    links = linked.select("_row", "_chars", F.coalesce("p", "before").alias("_previous"), F.coalesce("c", "before_chars").alias("_previous_chars"))
    return signatures(rows, "text", "_ts", k, bins, keep).join(links, "_row")


def edited(docs: DataFrame, k: int = K, bins: int = BINS, keep: int = KEEP) -> DataFrame:
    """Each row with its edited text (the second half of its code points gives way
    to the first as many of the next document), its signature and the next's."""
    rows = with_next(docs, k, bins, keep)
    # Both sides read the same columns of ``rows``, so its exchange of texts is made once.
    heads = rows.select(F.col("_previous").alias("_row"), F.col("doc_id").alias("next_doc_id"), F.col("_ts").alias("_ns"), F.expr("substring(text, 1, cast(_previous_chars div 2 as int))").alias("_head"))
    joined = rows.join(heads, "_row")
    return joined.select("doc_id", "next_doc_id", "_ts", "_ns", F.col("_chars").alias("n_chars"), F.concat(F.expr("substring(text, 1, cast(_chars - _chars div 2 as int))"), F.col("_head")).alias("edited"))


def fingerprint_documents(docs: DataFrame, k: int = K, bins: int = BINS, keep: int = KEEP) -> DataFrame:
    """Fingerprints of each text, its edited text and their likeness.

    Null texts are empty; texts without words have the empty fingerprint and
    likeness 1 to each other, 0 to all others; null doc_ids come last in the order,
    repeated ones in input order; texts of any length are taken whole; other columns
    are ignored; an empty table gives no rows.
    """
    both = edited(docs, k, bins, keep).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return signatures(both, "edited", "_es", k, bins, keep).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_ts")).alias("fingerprint"), fingerprint(F.col("_es")).alias("edited_fingerprint"),
        likeness(F.col("_ts"), F.col("_es")).alias("near_edited"), likeness(F.col("_ts"), F.col("_ns")).alias("near_next"), "next_doc_id")


def op8_order_minhash(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
