"""Mixing sources to target weights, by nested thresholds on a hash of each document.

A source's target is met with whole passes over it and, for what is left, with the
documents whose hash lies below a threshold.  The threshold comes from histograms:
words by source and hash bucket give the bucket in which the budget runs out; only
that bucket's documents are split by the next bits of the hash, until one document
stands at the boundary.  Nothing is sorted, and a smaller target takes a part of
what a larger one takes.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

#: Bits of the hash that one level of histograms splits by, and bits of each hash.
BITS, HASH_BITS = 10, 60
#: Sources' rows are broadcast up to so many sources with so many bytes of names; more are joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_NAME_BYTES = 50_000, 4_000_000
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash60(text: Column) -> Column:
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("long")


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` plus the hash of the id and, to tell equal ids apart, the hash of the
    row's file and place there.  What isn't a scan of Parquet files is written first."""
    first = _hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    second = _hash60(F.concat_ws(":", F.lit(str(seed)), F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    try:
        return docs.select("*", first.alias("h1"), second.alias("h2"))
    except AnalysisException:
        return stage(docs, "mix-rows").select("*", first.alias("h1"), second.alias("h2"))


def _targets(weighed: DataFrame, weights: Sequence[float], most: int, share: float) -> tuple[DataFrame, bool]:
    """(none, source, source_size, target) and whether it is small enough to broadcast.

    Weights go round by the sources' order of code points (null last).  A source over
    ``most`` times its size stops there and the others share what it leaves, until none
    is above; a round is a sum over the sources' rows.
    """
    sizes = weighed.groupBy("none", "source").agg(F.sum("size").alias("source_size"))
    # Ranks without one sort of all: places within ranges, and the ranges' counts.
    ranged = stage(sizes.repartitionByRange("none", "source").sortWithinPartitions("none", "source").withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = stage(ranged.withColumn("part", part).join(F.broadcast(starts), "part").select("none", "source", "source_size", weight.alias("weight")), "mix-weights")
    known = ranked.agg(F.count("*").alias("n"), F.sum(F.octet_length("source")).alias("bytes"), F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    total, limit = share * (known["total"] or 0), F.col("source_size") * most
    unit, stopped = (total / known["weight"] if known["weight"] else 0.0), 0
    while True:
        over = F.col("weight") * F.lit(unit) > limit
        now = ranked.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, limit)), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if now["n"] == stopped or not now["weight"]:
            break
        stopped, unit = now["n"], (total - now["kept"]) / now["weight"]
    target = F.least(F.col("weight") * F.lit(unit), limit.cast("double"))
    small = known["n"] <= BROADCAST_SOURCES and (known["bytes"] or 0) <= BROADCAST_NAME_BYTES
    return ranked.select("none", "source", "source_size", target.alias("target")), small


def _with_thresholds(weighed: DataFrame, targets: DataFrame, most: int, small: bool) -> DataFrame:
    """``targets`` plus whole passes and the threshold (t1, t2): a document is taken
    once more where its hashes (h1, h2) come before it."""
    hint = F.broadcast if small else lambda df: df
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    rest = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    names = ["none", "source", "source_size", "target", "whole", "rest"]
    zero = F.lit(0).cast("long")
    state = targets.withColumn("whole", whole).withColumn("rest", rest).select(*names, zero.alias("before"), zero.alias("t1"), zero.alias("t2"))
    rows, levels = weighed.select("none", "source", "size", "h1", "h2"), HASH_BITS // BITS
    for level in range(2 * levels):
        hashed, threshold = ("h1", "t1") if level < levels else ("h2", "t2")
        shift = HASH_BITS - BITS * (level % levels + 1)
        bucket = F.shiftright(hashed, shift).bitwiseAND(F.lit((1 << BITS) - 1))
        histogram = rows.withColumn("bucket", bucket).groupBy("none", "source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        below = F.sum("words").over(Window.partitionBy("none", "source").orderBy("bucket")) - F.col("words")  # 1024 rows a source at most
        parts = histogram.withColumn("below", below).join(hint(state.select("none", "source", "rest", "before")), ["none", "source"])
        crossed = (F.col("before") + F.col("below") + F.col("words") >= F.col("rest")) & (F.col("words") > 0) & (F.col("rest") > 0)
        edges = parts.where(crossed).groupBy("none", "source").agg(F.min_by(F.struct("bucket", "below", "words", "n"), "bucket").alias("edge"))
        state = stage(state.drop("edge").join(hint(edges), ["none", "source"], "left").select(
            *names, (F.col("before") + F.coalesce("edge.below", zero)).alias("before"),
            *[(F.col(t) + F.coalesce(F.col("edge.bucket") * (1 << shift), zero) if t == threshold else F.col(t)).alias(t) for t in ("t1", "t2")], "edge"), "mix-state")
        if (state.agg(F.max("edge.n")).first()[0] or 0) <= 1:
            break
        on_edge = state.select("none", "source", F.col("edge.bucket").alias("bucket")).where("bucket is not null")
        rows = stage(rows.withColumn("bucket", bucket).join(hint(on_edge), ["none", "source", "bucket"]).drop("bucket"), "mix-boundary")
    # The last boundary bucket, one document, goes to the side that is nearer to the target.
    nearer = F.col("before") + F.col("edge.words") - F.col("rest") < F.col("rest") - F.col("before")
    return stage(state.select(*names, *[(F.col(t) + F.when(nearer, 1 << shift).otherwise(0) if t == threshold else F.col(t)).alias(t) for t in ("t1", "t2")]), "mix-plan")


def _mixed(docs: DataFrame, keep: Sequence[str], weights, most, share, seed) -> DataFrame:
    """The columns ``keep`` (as k0, k1, ...), size, source_size, target and copies."""
    inner = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col("source").isNull().alias("none"),
                        count_words(F.col("text")).alias("size"), *[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)])
    rows = _keyed(inner, seed)
    narrow = "text" not in keep
    weighed = stage(rows.select("none", "source", "size", "h1", "h2", *([f"k{k}" for k in range(len(keep))] if narrow else [])), "mix-weighed")
    targets, small = _targets(weighed, weights, most, share)
    plan = _with_thresholds(weighed, targets, most, small)
    taken = (F.col("h1") < F.col("t1")) | ((F.col("h1") == F.col("t1")) & (F.col("h2") < F.col("t2")))
    out = (weighed if narrow else rows).join(F.broadcast(plan) if small else plan, ["none", "source"])
    return out.withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, share: float = 1.0, seed: int = 20240501) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` plus ``_copies`` long, how many times the mix
    takes the document (0 to ``most``).

    A document weighs its words.  The sources, by code point and null last, have the
    ``weights`` in turn, and by these share ``share`` of all words; a source gets
    ``most`` times its words at most, the others share what that leaves.  A source's
    words taken differ from its target by half of one document at most.  The same
    files, whatever their folder, give the same mix; a smaller ``share`` gives no
    document more copies unless its source's target is larger.

    Null ids are ids like any others and rows with equal ids are told apart by their
    file and place, so large groups of copies are split at the boundary.  Null and
    empty texts weigh nothing (their copies follow the same rule); long texts are
    counted whole; the empty source isn't the null one.  An empty table gives none.
    Extra columns may have any names; ``_copies`` is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != "_copies"]
    out = _mixed(docs, columns, weights, most, share, seed)
    return out.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(columns)], F.col("copies").alias("_copies"))


def op11_mixing(spark, sf_dir):
    """All documents mixed by the weights 5, 2, 1."""
    out = _mixed(table(spark, sf_dir, "documents"), ["doc_id"], (5, 2, 1), 3, 1.0, 20240501)
    return out.select(F.col("k0").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP11_SQL = r"""
with recursive docs as (select doc_id, coalesce(source, '') as source, source is null as none, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) as size,
    ('0x' || substr(md5('20240501:' || cast(doc_id as varchar)), 1, 15))::bigint as h from documents),
sources as (select *, [5, 2, 1][1 + (row_number() over (order by none, source) - 1) % 3] as w from (select none, source, sum(size)::bigint as source_size from docs group by all)),
level as (select 0 as round, (select sum(source_size)::double from sources) / (select sum(w) from sources) as unit
    union all
    select round + 1, ((select sum(source_size) from sources) - (select coalesce(sum(3 * source_size), 0) from sources where w * unit > 3 * source_size))::double / (select sum(w) from sources where w * unit <= 3 * source_size)
    from level where round < 40 and exists (select 1 from sources where w * unit <= 3 * source_size)),
targets as (select none, source, source_size, least(w * unit, 3.0 * source_size)::double as target from sources, (select unit from level where unit is not null order by round desc limit 1)),
plan as (select *, case when source_size > 0 then least(floor(target / source_size), 3)::bigint else 0 end as whole from targets),
summed as (select d.*, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0) as rest, sum(size) over (partition by none, source order by h) as upto from docs d join plan p using (none, source)),
marked as (select *, upto <= rest or (upto - size < rest and upto - rest < rest - (upto - size)) as more from summed)
select doc_id, size, source_size, target, (size * (whole + more::int))::bigint as taken, whole + more::int as copies from marked
"""
