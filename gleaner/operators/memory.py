"""Memory tables and deferred references (M and E operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.sanitize import sanitize_json
from .corpus import is_safe
from .stage import kept

INLINE_BYTES = 131_072


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """The last write of each key, with the time of its first.  Aggregates that
    each task begins on its own, so a key with very many writes isn't gathered."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_last"), F.min("written_at").alias("created_at"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest if c != "created_at"], "created_at").select(*[c for c in log.columns if c != "created_at"], "created_at")


def numbered_decisions(log: DataFrame) -> DataFrame:
    """(seq, namespace, decision_no): decisions with their arrival number in their
    namespace.  Ranges of (namespace, seq) are sorted and numbered where they are, then
    moved up by what the namespace has in the ranges before: no task holds a namespace."""
    ranged = log.select("namespace", "seq").repartitionByRange("namespace", "seq").sortWithinPartitions("namespace", "seq")
    rows = kept(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    spans = rows.groupBy("namespace", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    so_far = F.coalesce(F.sum("_n").over(Window.partitionBy("namespace").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("namespace", "_part", "_first", so_far.alias("_before"))
    return rows.join(spans, ["namespace", "_part"]).select("seq", "namespace", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("decision_no"))


def live(log: DataFrame, as_of: Column, most: int) -> DataFrame:
    """Unexpired rows of each namespace in order of arrival, ``most`` at most."""
    kept = log.where((F.col("ttl_days") == 0) | (F.col("written_at") + F.make_dt_interval(F.col("ttl_days").cast("int")) >= as_of))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("namespace").orderBy("seq"))).where(F.col("_r") <= most).drop("_r")


def effective_decisions(log: DataFrame) -> DataFrame:
    """For each topic a human's word over a model's, then confidence, then recency,
    then the earlier arrival."""
    rest = [c for c in log.columns if c not in ("namespace", "key")]
    order = F.struct((F.col("decided_by") == "human").alias("a"), "confidence", "written_at", (-F.col("seq")).alias("d"))
    best = log.groupBy("namespace", "key").agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select("namespace", "key", *[F.col("_best")[c].alias(c) for c in rest]).select(*log.columns)


def expired(log: DataFrame, as_of: Column) -> DataFrame:
    """M06."""
    return log.where((F.col("ttl_days") != 0) & (F.col("written_at") + F.make_dt_interval(F.col("ttl_days").cast("int")) < as_of))


def stale_paths(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Files that facts name and the corpus lacks."""
    return facts.select("key", F.explode("file_paths").alias("path")).join(files.select("path"), "path", "left_anti")


def missing_metadata(facts: DataFrame) -> DataFrame:
    """(seq, issue) for each source, confidence or time that a fact lacks."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    issues = F.array_compact(F.array(*[F.when(blank(c), F.lit(f"missing_{c}")) for c in ("source", "confidence", "created_at", "updated_at")]))
    return facts.select("seq", F.explode(issues).alias("issue"))


def path_issues(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(key, path, issue) of files that facts name and that leave the root
    (unsafe_path) or aren't in the corpus (stale_path)."""
    each = facts.select("key", F.explode("file_paths").alias("path")).join(files.select("path"), "path", "left_anti")
    return each.select("key", "path", F.when(is_safe(F.col("path")), "stale_path").otherwise("unsafe_path").alias("issue"))


def safe_writes(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted writes with value, source and tags redacted, and (seq, reason) of the
    rejected ones, whose namespace or key holds what redaction would change."""
    bad = T.is_sensitive(F.col("namespace")) | T.is_sensitive(F.col("key"))
    good = writes.where(~F.coalesce(bad, F.lit(False)))
    value = sanitize_json(F.col("value"))
    accepted = good.withColumn("_v", value).withColumns({"value": F.col("_v.json"), "redacted": F.col("_v.count") > 0, "source": T.redact(F.col("source")), "tags": F.transform("tags", T.redact)}).drop("_v")
    return accepted, writes.where(bad).select("seq", F.lit("sensitive_identifier").alias("reason"))


def upserts(writes: DataFrame, key: str = "key", content: str = "value", bounded: bool = True) -> tuple[DataFrame, DataFrame]:
    """The stored facts after all ``writes(seq, namespace, key, value, confidence,
    source, tags, ttl_days, written_at)`` in order of ``seq``, and (seq, reason) of the
    rejected ones.

    Namespace and key are trimmed and must be there and hold nothing that redaction would
    change; the confidence (null: 1) must lie in 0 to 1 where ``bounded``.  The last
    accepted write of an identity gives its value, source (null: agent) and tags (null:
    none), redacted; ``created_at`` is its first's time, ``first_seq`` its place among
    insertions.  A null ``ttl_days`` never expires.  Values are redacted after the
    aggregate, so only those that stay."""
    space, name = (T.strip(F.coalesce(c, F.lit(""))) for c in ("namespace", key))
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(1.0))
    reason = F.when(space == "", "missing_namespace").when(T.is_sensitive(space), "sensitive_namespace").when(name == "", f"missing_{key}").when(T.is_sensitive(name), f"sensitive_{key}")
    if bounded:
        reason = reason.when((sure < 0) | (sure > 1) | F.isnan(sure), "confidence_out_of_range")
    judged = writes.select("seq", space.alias("namespace"), name.alias(key), F.col(content).alias("_content"), sure.alias("confidence"), "source", "tags", "ttl_days", "written_at", reason.alias("_reason"))
    last = F.max_by(F.struct("seq", "_content", "confidence", "source", "tags", "ttl_days", "written_at"), "seq")
    rows = judged.where("_reason is null").groupBy("namespace", key).agg(last.alias("_last"), F.min(F.struct("seq", "written_at")).alias("_first")).select("namespace", key, "_last.*", F.col("_first.seq").alias("first_seq"), F.col("_first.written_at").alias("created_at"))
    source, tags = F.coalesce("source", F.lit("agent")), F.coalesce("tags", F.array().cast("array<string>"))
    rows = rows.withColumn("_v", sanitize_json(F.col("_content")))
    seen = T.merge_categories(F.concat(F.array(F.coalesce("_v.categories", F.array().cast("array<string>")), T.redaction_categories(source)), F.transform(tags, T.redaction_categories)))
    stored = rows.select(
        "seq", "first_seq", "namespace", key, F.col("_v.json").alias(content), "confidence", T.redact(source).alias("source"), F.transform(tags, T.redact).alias("tags"), "created_at", F.col("written_at").alias("updated_at"),
        (F.col("written_at") + F.make_dt_interval(F.col("ttl_days").cast("int"))).alias("expires_at"), seen.alias("categories"), (F.size(seen) > 0).alias("redacted"))
    return stored, judged.where("_reason is not null").select("seq", F.col("_reason").alias("reason"))


def summary_upserts(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``upserts``, by namespace and ``focus``, of ``summary``; any confidence."""
    return upserts(writes, "focus", "summary", bounded=False)


def get(facts: DataFrame, summaries: DataFrame, decisions: DataFrame, as_of: Column, most: int = 100, include_expired: bool = False) -> DataFrame:
    """(kind, namespace, place, name, seq, expired): of each namespace and kind the
    first ``most`` rows that haven't expired (or all, flagged).  Facts and summaries, as
    ``upserts`` stores them, come by insertion.  Of ``decisions(seq, namespace, topic,
    decided_by, confidence, updated_at, expires_at)`` each topic's effective one comes, a
    human's first, then by confidence, recency and arrival."""
    def part(rows: DataFrame, kind: str, name: str) -> DataFrame:
        out = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
        return rows.where(F.lit(include_expired) | ~out).withColumn("kind", F.lit(kind)).withColumn("name", F.col(name)).withColumn("expired", out)

    columns = ("kind", "namespace", "name", "seq", "expired", "_order")
    made = [part(rows, kind, name).withColumn("_order", F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("c"), F.col("first_seq").alias("d"))).select(*columns) for rows, kind, name in ((facts, "fact", "key"), (summaries, "summary", "focus"))]
    order = F.struct(F.when(F.col("decided_by") == "human", 0).otherwise(1).alias("a"), (-F.coalesce("confidence", F.lit(0.0))).alias("b"), (-F.coalesce(F.unix_micros("updated_at"), F.lit(0))).alias("c"), F.col("seq").alias("d"))
    live_ones = part(decisions, "decision", "topic").withColumn("_order", order)
    best = live_ones.groupBy("namespace", "name").agg(F.min_by(F.struct("kind", "seq", "expired", "_order"), "_order").alias("_b"))
    made.append(best.select(F.col("_b.kind"), "namespace", "name", F.col("_b.seq"), F.col("_b.expired"), F.col("_b._order")))
    rows = made[0].unionByName(made[1]).unionByName(made[2])
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("namespace", "kind").orderBy("_order"))).where(F.col("place") <= most)
    return placed.select("kind", "namespace", "place", "name", "seq", "expired")


def compact(log: DataFrame, threshold: int = 40, keep: int = 12, most: int = 1200) -> DataFrame:
    """Namespaces with more than ``threshold`` facts: bullets of the best ``keep``."""
    # the count is an aggregate of its own, so that each task keeps its best ``keep`` rows before the exchange
    w = Window.partitionBy("namespace").orderBy(F.desc("confidence"), F.desc("written_at"), "seq")
    large = log.groupBy("namespace").agg(F.count("*").alias("_n")).where(F.col("_n") > threshold).select("namespace")
    best = log.select("namespace", "key", "value", "confidence", "written_at", "seq").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).join(large, "namespace", "left_semi")
    bullet = F.concat(F.lit("- "), "key", F.lit(": "), F.substring("value", 1, 160))
    rows = best.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("_r", bullet.alias("b")))).alias("bs"))
    return rows.select("namespace", F.substring(F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), 1, most).alias("content"))


def compaction_writes(log: DataFrame, as_of: Column, **limits) -> DataFrame:
    """``compact``'s texts as writes for ``summary_upserts``: focus auto_compact, 60
    days, confidence 0.9, after all else (the greatest ``seq``)."""
    made = compact(log, **limits)
    return made.select(
        F.lit(2**62).alias("seq"), "namespace", F.lit("auto_compact").alias("focus"), F.col("content").alias("summary"), F.lit(0.9).alias("confidence"), F.lit("memory.compact").alias("source"),
        F.array(F.lit("auto"), F.lit("compact")).alias("tags"), F.lit(60).alias("ttl_days"), as_of.alias("written_at"))


def reference_status(invalidated: Column, hours_left: Column) -> Column:
    """E04."""
    return F.when(invalidated, "stale").when(hours_left < 0, "expired").otherwise("active")


def storage(size: Column) -> Column:
    """Large bodies go to files of their own."""
    return F.when(size > INLINE_BYTES, "file").otherwise("inline")


def split_bodies(references: DataFrame, most: int = INLINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The references, large ones without their body, and the bodies that go to
    files of their own."""
    large = F.col("size_bytes") > most
    rows = references.withColumn("storage", F.when(large, "file").otherwise("inline")).withColumn("body", F.when(~large, F.col("body")))
    return rows, references.where(large).select("reference_id", "sha256", "body")


def newest(references: DataFrame, n: int) -> DataFrame:
    """E03."""
    return references.orderBy(F.desc("created_seq")).limit(n).withColumn("status", reference_status(F.col("invalidated"), F.col("hours_left")))


def resolve(wanted: DataFrame, references: DataFrame, as_of: Column, envelope: str = "reference.envelope.v1") -> DataFrame:
    """Outcome and reason for each of ``wanted(reference_id, expected_hash,
    provided_expires_at)``, by the first rule that holds.  The stored text must be there,
    have its hash and be JSON; if its ``schema`` is ``envelope``, the expiry and the id in
    its metadata count too."""
    stored = references.select("reference_id", "body", "sha256", "invalidated", "hours_left", F.lit(True).alias("_there"))
    j = wanted.join(stored, "reference_id", "left").withColumn("_actual", F.sha2("body", 256))
    wrapped = F.get_json_object("body", "$.schema").eqNullSafe(F.lit(envelope))
    expiry = F.try_to_timestamp(F.get_json_object("body", "$.metadata.expires_at"))
    inner_id = F.nullif(F.get_json_object("body", "$.metadata.reference_id"), F.lit(""))
    empty = F.coalesce(F.col("body"), F.lit("")) == ""
    rules = (
        (~F.coalesce(F.col("reference_id").rlike("^ref_[A-Za-z0-9]+$"), F.lit(False)), "invalid_reference", None), (F.col("provided_expires_at") < as_of, "expired", "provided_reference_expired"),
        (F.col("_there").isNull(), "missing", None), (F.col("invalidated"), "stale", "invalidated"), (F.col("hours_left") < 0, "expired", "expired"), (empty, "stale", "payload_unavailable"),
        (F.col("_actual") != F.col("sha256"), "stale", "stored_hash_mismatch"), (F.try_parse_json("body").isNull(), "stale", "invalid_json_payload"), (wrapped & (expiry < as_of), "expired", "envelope_expired"),
        (wrapped & (inner_id != F.col("reference_id")), "invalid_reference", None), ((F.col("expected_hash") != "") & (F.col("_actual") != F.col("expected_hash")), "hash_mismatch", None),
    )
    which = F.lit(len(rules))
    for k in reversed(range(len(rules))):
        which = F.when(rules[k][0], k).otherwise(which)
    label = lambda n: F.get(F.array(*[F.lit(r[n]) for r in (*rules, (None, "resolved", None))]), F.col("_rule"))
    return j.withColumn("_rule", which).select("reference_id", label(1).alias("outcome"), label(2).alias("reason"))
