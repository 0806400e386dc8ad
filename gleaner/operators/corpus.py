"""Corpus maintenance and predicates (S and P operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
SKIP_DIRS = (".cache", ".git", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "venv")
SECRET_FILES = (".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_dsa", "id_ecdsa", "id_ed25519", "id_rsa")
SECRET_SUFFIXES = (".key", ".pem", ".p12", ".pfx")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".md": "markdown", ".rst": "rst", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}


def excluded(path: Column, state_dir: str = ".gleaner") -> Column:
    """Whether a path must not be read: run-time folders, the folder of our own
    state, and credentials, whose names count in any case."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    skip = F.arrays_overlap(parts, F.array(*map(F.lit, (*SKIP_DIRS, state_dir)))) | F.exists(parts, lambda p: p.endswith(".egg-info"))
    suffix = None
    for s in SECRET_SUFFIXES:
        suffix = name.endswith(s) if suffix is None else suffix | name.endswith(s)
    return skip | (name == ".env") | name.startswith(".env.") | name.isin(*SECRET_FILES) | suffix


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """Language by suffix, else the suffix without its dot, else text."""
    ext = extension(path)
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.nullif(F.regexp_replace(ext, r"^\.", ""), F.lit("")), F.lit("text"))


def is_binary(content: Column) -> Column:
    """A NUL in the first 4096 bytes of a binary column."""
    return F.contains(F.substring(content, 1, 4096), F.lit(b"\x00"))


# Suffixes of files that are read as text beside those without any
TEXT_SUFFIXES = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".php", ".rb", ".swift", ".kt", ".kts", ".sh", ".bash", ".zsh", ".ps1", ".sql", ".html", ".css", ".scss",
    ".md", ".rst", ".txt", ".toml", ".yaml", ".yml", ".json", ".ini", ".cfg", ".xml", ".csv", ".dockerfile",
)


def is_text_name(path: Column) -> Column:
    """No suffix, or one of the text suffixes in any case."""
    return extension(path).isin("", *TEXT_SUFFIXES)


def in_listing_order(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` paths in depth-first name order."""
    return files.orderBy(F.split("path", "/")).limit(n)


def listing(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files by path."""
    from ..functions import text as T

    return files.select("path", "size", extension(F.col("path")).alias("extension"), language(F.col("path")).alias("language"), F.size(T.lines(F.col("content"))).alias("line_count")).orderBy("path").limit(n)


def visible(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Rows whose path is still listed and isn't excluded."""
    return rows.where(~excluded(F.col("path"))).join(current.select("path"), "path", "left_semi")


def refresh_counts(diff: DataFrame) -> DataFrame:
    """How many paths are new, updated, unchanged and removed."""
    return diff.groupBy("change").agg(F.count("*").alias("n"))


def status(files: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Files, symbols, imports (if given) and the newest change of each project."""
    out = files.groupBy("project_id").agg(F.count("*").alias("files"), F.max("mtime_ns").alias("newest"))
    for name, rows in (("symbols", symbols), ("imports", imports)):
        if rows is not None:
            # a file's rows are counted before they meet the files
            per = rows.groupBy("path").agg(F.count("*").alias("n")).join(files.select("path", "project_id"), "path").groupBy("project_id").agg(F.sum("n").alias(name))
            out = out.join(per, "project_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.select("project_id", "files", *[c for c in ("symbols", "imports") if c in out.columns], "newest")


def refresh_diff(old: DataFrame, new: DataFrame, scope: str = "") -> DataFrame:
    """Each path with new, updated, unchanged or removed; rows outside
    ``scope`` (a file or folder) stay out of both sides.  A path whose ``has_summary``
    (if ``old`` has that column) is false is updated, whatever its size and time."""
    inside = lambda df: df.where(in_scope(F.col("path"), scope)) if scope else df
    a = inside(old).select("path", F.col("size").alias("s0"), F.col("mtime_ns").alias("m0"), (F.coalesce("has_summary", F.lit(False)) if "has_summary" in old.columns else F.lit(True)).alias("made"))
    b = inside(new).select("path", F.col("size").alias("s1"), F.col("mtime_ns").alias("m1"))
    label = F.when(F.col("m1").isNull(), "removed").when(F.col("m0").isNull(), "new").when((F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1")) & F.col("made"), "unchanged").otherwise("updated")
    return a.join(b, "path", "full").select("path", label.alias("change"))


def apply_diff(derived: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """Derived rows of unchanged paths, and fresh ones of new and updated paths."""
    kept = derived.join(diff.where("change <> 'unchanged'"), "path", "left_anti")
    return kept.unionByName(fresh.join(diff.where("change in ('new', 'updated')"), "path", "left_semi"))


def signature(files: DataFrame) -> DataFrame:
    """A hash of each project's listing: rows are hashed in 65536 buckets of
    paths, the buckets' hashes then hashed, so no group holds a whole project."""
    row = F.concat_ws(":", "path", "size", "mtime_ns")
    bucket = F.substring(F.sha2("path", 256), 1, 4)
    per = files.groupBy("project_id", bucket.alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("h"))
    return per.groupBy("project_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("signature"))


def refresh_gate(current: DataFrame, stored: DataFrame, force: bool = False, scoped: bool = False) -> DataFrame:
    """Why each project is refreshed or not."""
    j = current.select("project_id", F.col("signature").alias("now")).join(stored.select("project_id", F.col("signature").alias("before")), "project_id", "left")
    reason = F.when(F.lit(force), "forced").when(F.lit(scoped), "scoped_refresh").when(F.col("now").isNull(), "signature_unavailable").when(F.col("now") == F.col("before"), "signature_unchanged").otherwise("signature_changed")
    return j.select("project_id", reason.alias("reason"), (reason != "signature_unchanged").alias("refresh"))


def in_scope(path: Column, scope: str) -> Column:
    """The scope itself or below it; empty or . is everything."""
    return F.lit(True) if scope in ("", ".") else (path == scope) | path.startswith(scope.rstrip("/") + "/")


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression; * crosses /."""
    special = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(special.get(c, "\\" + c if c in ".^$+{}[]|()\\" else c) for c in glob) + "$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    out = F.lit(not globs)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def glob_pattern(glob: Column) -> Column:
    """``glob_regex`` of a column, with [seq] and [!seq]; an open [ is itself."""
    out = F.regexp_replace(glob, r"([\\.^$+{}|()&])", r"\\$1")
    out = F.regexp_replace(out, r"\[(?![^\]]+\])", r"\\[")
    out = F.regexp_replace(F.regexp_replace(out, r"\*(?![^\[]*\])", ".*"), r"\?(?![^\[]*\])", ".")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(out, r"\[!", "[^"), F.lit(r"\z"))


def within(path: Column, scope: Column, globs: Column) -> Column:
    """P01 and P02 by columns: at or under ``scope`` (null, empty or . is everything) and
    by any of ``globs`` (null or empty is everything)."""
    root = F.coalesce(F.regexp_replace(scope, "/+$", ""), F.lit(""))
    inside = root.isin("", ".") | (path == root) | path.startswith(F.concat(root, F.lit("/")))
    return inside & (F.coalesce(F.size(globs), F.lit(0)).cast("int").isin(0, -1) | F.exists(globs, lambda g: F.regexp_like(path, glob_pattern(g))))


def min_depth(path: Column) -> Column:
    """The least depth a path reaches; below 0 it leaves the root."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("low"))
    step = lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(0)).alias("low"))
    return F.aggregate(F.split(path, "/"), start, step)["low"]


def is_safe(path: Column) -> Column:
    return ~path.startswith("/") & (min_depth(path) >= 0)


def is_expired(expires_at: Column, as_of: Column) -> Column:
    """Past its time; no time never expires."""
    return F.coalesce(expires_at < as_of, F.lit(False))


def confidence_bucket(score: Column, confidence: Column) -> Column:
    """P07."""
    best = F.greatest(score / 14, confidence)
    return F.when(best >= 0.8, "high").when(best >= 0.45, "medium").otherwise("low")


def content_budget(profile: Column, chars: Column, tokens: Column) -> Column:
    """P13."""
    return F.when(profile == "minimal", F.greatest(F.lit(500), F.least(chars - 500, tokens * 4))).otherwise(F.greatest(F.lit(1000), chars - 2400))
