"""Projects found in listings (J operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ancestors(paths: DataFrame) -> DataFrame:
    """(path, root, depth) for each folder above a path."""
    p = F.split("path", "/")
    rows = paths.select("path", p.alias("p")).where(F.size("p") > 1)
    return rows.select("path", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth")).select("path", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("root"), "depth")


def discover(files: DataFrame, markers: list[str], max_depth: int = 4) -> DataFrame:
    """Folders that hold a marker file, without those below another one."""
    name = F.element_at(F.split("path", "/"), -1)
    roots = files.where(name.isin(*markers)).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().where(F.size(F.split("path", "/")) <= max_depth)
    below = ancestors(roots).join(roots.select(F.col("path").alias("root")), "root", "left_semi").select("path")
    return roots.join(below, "path", "left_anti")


def discover_under(listing: DataFrame, scan_roots: DataFrame, markers: list[str], max_depth: int = 4, most: int = 100) -> DataFrame:
    """(scan_root, root, origin) of the projects under ``scan_roots(pos, root,
    mapped)``: folders with a ``.git`` (discovered_git) or another of ``markers``
    (discovered_marker), file or folder, ``max_depth`` below their root at most and under
    no folder whose name begins with a dot; the shallowest count.  A mapped scan root that
    has but a ``.git`` yields to projects below it.  A folder under two scan roots is the
    first one's; the first ``most`` come, by scan root and then by names."""
    s = F.split("path", "/")
    at = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.get("s", k).isin(*markers) & (k > 0))
    marks = listing.select(s.alias("s")).where(F.exists("s", lambda x: x.isin(*markers))).select("s", F.explode(at).alias("k"))
    marks = marks.select(F.array_join(F.slice("s", F.lit(1), F.col("k")), "/").alias("path"), (F.get("s", F.col("k")) == ".git").alias("git"))
    folders = marks.groupBy("path").agg(F.bool_or("git").alias("git"), F.bool_or(~F.col("git")).alias("other"))
    up = ancestors(folders.select("path")).select("path", "root").unionByName(folders.select("path", F.col("path").alias("root")))
    found = up.join(scan_roots.select("pos", "root", "mapped"), "root").join(folders, "path")
    below = F.slice(F.split("path", "/"), F.size(F.split("root", "/")) + 1, F.greatest(F.size(F.split("path", "/")) - F.size(F.split("root", "/")), F.lit(0)))
    found = found.where((F.size(below) <= max_depth) & ~F.exists(below, lambda x: x.startswith(".")))
    deeper = found.where(F.col("path") != F.col("root")).select("pos").distinct().withColumn("children", F.lit(True))
    yields = (F.col("path") == F.col("root")) & F.col("mapped") & ~F.col("other") & F.coalesce("children", F.lit(False))
    found = found.join(deeper, "pos", "left").where(~yields).select("pos", F.col("root").alias("scan_root"), "path", F.when(F.col("git"), "discovered_git").otherwise("discovered_marker").alias("origin"))
    nested = ancestors(found.select("path").distinct()).select("path", F.col("root").alias("over"))
    hidden = found.select("pos", "path").join(nested, "path").join(found.select("pos", F.col("path").alias("over")), ["pos", "over"], "left_semi").select("pos", "path")
    first = found.join(hidden, ["pos", "path"], "left_anti").groupBy("path").agg(F.min(F.struct("pos", "scan_root", "origin")).alias("f"))
    return first.orderBy("f.pos", F.split("path", "/")).limit(most).select("f.scan_root", F.col("path").alias("root"), "f.origin")


def assign(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The shallowest root above each file."""
    return ancestors(files).join(roots.select(F.col("path").alias("root")), "root").groupBy("path").agg(F.min_by("root", "depth").alias("root"))


def map_longest(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each path under the longest mapped prefix, in its local place."""
    hit = ancestors(paths).join(mappings, F.col("root") == F.col("host_prefix")).groupBy("path").agg(F.max_by(F.struct("host_prefix", "local_prefix"), "depth").alias("m"))
    return hit.select("path", F.concat("m.local_prefix", F.expr("substring(path, length(m.host_prefix) + 1)")).alias("local_path"))


def allowed(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths at or under an allowed root."""
    up = ancestors(paths).select("path", "root").unionByName(paths.select("path", F.col("path").alias("root")))
    return up.join(roots.select(F.col("allowed").alias("root")), "root", "left_semi").select("path").distinct()
