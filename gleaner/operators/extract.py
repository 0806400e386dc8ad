"""Tables made from file contents (X operators)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import corpus

MAX_TERMS = 4000
SUMMARY_CHARS = 480
#: Rows that a Python worker gathers before it hands them on.
PYTHON_ROWS = 10_000


def postings(files: DataFrame, max_terms: int | None = MAX_TERMS, by_path: bool = False) -> DataFrame:
    """(path, term, first_line, tf).  A file's terms stop after the line in which
    it reaches ``max_terms`` different ones (None: never); words of the path count at line 1.
    Texts are exchanged by path, not their terms; ``by_path``: they already were."""
    lines = F.coalesce(F.split(F.lower("content"), T.LINE_BREAK, -1), F.array().cast("array<string>"))
    if max_terms is not None:
        # fewer characters can't hold so many terms
        lines = T.bound(lines, lambda ls: F.when(F.length("content") < T.TOKEN_CHARS * max_terms + max_terms - 1, ls).otherwise(_until(ls, max_terms)))
    # the path stands before the first line
    rows = (files if by_path else files.repartition("path")).select("path", F.posexplode(F.concat(F.array(F.lower("path")), lines)).alias("line_no", "line"))
    rows = rows.select("path", F.greatest("line_no", F.lit(1)).alias("line_no"), F.explode(T.lower_tokens(F.col("line"))).alias("term"))
    return rows.groupBy("path", "term").agg(F.min("line_no").alias("first_line"), F.count("*").alias("tf"))


def _until(lines: Column, most: int) -> Column:
    """The lines up to that of the ``most``-th different term, in the file's own row."""
    tokens = F.flatten(F.transform(lines, lambda line, i: F.transform(T.lower_tokens(line), lambda t: F.struct(t.alias("term"), i.alias("i")))))

    def cut(s: Column) -> Column:
        """``s``: the tokens sorted, so the first of equal terms stands in its first line."""
        firsts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k)["term"] != F.get(s, k - 1)["term"])), lambda k: F.get(s, k)["i"]))
        return F.slice(lines, 1, F.get(firsts, F.lit(most - 1)) + 1)

    terms = F.flatten(F.transform(lines, T.lower_tokens))
    return F.when(F.size(F.array_distinct(terms)) < most, lines).otherwise(T.bound(F.sort_array(tokens), cut))


def with_excerpts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``postings`` plus the excerpt, 240 characters of the first line.  A file's
    lines stay one array, so they are joined once a file."""
    lines = files.select("path", T.lines(F.col("content")).alias("_ls"))
    return rows.join(lines, "path").withColumn("excerpt", F.substring(T.strip(F.get("_ls", F.col("first_line").cast("int") - 1)), 1, 240)).drop("_ls")


def generic_symbols(files: DataFrame) -> DataFrame:
    """Functions and classes by pattern, line by line."""
    # an empty line after the last end holds none
    each = files.select("path", F.posexplode(F.split("content", T.LINE_BREAK, -1)).alias("i", "line"))
    patterns = (("function", r"\bfunction\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1, ("function",)), ("function", r"\bdef\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1, ("def",)), ("class", r"\b(class|struct|interface)\s+([A-Za-z_][A-Za-z0-9_]*)", 2, ("class", "struct", "interface")))
    holds = lambda words: reduce(or_, [F.contains("line", F.lit(w)) for w in words])
    each = each.where(holds([w for *_, words in patterns for w in words]))  # most lines have none of the words
    found = F.array_compact(F.array(*[F.when(holds(words) & F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, g).alias("name"))) for k, p, g, words in patterns]))
    return each.select("path", (F.col("i") + 1).alias("line_start"), F.substring(F.trim("line"), 1, 160).alias("signature"), F.explode(found).alias("s")).select("path", "s.name", "s.kind", "line_start", F.col("line_start").alias("line_end"), "signature")


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes and imports of Python files, by the standard
    parser; files that don't parse give no rows.  A worker holds the rows of a few files."""
    most = PYTHON_ROWS

    def run(batches):
        import ast

        import pyarrow as pa

        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
        columns = {"path": pa.string(), "name": pa.string(), "kind": pa.string(), "line_start": pa.int32(), "line_end": pa.int32(), "signature": pa.string()}
        rows = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(columns), columns.values(), strict=True)], names=list(columns))
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                path, content = path.as_py(), content.as_py() or ""
                try:
                    tree = ast.parse(content)
                except (SyntaxError, ValueError):
                    continue
                text, todo = content.splitlines(), tree.body
                while todo:  # statements alone: no other node holds a definition or an import
                    inner = []
                    for node in todo:
                        kind = type(node)
                        if kind is ast.Import:
                            rows += [(path, a.name.split(".")[0], "import", node.lineno, node.lineno, "") for a in node.names]
                        elif kind is ast.ImportFrom:
                            if node.module:
                                rows.append((path, node.module.split(".")[0], "import", node.lineno, node.lineno, ""))
                        else:
                            if kind in kinds:
                                rows.append((path, node.name, kinds[kind], node.lineno, node.end_lineno, text[node.lineno - 1].strip()[:160]))
                            for part in node._fields:
                                if part in ("body", "handlers", "orelse", "finalbody", "cases"):
                                    inner += getattr(node, part)
                    todo = inner
                if len(rows) >= most:  # not a whole batch of files
                    yield made()
                    rows.clear()
        yield made()

    return files.select("path", "content").mapInArrow(run, "path string, name string, kind string, line_start int, line_end int, signature string")


def _summary(rows: DataFrame, *keys: str) -> DataFrame:
    """What both summaries share: ``rows`` with the picked lines, symbols' title if any,
    become title, redacted content, its flags and signals."""
    raw = F.array_join("picked", "\n")
    content = T.redact(T.trim_text(raw, SUMMARY_CHARS))
    title = F.coalesce("symbol", F.get("picked", F.lit(0)), F.element_at(F.split("path", "/"), -1))
    rows = rows.select(*keys, "start_line", "end_line", F.substring(title, 1, 160).alias("title_hint"), content.alias("content"), F.col("chars").alias("source_chars"), T.is_trimmed(raw, SUMMARY_CHARS).alias("truncated"), T.redaction_categories(T.trim_text(raw, SUMMARY_CHARS)).alias("redactions"))
    return rows.withColumn("signals", T.injection_signals(F.col("content")))


def _with_symbol(rows: DataFrame, symbols: DataFrame | None) -> DataFrame:
    """``rows`` plus the first symbol's signature (else name) of the path, if any."""
    if symbols is None:
        return rows.withColumn("symbol", F.lit(None).cast("string"))
    first = symbols.groupBy("path").agg(F.min(F.struct("line_start", F.coalesce(F.nullif("signature", F.lit("")), "name").alias("symbol")))["symbol"].alias("symbol"))
    return rows.join(first, "path", "left")


def head_summary(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The first non-blank lines, stripped, until there are four or they have 480
    characters; redacted, with title, length of the source and signals.  A file
    without any gives its name."""
    full = F.filter(F.transform(T.lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("n"), T.strip(x).alias("t"))), lambda x: x["t"] != "")
    rows = files.select("path", F.size(T.lines(F.col("content"))).alias("lines"), F.length("content").alias("chars"), F.slice(full, 1, 4).alias("h"))
    before = lambda i: F.length(F.array_join(F.transform(F.slice("h", 1, i), lambda x: x["t"]), "\n"))
    rows = rows.withColumn("picked", F.transform(F.filter("h", lambda x, i: (i == 0) | (before(i) < SUMMARY_CHARS)), lambda x: x["t"]))
    start = F.coalesce(F.get("h", F.lit(0))["n"], F.lit(1))
    rows = rows.withColumn("start_line", start).withColumn("end_line", F.least("lines", start + F.greatest(F.size("picked") - 1, F.lit(0))))
    return _summary(_with_symbol(rows, symbols), "path")


def anchored_summary(files: DataFrame, anchors: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Six lines from two before the anchor (which lies in the file), treated as
    in X05; each (path, anchor) once, whoever asks for it (C15)."""
    rows = anchors.select("path", "anchor").distinct().join(files.select("path", T.lines(F.col("content")).alias("ls"), F.length("content").alias("chars")), "path")
    start = F.greatest(F.lit(1), F.least("anchor", F.greatest(F.lit(1), F.size("ls"))) - 2)
    rows = rows.select("path", "anchor", "chars", start.alias("start_line"), F.least(start + 5, F.size("ls")).alias("end_line"), F.slice("ls", start, 6).alias("picked"))
    return _summary(_with_symbol(rows, symbols), "path", "anchor")


def file_records(files: DataFrame, indexed_at, symbols: DataFrame | None = None) -> DataFrame:
    """One row a file with digest, kind, lines, summary (a struct) and its terms."""
    head = head_summary(files, symbols)
    summary = head.select("path", F.struct(*[c for c in head.columns if c != "path"]).alias("summary"))
    rows = files.select("path", "size", "mtime_ns", F.sha2("content", 256).alias("sha256"), corpus.extension(F.col("path")).alias("extension"), corpus.language(F.col("path")).alias("language"), F.size(T.lines(F.col("content"))).alias("line_count"), indexed_at.alias("indexed_at"), "content", F.array_sort(F.array_distinct(T.index_tokens(F.col("content")))).alias("terms"))
    return rows.join(summary, "path")


# Versions of what makes chunks
EXTRACTOR_VERSION, REDACTION_VERSION = "chunk-lines-1", "redact-1"


def chunks(files: DataFrame, width: int = 80) -> DataFrame:
    """Windows of ``width`` lines with an id from path, file token and range, and the
    versions that made them."""
    n = F.size(T.lines(F.col("content")))
    rows = files.select("path", n.alias("n"), F.substring(F.sha2("content", 256), 1, 16).alias("token")).where("n > 0")
    rows = rows.select("path", "token", "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(width))).alias("start_line"))
    end = F.least(F.col("start_line") + width - 1, F.col("n"))
    return rows.select("path", "start_line", end.alias("end_line"), F.concat(F.lit("chk_"), T.digest(F.concat_ws(":", "path", "token", "start_line", end), 16)).alias("chunk_id"), F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.lit(REDACTION_VERSION).alias("redaction_version"))


def snippets(files: DataFrame, wanted: DataFrame, before: int = 0, after: int = 0, most: int = 4000) -> DataFrame:
    """Lines around each requested range, cut to ``most`` characters and then
    redacted, with its flags; or a typed error: invalid_range, missing_file,
    excluded_path or unindexed (a file without content).  A null ``end_line`` is the
    first line; a range past the end is empty."""
    j = wanted.withColumn("end_line", F.coalesce("end_line", "start_line")).join(files.select("path", F.lit(True).alias("listed"), T.lines(F.col("content")).alias("ls")), "path", "left")
    error = F.when(F.col("start_line") < 1, "invalid_range").when(F.col("listed").isNull(), "missing_file").when(corpus.excluded(F.col("path")), "excluded_path").when(F.col("ls").isNull(), "unindexed")
    first = F.greatest(F.lit(1), F.col("start_line") - max(before, 0))
    last = F.greatest(first, F.least(F.size("ls"), F.col("end_line") + max(after, 0)))
    raw = F.array_join(F.slice("ls", first, last - first + 1), "\n")
    good = j.withColumn("error", error).withColumn("_raw", F.when(error.isNull(), T.trim_text(raw, most)))
    good = good.withColumn("content", T.redact(F.col("_raw")))
    return good.select(
        "path", F.when(error.isNull(), first).otherwise(F.col("start_line")).alias("start_line"), F.when(error.isNull(), last).otherwise(F.col("end_line")).alias("end_line"), F.col("start_line").alias("requested_start"), F.col("end_line").alias("requested_end"), "error",
        F.when(error.isNull(), F.size("ls")).alias("total_lines"), "content", F.when(error.isNull(), T.is_trimmed(raw, most)).alias("truncated"), T.redaction_categories(F.col("_raw")).alias("redactions"), T.injection_signals(F.col("content")).alias("signals"))


def tree(files: DataFrame, depth: int, root: str = "", most: int | None = None) -> DataFrame:
    """Files and folders down to ``depth`` below ``root``, in the order of their
    segments, ``most`` at most."""
    if root:
        rows = tree(files.where(F.col("path").startswith(f"{root}/")).select(F.substr("path", F.lit(len(root) + 2)).alias("path")), depth)
        rows = rows.withColumn("path", F.concat(F.lit(f"{root}/"), "path"))
        return rows if most is None else rows.orderBy(F.split("path", "/")).limit(most)
    if most is not None:
        return tree(files, depth).orderBy(F.split("path", "/")).limit(most)
    parts = F.split("path", "/")
    rows = files.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(depth)))).alias("d"))
    return rows.select(F.array_join(F.slice("p", 1, F.col("d")), "/").alias("path"), F.col("d").alias("depth"), (F.col("d") < F.size("p")).alias("is_dir")).distinct()


def facts(files: DataFrame) -> DataFrame:
    """Counts by extension, most first, eight at most, with the number of all
    files, whether there is a folder of tests and whether a readme, both at the root."""
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"[^./](\.[^./]+)$", 1)), F.lit("")), F.lit("[none]"))
    whole = files.agg(F.count("*").alias("file_count"), F.coalesce(F.bool_or(F.col("path").rlike("^tests?/")), F.lit(False)).alias("has_tests"), F.coalesce(F.bool_or(F.col("path").isin("README.md", "README.rst", "README.txt")), F.lit(False)).alias("has_readme"))
    top = files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(8)
    return top.crossJoin(F.broadcast(whole))  # one row


def search_documents(files: DataFrame) -> DataFrame:
    """X14."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.concat_ws(" ", "path", name, F.regexp_replace(name, r"\.[^.]*$", ""), F.array_join(F.split("path", "[/._-]+"), " ")).alias("path_text"), "content", corpus.language(F.col("path")).alias("language"), F.sha2("content", 256).alias("sha256"), "mtime_ns")
