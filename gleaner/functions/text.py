"""Text functions as Spark columns (identifiers T01-T19 of the survey).

All are null for null text unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------
SECRETS = (
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"""(?i)\b[A-Za-z0-9_-]*(api[_-]?key|token|secret|password)[A-Za-z0-9_-]*\s*[:=]\s*['"]?[^'"\s]+""",
    r"\bBearer\s+[A-Za-z0-9._~+/=-]{12,}",
    r"\b[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
)
HOST_URIS = (r"""\bfile://(?:localhost)?/[A-Za-z]:[/\\][^\s:'",)>\]}]+""", r"""\bfile://(?:localhost)?/[^\s:'",)>\]}]+""")
HOST_PATHS = (
    r"""(?<![\w:/.-])/(home|Users|var|tmp|etc|opt|root|data|mnt|workspace-roots|workspace|private)(?:/[^\s:'",)>\]}]+)?(?=$|[\s:'",)>\]}])""",
    r"""(?<![\w:/.-])[A-Za-z]:[/\\](?:Users|Windows|ProgramData|Temp|tmp|workspace-roots|workspace|data|mnt|repo)(?:[/\\][^\s:'",)>\]}]+)?(?=$|[\s:'",)>\]}])""",
)
INJECTIONS = {
    "instruction_override": r"(?i)\b(ignore|override|forget|bypass)\b.{0,40}\b(previous|system|developer|instruction|rules)\b",
    "tool_manipulation": r"(?i)\b(call|invoke|run|execute|use)\b.{0,40}\b(tool|shell|command|curl|wget)\b",
    "credential_exfiltration": r"(?i)\b(send|exfiltrate|upload|print|reveal|show)\b.{0,40}\b(secret|token|password|key|credential)\b",
    "role_switch": r"(?i)\b(system|assistant|developer)\s*:\s*",
}
ROUTE_FIRST = (
    ("debug", ("debug", "traceback", "crash", "failure")),
    ("review", ("review", "pr", "merge")),
    ("coding", ("implement", "code", "feature", "refactor")),
    ("security", ("security", "secret", "token", "auth", "vulnerability")),
    ("test", ("test", "pytest", "coverage", "verify")),
    ("docs", ("doc", "docs", "readme", "documentation")),
)
ROUTE_TERMS = (
    ("debug", ("bug", "debug", "error", "failure", "traceback", "crash", "fix")),
    ("review", ("review", "diff", "change", "pr", "merge", "regression")),
    ("test", ("test", "pytest", "coverage", "unit", "integration", "verify")),
    ("docs", ("doc", "docs", "readme", "documentation", "guide")),
    ("security", ("security", "secret", "token", "auth", "permission", "vulnerability")),
    ("coding", ("implement", "code", "feature", "refactor", "api", "function")),
)
GENERIC_TERMS = (
    "a", "add", "an", "and", "are", "as", "behavior", "bug", "build", "by", "change", "code", "debug", "diff", "fix", "for", "in", "implement", "implementation", "is", "issue", "merge", "of", "on", "plan", "pr", "real",
    "refactor", "regression", "related", "review", "run", "test", "tests", "the", "to", "update", "verify", "with", "work", "world",
)
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
TRUNCATED = "\n...[truncated]"
#: White space as Python's strip() sees it.
WHITE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# -------------------------------------------------------------------------------
#: Letters, digits and white space of all scripts, for the patterns above.
UNICODE = "(?U)"


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row: what stands in a lambda is
    otherwise worked out for each element, what stands in several places in each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: The least characters of a token.
TOKEN_CHARS = 3


def lower_tokens(text: Column) -> Column:
    """``index_tokens`` of a text in lower case."""
    return F.regexp_extract_all(text, F.lit(f"(?=[0-9]*[a-z_])[a-z0-9_]{{{TOKEN_CHARS},}}"), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Lower-case runs of three or more letters, digits or underscores that
    aren't digits alone, with repeats."""
    return lower_tokens(F.lower(text))


def token_counts(tokens: Column) -> Column:
    """The different ``tokens`` as (term, tf), sorted: runs of the sorted list, so the work
    follows its length."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(starts, lambda b: F.transform(b, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - p).cast("long").alias("tf"))))

    return F.when(F.size(tokens) > 0, bound(F.sort_array(tokens), runs))


def query_terms(text: Column, most: int = 8) -> Column:
    """The first ``most`` different index tokens."""
    return F.slice(F.array_distinct(index_tokens(text)), 1, most)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def trim_text(text: Column, most) -> Column:
    """At most ``most`` characters (a number or a column); what is cut loses the
    white space at its end and gets a marker.  ``is_trimmed`` is the flag."""
    most = most if isinstance(most, Column) else F.lit(most)
    head = F.regexp_replace(F.substr(text, F.lit(1), F.greatest(most - 15, F.lit(0))), f"{WHITE}+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit(TRUNCATED)))


def is_trimmed(text: Column, most) -> Column:
    """Whether ``trim_text`` cuts."""
    return F.length(text) > most


def token_estimate(text: Column) -> Column:
    """A token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def redact_secrets(text: Column, kinds=range(4)) -> Column:
    """The secret patterns of T05, in order."""
    for k in kinds:
        text = F.regexp_replace(text, UNICODE + SECRETS[k], f"[REDACTED_SECRET_{k}]")
    return text


def redact(text: Column) -> Column:
    """Secrets, then file URIs, then host paths."""
    text = redact_secrets(text)
    for p in HOST_URIS:
        text = F.regexp_replace(text, UNICODE + p, "file://[REDACTED_HOST_PATH]")
    for p in HOST_PATHS:
        text = F.regexp_replace(text, UNICODE + p, "[REDACTED_HOST_PATH]")
    return text


def redaction_categories(text: Column) -> Column:
    """The sorted names of the patterns that changed something."""
    found, now = [], text
    for k in range(4):
        after = F.regexp_replace(now, UNICODE + SECRETS[k], f"[REDACTED_SECRET_{k}]")
        found.append(F.when(after != now, F.lit(f"secret_pattern_{k}")))
        now = after
    for name, patterns, by in (("host_path_uri", HOST_URIS, "file://[REDACTED_HOST_PATH]"), ("host_path", HOST_PATHS, "[REDACTED_HOST_PATH]")):
        after = now
        for p in patterns:
            after = F.regexp_replace(after, UNICODE + p, by)
        found.append(F.when(after != now, F.lit(name)))
        now = after
    return F.array_sort(F.array_compact(F.array(*found)))


def is_sensitive(text: Column) -> Column:
    """Whether redaction changes the text."""
    return redact(text) != text


def merge_categories(lists: Column) -> Column:
    """Union of category lists, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def injection_signals(text: Column) -> Column:
    """Names of the prompt-injection patterns found."""
    return F.array_compact(F.array(*[F.when(text.rlike(UNICODE + p), F.lit(n)) for n, p in INJECTIONS.items()]))


def route(prompt: Column) -> Column:
    """Six rules in order, then the route whose vocabulary has most of the
    prompt's terms (the first of equals), else general."""
    terms = query_terms(prompt, 80)
    out = None
    for name, vocabulary in ROUTE_FIRST:
        hit = F.arrays_overlap(terms, words(*vocabulary))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    counts = [F.size(F.array_intersect(terms, words(*v))) for _, v in ROUTE_TERMS]
    best = F.greatest(*counts)
    later = F.when(best == 0, "general")
    for (name, _), n in zip(ROUTE_TERMS, counts, strict=True):
        later = later.when(n == best, name)
    return out.otherwise(later)


def digest(text: Column, n: int = 64) -> Column:
    """The first ``n`` hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def deterministic_key(tool: str, *fields: str) -> Column:
    """Tool and 24 digits of the hash of the fields' JSON, keys in order."""
    return F.concat(F.lit(f"{tool}:"), digest(F.to_json(F.struct(*sorted(fields))), 24))


def path_like(query: Column) -> Column:
    """The query as a path if it looks like one, else empty."""
    q = F.regexp_replace(F.trim(query), r"\\", "/")
    looks = query.contains("/") | query.contains("\\") | query.rlike(r"\.[A-Za-z0-9_]{1,12}$")
    return F.when(looks, F.regexp_replace(q, r"^(\./)+", "")).otherwise("")


def reusable_terms(terms: Column, most: int = 8) -> Column:
    """Different terms without the generic ones."""
    return F.slice(F.array_except(F.array_distinct(terms), words(*GENERIC_TERMS)), 1, most)


def canonical_path(path: Column) -> Column:
    """Forward slashes, without leading ./"""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")


def canonical_globs(globs: Column) -> Column:
    """The different patterns of a list, trimmed, with forward slashes, sorted; blank
    ones are left out and null is an empty list."""
    clean = F.transform(F.coalesce(globs, F.array().cast("array<string>")), lambda g: F.regexp_replace(strip(g), r"\\", "/"))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda g: g != "")))


def absolute_path(path: Column) -> Column:
    """Forward slashes, one between names, without ``.`` and ``..``, from the root on.
    Two leading slashes stay; what climbs out of a relative path stays in front."""
    raw = F.regexp_replace(path, r"\\", "/")
    rooted = raw.startswith("/")

    def step(names: Column, name: Column) -> Column:
        last = F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit(""))
        up = F.when((F.size(names) > 0) & (last != ".."), F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))).when(rooted, names).otherwise(F.concat(names, F.array(name)))
        return F.when(name.isin("", "."), names).when(name == "..", up).otherwise(F.concat(names, F.array(name)))

    names = F.aggregate(F.split(raw, "/"), F.array().cast("array<string>"), step)
    front = F.when(raw.rlike("^//[^/]") & (F.size(names) > 0), "//").otherwise("/")
    # a relative path of no names is the folder itself, "."
    return F.concat(front, F.when((F.size(names) == 0) & ~rooted, ".").otherwise(F.array_join(names, "/")))


def local_uri_path(uri: Column) -> Column:
    """The normal path of a local file URI, with what is percent-encoded decoded (a
    plus sign and a lone percent sign stay), or of a path without a scheme that begins at
    the root.  Query and fragment don't count.  Null for other schemes and hosts, blank
    texts and relative paths, which have no folder to begin at."""
    raw = strip(uri)
    scheme = F.lower(F.regexp_extract(raw, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(raw, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "(?s)[?#].*$", "")
    host = F.regexp_extract(rest, "^//([^/]*)", 1)
    encoded = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "^//[^/]*", ""), "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when((scheme == "file") & host.isin("", "localhost"), absolute_path(F.url_decode(encoded))).when((scheme == "") & raw.startswith("/"), absolute_path(raw))


def canonical_uri(uri: Column) -> Column:
    """The local file URI of ``local_uri_path``, encoded again: all but letters,
    digits, ``_.-~`` and slashes."""
    encoded = F.url_encode(local_uri_path(uri))
    for found, by in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.regexp_replace(encoded, found, by)
    return F.concat(F.lit("file://"), encoded)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters as a dash, 40 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, 40)


def project_id(name: Column, identity: Column) -> Column:
    """The name's slug and 12 digits of the identity's hash."""
    return F.concat(slug(name), F.lit("-"), digest(identity, 12))


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def hit_ratio(hits: Column, misses: Column) -> Column:
    """Hits in hits and misses, 4 places, 0 for none."""
    return F.coalesce(F.round(hits / F.nullif(hits + misses, F.lit(0)), 4), F.lit(0.0))
