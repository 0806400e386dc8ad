"""Exact n-gram Jaccard join with set-relation skipping.

1. Equal sets are one class.  A class can link to another only if enough of the
   smallest hashes of its set occur in other classes' sets too (a set that links
   has at most a quarter of its shingles to itself).  Sets are dealt out by shingle
   in packed blocks, one entry for each shingle of a chunk of documents, so a
   shingle that a third of all documents have stays small.
2. What is left is grouped by prefixes in order of rising frequency: the classes of
   similar size that share a prefix shingle are one list, and lists with the same
   least class are one cluster.  All sets of a cluster have a prefix shingle in
   common with its least one, so clusters don't chain; a near copy's many lists have
   few least classes, so its set travels to few clusters.
3. In a cluster, all sets are joined with all others in pairs of blocks: index lists
   are ordered by set size and skipped to the positions whose sizes allow a link,
   and the overlaps of a set are derived from those of the similar set before it
   through the shingles in which they differ.  A link counts in the least cluster
   that both its sets are in, so once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, map_texts, stage, worker_cache
from .components import components

WIDTH = 5
#: A link: intersection * 100 >= PERCENT * union.
PERCENT = 75
#: Shingles that a chunk gathers before it is packed, and that a bucket gets on average.
#: A class gives a row for each bucket that has some of its shingles; with small buckets
#: those are nearly as many as the shingles at any size of the corpus.
CHUNK, BUCKET = 500_000, 50_000
#: Share of a set, its smallest hashes, that the first step deals out.
SHARE = 0.4
#: Sets in one block of a cluster, and how much (percent) the sizes of two sets may
#: differ for the second's overlaps to be derived from the first's.
BLOCK, WIDER = 512, 3
#: Candidate ids are broadcast up to this many (16 bytes each), joined beyond.
BROADCAST_IDS = 1_000_000
#: Sizes that link differ by a third at most, so by one band of this ratio.
BAND_RATIO = 1.34
CACHE_WORDS = 250_000
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingle hashes, ascending (unsigned 64 bits)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()  # white space: 09-0D and 20
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b"\x20".join(words), seed=len(words))], np.uint64)
    known = worker_cache("jaccard").setdefault("word_hashes", _Words())
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(w) - WIDTH + 1
    h = w[:n] * _MULTIPLIERS[0]
    for k in range(1, WIDTH):
        h ^= (h >> np.uint64(29)) ^ (w[k : n + k] * _MULTIPLIERS[k])
        h *= _MULTIPLIERS[0]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def set_class(s: np.ndarray) -> int:
    """A 64-bit name for a set; never 0."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


def need(n):
    """Shingles of a set of ``n`` that must be common in any link."""
    return (PERCENT * n + 99) // 100


def dealt(n):
    """How many of a set's smallest hashes the first step deals out."""
    return np.maximum(n - need(n) + 1, -(-n * int(SHARE * 100) // 100))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class) of each row; class is null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            described = [(len(s), set_class(s) if len(s) else None) for s in map(shingles, b.text)]
            yield pd.DataFrame({"doc_id": b.doc_id, "n_shingles": [n for n, _ in described], "class": pd.array([c for _, c in described], dtype="Int64")})

    out = map_texts(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), run, "doc_id string, n_shingles long, class long")
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def _deal(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed entries (shingle, class) by bucket; class 0 says that several classes
    of the chunk have the shingle, which their counts (sure) say already."""

    def pack(tokens: list[np.ndarray], classes: list[int]) -> pd.DataFrame:
        t = np.concatenate(tokens)
        c = np.repeat(np.array(classes, np.int64), [len(x) for x in tokens])
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[first, len(t)])
        sure, sure_n = np.unique(c[np.repeat(size > 1, size)], return_counts=True)
        t, c = t[first], np.where(size > 1, 0, c[first])
        bucket = (t % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        t, c, bucket = t[order], c[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(t)]
        out = pd.DataFrame({"bucket": bucket[starts], "tokens": [t[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], "classes": [c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]})
        out["sure"], out["sure_n"] = b"", b""
        out.loc[0, "sure"], out.loc[0, "sure_n"] = sure.tobytes(), sure_n.astype(np.int64).tobytes()
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, classes, held, seen = [], [], 0, set()
        for b in batches:
            for text in b.text:
                s = shingles(text)
                if len(s) and (name := set_class(s)) not in seen:
                    seen.add(name)
                    tokens.append(s[: int(dealt(len(s)))])
                    classes.append(name)
                    held += len(tokens[-1])
                    if held >= CHUNK:
                        yield pack(tokens, classes)
                        tokens, classes, held, seen = [], [], 0, set()
        if tokens:
            yield pack(tokens, classes)

    return map_texts(docs.select("text"), run, "bucket int, tokens binary, classes binary, sure binary, sure_n binary")


def _shared(df: pd.DataFrame) -> pd.DataFrame:
    """How many dealt shingles of each class other classes have too."""
    t = np.concatenate([np.frombuffer(x, np.uint64) for x in df.tokens])
    c = np.concatenate([np.frombuffer(x, np.int64) for x in df.classes])
    order = np.argsort(t, kind="stable")
    t, c = t[order], c[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    several = np.maximum.reduceat(c, first) != np.minimum.reduceat(c, first)
    hit = np.repeat(several, np.diff(np.r_[first, len(t)])) & (c != 0)
    # a class that several chunks hold has an entry from each
    pairs = np.unique(np.stack([t[hit].view(np.int64), c[hit]], 1), axis=0) if hit.any() else np.empty((0, 2), np.int64)
    names, counts = np.unique(pairs[:, 1], return_counts=True)
    sure = np.concatenate([np.frombuffer(x, np.int64) for x in df.sure])
    sure_n = np.concatenate([np.frombuffer(x, np.int64) for x in df.sure_n])
    return pd.DataFrame({"class": np.concatenate([names, sure]), "shared": np.concatenate([counts, sure_n])})


def candidates(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(class, n, rows, doc_id) of the classes that may link to another: one document of each."""
    classes = described.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    total = described.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    buckets = max(1, int(total * SHARE) // BUCKET)
    counts = _deal(docs, buckets).groupBy("bucket").applyInPandas(_shared, "class long, shared long").groupBy("class").agg(F.sum("shared").alias("shared"))
    own = F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100")  # what a linked set may have to itself
    size = F.greatest(own + 1, F.ceil(F.col("n") * F.lit(int(SHARE * 100)) / 100))
    return classes.join(counts, "class").where(F.col("shared") >= size - own).select("class", "n", "rows", "doc_id")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, n, rows, tokens) for the classes of ``wanted``, from their documents' texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b.text]
            yield pd.DataFrame({"class": [set_class(s) if len(s) else 0 for s in sets], "n": [len(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]})

    ids = wanted.select("doc_id")
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    made = map_texts(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text"), run, "class long, n long, tokens array<bigint>")
    return made.join(wanted.select("class", "rows"), "class").dropDuplicates(["class"])


def block_links(rest: list[tuple[int, np.ndarray]], others: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between sets of ``rest`` and of ``others`` (name, tokens ascending).

    The index lists hold places in the order of size, ascending; each is read from
    the place of the least size that allows a link to the place of the largest.
    Overlaps of a set are those of the set before it, less the lists of shingles it
    lacks, plus those it has besides, whenever that reads less than starting afresh
    and the places read before (a little more than that set's own) hold all of its."""
    others = sorted(others, key=lambda x: (len(x[1]), x[0]))
    sizes, many = np.array([len(x[1]) for x in others]), len(others)
    kinds, kind = np.unique(np.concatenate([x[1] for x in others]), return_inverse=True)
    entries = np.sort(kind * many + np.repeat(np.arange(many), sizes))
    # similar sets follow each other: sort by size class and least shingles
    rest = sorted(rest, key=lambda x: (x[1][:3].tolist(), len(x[1])))
    overlap, previous, links, first, end = np.zeros(many, np.int64), np.empty(0, np.int64), [], 0, 0

    def lists(which: np.ndarray, first: int, end: int) -> np.ndarray:
        at = np.searchsorted(kinds, which)
        at = at[kinds[np.minimum(at, len(kinds) - 1)] == which] * many
        low, high = np.searchsorted(entries, at + first), np.searchsorted(entries, at + end)
        return np.bincount(np.concatenate([entries[a:b] for a, b in zip(low, high, strict=True) if a < b] or [entries[:0]]) % many, minlength=many)

    def bounds(least: int, most: int) -> tuple[int, int]:
        return int(np.searchsorted(sizes, need(least), "left")), int(np.searchsorted(sizes, 100 * most // PERCENT, "right"))

    for name, s in rest:
        n = len(s)
        low, high = bounds(n, n)
        lost, new = np.setdiff1d(previous, s, True), np.setdiff1d(s, previous, True)
        if first <= low and high <= end and len(lost) + len(new) < n:
            overlap = overlap - lists(lost, first, end) + lists(new, first, end)
        else:
            first, end = bounds(n - n * WIDER // 100, n + n * WIDER // 100)
            overlap = lists(s, first, end)
        previous = s
        ok = low + np.flatnonzero(100 * overlap[low:high] >= PERCENT * (n + sizes[low:high] - overlap[low:high]))
        links += [(name, others[k][0]) for k in ok if others[k][0] != name]
    return links


def _links_in_blocks(pairs: bool):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        """The links between two blocks of a cluster that count here: each with the
        lesser class first, or (``pairs`` false) one row (a, b, far) for each class a
        that has some, with the rows it links to and a class b that it hangs
        together with, the same for all that hang together here."""
        cluster = df.cluster.iloc[0]
        pick = lambda side: [(int(c), np.asarray(t, np.int64)) for c, t in zip(side["class"], side.tokens, strict=True)]
        rest, others = pick(df[df.rest]), pick(df[~df.rest])
        found = block_links(rest, others) if rest and others else []
        if df.x.iloc[0] == df.y.iloc[0]:  # a block with itself
            found = [(a, b) for a, b in found if a < b]
        of = {c: (frozenset(k), n) for c, k, n in zip(df["class"], df.clusters, df["rows"], strict=True)}
        found = [(min(x), max(x)) for x in found if min(of[x[0]][0] & of[x[1]][0]) == cluster]
        if pairs:
            return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found], "far": 0}, dtype="int64")
        far, above = dict.fromkeys((c for link in found for c in link), 0), {}

        def top(c: int) -> int:
            while (up := above.get(c, c)) != c:
                above[c] = c = above.get(up, up)
            return c

        for a, b in found:
            far[a] += of[b][1]
            far[b] += of[a][1]
            if (x := top(a)) != (y := top(b)):
                above[max(x, y)] = min(x, y)
        return pd.DataFrame({"a": list(far), "b": [top(c) for c in far], "far": list(far.values())}, dtype="int64")

    return run


def class_links(docs: DataFrame, described: DataFrame, pairs: bool = True) -> DataFrame:
    """Each pair (a, b) of linked classes once, a < b; or, if not ``pairs``, rows
    (a, b, far): class a links to ``far`` rows of other classes (summed over its
    rows), and a and b are in one component.  The second form has a few rows for each
    class however many classes link to it."""
    wanted = stage(candidates(docs, described), "jaccard-candidates")
    sets = stage(sets_of(docs, wanted), "jaccard-sets")
    each = sets.select("class", F.explode("tokens").alias("t"))
    frequency = each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    lists = each.join(frequency, "t").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    must = F.expr(f"({PERCENT} * n + 99) div 100")
    info = sets.select("class", "n").join(lists, "class").where(F.size("s") >= must)
    # Shingles of one class alone come first in the order; they take n - size(s) places of the prefix.
    prefix = F.expr(f"slice(s.t, 1, cast(size(s) - ({PERCENT} * n + 99) div 100 + 1 as int))")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND_RATIO))).cast("int")
    info = stage(info.select("class", F.array(band, band - 1).alias("bands"), prefix.alias("prefix")), "jaccard-prefixes")
    posts = info.select("class", "bands", F.explode("prefix").alias("t")).select("class", "t", F.explode("bands").alias("band"))
    lists = posts.groupBy("t", "band").agg(F.min("class").alias("cluster"), F.max("class").alias("other")).where("cluster <> other").drop("other")
    placed = stage(posts.join(lists, ["t", "band"]).select("class", "cluster").distinct(), "jaccard-clusters")
    # Blocks x <= y of a cluster: those of block x against those of block y.
    per = placed.groupBy("cluster").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    full = sets.join(placed.groupBy("class").agg(F.collect_set("cluster").alias("clusters")), "class")
    block = F.pmod(F.xxhash64(F.lit(1), "class"), F.col("blocks")).cast("int")
    members = stage(full.join(placed, "class").join(per, "cluster").select("class", "rows", "tokens", "clusters", "cluster", "blocks", block.alias("block")), "jaccard-members")
    same = ["class", "rows", "tokens", "clusters", "cluster"]
    rest = members.select(*same, F.col("block").alias("x"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("y"), F.lit(True).alias("rest"))
    others = members.select(*same, F.explode(F.expr("sequence(0, block)")).alias("x"), F.col("block").alias("y"), F.lit(False).alias("rest"))
    found = rest.unionByName(others).groupBy("cluster", "x", "y").applyInPandas(_links_in_blocks(pairs), "a long, b long, far long")
    return found.select("a", "b") if pairs else found


def join_documents(docs: DataFrame, pairs: bool = True) -> tuple[DataFrame, DataFrame]:
    """The whole join: (doc_id, n_shingles, class) of each row, and the links of
    ``class_links``.  Rows link if they are in one class or in two linked ones."""
    docs = docs.select("doc_id", "text")
    described = stage(describe(docs), "jaccard-described")
    return described, stage(class_links(docs.where("doc_id is not null"), described, pairs), "jaccard-links")


def link_counts(described: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, class, n_links) of each row of ``join_documents``: how many other
    rows link to it.  Rows with a null doc_id or no shingles link nothing."""
    rows = described.where("class is not null and doc_id is not null").groupBy("class").agg(F.count("*").alias("rows"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(rows, F.col("b") == F.col("class")).groupBy("a").agg(F.sum("rows").alias("far"))
    counts = rows.join(far, F.col("class") == F.col("a"), "left").select("class", (F.col("rows") - 1 + F.coalesce("far", F.lit(0))).alias("n"))
    linked = F.when(F.col("doc_id").isNotNull(), F.col("n"))
    return described.join(counts, "class", "left").select("doc_id", "class", F.coalesce(linked, F.lit(0)).cast("long").alias("n_links"))


def link_documents(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_shingles, component_id, class, n_links
    (how many other rows it links to) for each row.

    Texts that are null or have no words have no shingles, no class (null) and are
    components of their own; texts of fewer than five words have one shingle; repeated
    rows and equal texts are in one class; a row with a null doc_id gets a null
    component_id and links nothing; an empty table gives no rows; other columns are
    ignored.
    """
    described, links = join_documents(docs, pairs=False)
    classes = components(links)
    far = links.groupBy("a").agg(F.sum("far").alias("far"))
    named = described.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    grouped = named.join(classes, F.col("class") == F.col("node"), "left").select("class", "least", "rows", F.coalesce("component", "class").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    n_links = (F.col("rows") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")
    final = grouped.join(smallest, "component").join(far, F.col("class") == F.col("a"), "left").select("class", "component_id", n_links)
    joined = described.join(final, "class", "left")
    known = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    return joined.select("doc_id", "n_shingles", known(F.coalesce("component_id", "doc_id")).alias("component_id"), "class", F.coalesce(known(F.col("n_links")), F.lit(0)).cast("long").alias("n_links"))


def op10_jaccard(spark, sf_dir):
    """Shingle sets and components of all documents."""
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)
), r AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT r.x AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""
