"""Mixing, the prefix trie and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("gleaner.llm")
from pyspark.sql import functions as F  # noqa: E402

from gleaner.llm import mixing, periodic, prefix_trie  # noqa: E402

DOCS = "doc_id long, text string, source string, _copies long, none string, `a b` string"


def written(spark, tmp_path, rows, schema, name="t", parts=3):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3, share=1.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        rest, free = total - sum(most * sizes[s] for s in stopped), [s for s in names if s not in stopped]
        target = {s: most * sizes[s] if s in stopped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


def mixed_rows(rnd):
    rows = []
    for k, source in enumerate(["b", "a", "é", "", None, "z", "𝄞", "￿", "tiny"]):
        for i in range({"tiny": 1, "b": 150}.get(source, 25)):
            text = rnd.choice([None, "", " \t\n"]) if i % 9 == 8 else "w " * rnd.randrange(1, 40) + " x"
            rows.append((1000 * k + i, text, source, 7, "n", "x"))
    rows += [(None, "one two three", "hot", 0, None, None)] * 120 + [(5, "same id " * 3, "hot", 0, None, None)] * 60  # copies at the boundary
    return rows + [(9999, "long " * 40_000, "long", 0, None, None)]


def test_mixing(spark, tmp_path):
    rows = mixed_rows(random.Random(5))
    docs = written(spark, tmp_path, rows, DOCS)
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "none", "a b", "_copies"]
    got = out.collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["source"]) for r in got))) == sorted(map(repr, (r[:3] for r in rows)))
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes, taken, largest = {}, {}, {}
    for r in got:
        n = size(r["text"])
        assert 0 <= r["_copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        taken[r["source"]] = taken.get(r["source"], 0) + n * r["_copies"]
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    target = plain_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6, (s, taken[s], target[s])
    again = written(spark, tmp_path, rows, DOCS, "again", 1)
    apart = [r["doc_id"] for r in got if r["doc_id"] not in (None, 5)]
    key = lambda r: (r["doc_id"], r["_copies"])
    assert sorted(key(r) for r in mixing.mix(again).collect() if r["doc_id"] in set(apart)) == sorted(key(r) for r in got if r["doc_id"] in set(apart))
    assert sorted(map(repr, map(key, mixing.mix(docs).collect()))) == sorted(map(repr, map(key, got)))


def test_smaller_mixes_are_parts_of_larger_ones(spark, tmp_path):
    docs = written(spark, tmp_path, [(i, "w " * (1 + i % 7), f"s{i % 3}", 0, "", "") for i in range(300)], DOCS)
    copies = [{r["doc_id"]: r["_copies"] for r in mixing.mix(docs, share=s).collect()} for s in (0.2, 0.5, 1.0, 5.0)]
    assert all(small[i] <= large[i] for small, large in zip(copies, copies[1:]) for i in small)
    assert set(copies[-1].values()) == {3}


def test_mixing_takes_frames_that_are_no_scans_and_empty_tables(spark, tmp_path):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    assert {r["_copies"] for r in mixing.mix(docs).collect()} == {1}
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0
    blank = written(spark, tmp_path, [(1, None, None, 0, "", ""), (2, "", "s", 0, "", "")], DOCS)
    assert {r["_copies"] for r in mixing.mix(blank).collect()} == {0}


# The prefix trie


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    # turns of equal number are the same in these rows, so their order doesn't matter
    own = {c: [x for _, x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    nodes = {}
    for c, t in paths.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(x[:-1] == q for x in below if x)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


CONVS = "conv_id long, turn long, role string, text string, d long, c string"


def trie_rows(rnd):
    rows = []
    for c in range(70):
        if c in (10, 25):  # a family without its first conversation
            continue
        for t in range(rnd.randrange(1, 12)):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rnd.choice(["user", "assistant", None, ""]), rnd.choice(["é", "b", "", None, "long " * 50]), 1, "x"))
    rows += [(c, t, "user", "copy", 1, None) for c in range(100, 160) for t in range(4)]  # many copies
    rows += [(40, 3, "r", "again", 0, None)] * 0 + [(200, 5, "user", "tie", 1, None)] * 30  # turns that repeat
    rows += [(c, t, "user", f"t{t % 7}", 1, None) for c in (300, 305) for t in range(120)]  # long, shared and over several parts
    return rows + [(None, 0, "user", "no id", 1, None)]


@pytest.mark.parametrize("bits", [None, 3])
def test_prefix_trie(spark, tmp_path, monkeypatch, bits):
    if bits:  # a sketch so small that most singletons look shared
        monkeypatch.setattr(prefix_trie, "LEAST_BITS", 2)
        monkeypatch.setattr(prefix_trie, "MOST_BITS", bits)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = trie_rows(random.Random(2))
    got = prefix_trie.prefix_trie(written(spark, tmp_path, rows, CONVS)).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == sorted(plain_trie([r[:4] for r in rows]), key=lambda r: (r[0], r[1]))


def test_prefix_trie_of_few_rows(spark, tmp_path):
    empty = spark.createDataFrame([], CONVS)
    assert prefix_trie.prefix_trie(empty).count() == 0
    turnless = [(6, 0, "user", "x", 0, "")] if zlib.crc32(b"6") % 9 else [(7, 0, "user", "x", 0, "")]
    got = prefix_trie.prefix_trie(written(spark, tmp_path, turnless, CONVS)).collect()
    assert list(map(tuple, got)) == plain_trie([r[:4] for r in turnless])
    assert got[0]["n_leaves"] == 1 and got[0]["depth"] == 0


def test_sketch_never_counts_too_few(spark):
    prefixes = spark.range(3000).select(F.xxhash64("id").alias("d1"), F.xxhash64("id", F.lit(1)).alias("d2")).repartition(5)
    twice = prefixes.union(prefixes.limit(100))
    shared = prefix_trie.shared_cells(twice, 13)
    pairs = prefixes.limit(100).toPandas()
    for cells in prefix_trie._cells(pairs["d1"].to_numpy(), pairs["d2"].to_numpy(), 13):
        assert all(shared[c >> 3] >> (7 - (c & 7)) & 1 for c in cells.tolist())


# Periodic runs


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def repetitive(rnd):
    kind, letters, n = rnd.randrange(5), rnd.choice([1, 2, 2, 3, 5]), rnd.randrange(0, 200)
    if kind == 0:
        return [rnd.randrange(letters) for _ in range(n)]
    if kind == 1:
        u, v = ([rnd.randrange(letters) for _ in range(rnd.randrange(1, 9))] for _ in range(2))
        return sum((u * rnd.randrange(1, 20) + v * rnd.randrange(0, 3) for _ in range(4)), [])
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        u = [0, 1] * rnd.randrange(2, 40) + [0]
        return u * rnd.randrange(2, 5) + u[: rnd.randrange(len(u))]
    out = [0]
    while len(out) < n:
        i = rnd.randrange(len(out))
        out += out[i : i + rnd.randrange(1, 60)] + [rnd.randrange(letters + 1)] * rnd.randrange(2)
    return out


def test_runs_equal_all_lags():
    rnd = random.Random(4)
    for _ in range(250):
        texts = [repetitive(rnd) for _ in range(rnd.randrange(1, 5))]
        assert periodic._search([[b"%d" % w for w in t] for t in texts]) == [plain_runs(t) for t in texts]


def test_long_repetitive_texts_take_little_time():
    import time

    import numpy as np

    began = time.time()
    for words in ([0] * 100_000, list(range(13)) * 8000, ([0, 1] * 3000 + [2]) * 20, ([0, 1] * 20_000 + [0]) * 2):
        assert periodic.find_runs(np.array(words))
    assert time.time() - began < 30


def test_collapse_runs(spark, tmp_path):
    rnd = random.Random(8)
    texts = [" \n".join(f"w{x}" for x in repetitive(rnd)) for _ in range(60)] + [None, "", "  \x0b", "one", "a b " * 6, "line of words here\n" * 3000, "x y " * 7]
    rows = [(i, t, "s", 0, "", "") for i, t in enumerate(texts)] + [(3, texts[3], "s", 0, "", ""), (None, "a b " * 6, "s", 0, "", ""), (2**60 + 1, "a b " * 9, "s", 0, "", "")]
    docs = written(spark, tmp_path, rows, DOCS)
    for tail in (False, True):
        got = sorted(map(tuple, periodic.collapse_runs(docs, tail).collect()), key=repr)
        want = []
        for doc_id, text, *_ in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            n, h = len(words), zlib.crc32(str(doc_id).encode())
            if tail and doc_id is not None and h % 10 == 0 and n:
                a = (h // 10) % n
                p = 1 + (n - a) // (3 + (h // 10) % 8)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 4)]
            dropped = {i for a, b, q in runs for i in range(a + q, b)}
            best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
            kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
            lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
            first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
            want.append((doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept))
        assert got == sorted(want, key=repr)
    assert periodic.collapse_runs(docs.limit(0)).count() == 0
