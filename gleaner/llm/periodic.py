"""Periodic runs of words: maximal repetitions found by seeds and extended along diagonals.

A run of smallest period q and length L >= max(12, 2q) matches itself shifted by the lag
q over L - q >= max(q, 12 - q) words.  So for lags of a class [k, 2k) every run holds a
k-gram that occurs again q words later: k-grams are indexed, their occurrences in the
same text give (place, lag) seeds, and each seed is extended along its diagonal unless
the lag's furthest-covered table shows that an earlier extension went over it.

Two facts keep the seeds linear on any text.  A k-gram of smallest period above k/2
occurs at most four times within 2k words.  A k-gram of smaller period p lies in a run of
period p, known from a lower class; a run made of such k-grams alone spans the seam of
two touching runs with the same root, and its lags are spelled out from the seam.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

#: Least length of a run, and lags that are compared outright.
LEAST, DIRECT = 12, 8
#: Words of texts that are searched together (one longer text is searched alone).
WORDS_TOGETHER = 400_000


def _extend(words: np.ndarray, i: int, lag: int, k: int) -> tuple[int, int]:
    """The longest stretch around [i, i + k) that equals itself ``lag`` later."""
    a, b, step = i, i + k, 32
    while b + lag < len(words):
        x = words[b : b + step]
        y = words[b + lag : b + lag + step]
        same = x[: len(y)] == y
        if not same.all():
            b += int(same.argmin())
            break
        b, step = b + len(same), step * 2
    step = 32
    while a > 0:
        n = min(step, a)
        same = (words[a - n : a] == words[a + lag - n : a + lag])[::-1]
        if not same.all():
            a -= int(same.argmin())
            break
        a, step = a - n, step * 2
    return a, b


def _direct(words: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """Runs of at least 8 words with period ``lag``."""
    same = np.flatnonzero(np.diff(np.concatenate(([0], (words[:-lag] == words[lag:]).view(np.int8), [0]))))
    starts, ends = same[::2], same[1::2]
    long = ends - starts >= max(lag, DIRECT - lag)
    return [(int(a), int(b) + lag, lag) for a, b in zip(starts[long], ends[long], strict=True)]


def _seam_seeds(words: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(place, lag) of the matches that lie across two touching runs with one root."""
    seeds = []
    by_period: dict[int, list[tuple[int, int]]] = {}
    for a, b, p in runs:
        by_period.setdefault(p, []).append((a, b))
    for p, spans in by_period.items():
        spans.sort()
        for (s, e), (s2, e2) in zip(spans, spans[1:], strict=False):
            if not e - p < s2 <= e:
                continue
            tail = words[e - p : e]
            shift = next((d for d in range(p) if np.array_equal(words[s2 + d : s2 + d + p], tail)), None) if e2 - s2 >= 2 * p - 1 else None
            if shift is None:
                continue
            first = (s2 + shift - (e - p)) % p or p
            lags = np.arange(first, min(e - s, e2 - s2) + p, p)
            a, b = np.maximum(s, s2 - lags), np.minimum(e, e2 - lags)
            fits = (b - a >= lags) & (lags >= DIRECT)
            seeds += zip(a[fits].tolist(), lags[fits].tolist(), strict=True)
    return seeds


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all maximal runs of max(12, 2 * period) words or
    more, by start and period.  ``words`` are numbers of words from 0; texts one after
    another, none with a number of another's, are searched together."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}  # the smallest period of what is found twice

    def add(a: int, b: int, lag: int) -> None:
        found[a, b] = min(lag, found.get((a, b), lag))

    for lag in range(1, min(DIRECT, n)):
        for run in _direct(words, lag):
            add(*run)
    covered: dict[int, int] = {}

    def extend(i: int, lag: int, k: int) -> None:
        if i >= covered.get(lag, 0):
            a, b = _extend(words, i, lag, k)
            covered[lag] = b
            if b - a >= lag:
                add(a, b + lag, lag)

    # Places whose k-gram occurs elsewhere, and the k-grams' ranks there.
    places, ranks, k = np.arange(n), words, 1
    while len(places) and 2 * k < n:
        again = np.bincount(ranks)[ranks] > 1
        places, ranks = places[again], ranks[again]
        at = np.full(n + k, -1)
        at[places] = ranks
        keep = at[places + k] >= 0
        places, ranks = places[keep], ranks[keep]
        if not len(places):
            break
        ranks, k = np.unique(ranks * (int(at.max()) + 1) + at[places + k], return_inverse=True)[1], 2 * k
        if k < DIRECT:
            continue
        # k-grams inside a run of period k/2 or less have occurrences without end.
        inside, seams = np.zeros(n + 1, int), []
        for (a, b), p in found.items():
            if 2 * p <= k:
                if 4 * p > k or k == DIRECT:  # its seams were spelled out in no class before
                    seams.append((a, b, p))
                if b - a >= k:
                    inside[a] += 1
                    inside[b - k + 1] -= 1
        free = np.cumsum(inside)[places] == 0
        order = np.lexsort((places[free], ranks[free]))
        where, what = places[free][order], ranks[free][order]
        seeds = []
        for ahead in range(1, 5):
            lag = where[ahead:] - where[:-ahead]
            near = (what[ahead:] == what[:-ahead]) & (lag >= k) & (lag < 2 * k)
            seeds.append(np.stack([lag[near], where[:-ahead][near]]))
        seeds = np.concatenate(seeds, 1)
        lags, starts = seeds[:, np.lexsort((seeds[1], seeds[0]))]
        head = np.ones(len(lags), bool)
        head[1:] = (lags[1:] != lags[:-1]) | (starts[1:] != starts[:-1] + 1)
        for lag, i in zip(lags[head].tolist(), starts[head].tolist(), strict=True):
            extend(i, lag, k)
        for i, lag in _seam_seeds(words, seams):
            a, b = _extend(words, i, lag, lag)
            add(a, b + lag, lag)
    return sorted((a, b, p) for (a, b), p in found.items() if b - a >= max(LEAST, 2 * p))


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text that the query's rule picks, with a tail made periodic."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _describe(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    lines, keep, best = [], None, None
    for start, end, period in runs:
        lines.append(f"{start},{end - start},{period}\n")
        if best is None or (start - end, start, period) < (best[0] - best[1], best[0], best[2]):
            best = (start, end, period)
        if keep is None:
            keep = np.ones(len(words), bool)
        keep[start + period : end] = False
    kept = words if keep is None else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    found = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (len(runs), *found, hashlib.sha256("".join(lines).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept))


def _search(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, searched together."""
    numbers, ends = [], []
    for words in texts:
        own: dict[bytes, int] = {}
        base = len(numbers)  # above any number given out before
        numbers += [own.setdefault(w, base + len(own)) for w in words]
        ends.append(len(numbers))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in find_runs(np.array(numbers, np.int64)):
        k = int(np.searchsorted(ends, start, "right"))
        first = ends[k] - len(texts[k])
        out[k].append((start - first, end - first, period))
    return out


def collapse_runs(docs: DataFrame, tail: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_runs, the longest run (start, length, period,
    exponent_milli), runs_sha256, collapsed_sha256 and collapsed, the text with each
    run cut to its first period and one space between words.

    Null and empty texts have no words and no runs; texts of any length are searched
    whole, in memory in proportion to their words, and in time nearly so even where
    they repeat without end.  Rows with equal ids are rows of their own; an empty
    table gives none; other columns are ignored.  With ``tail`` the words are first
    changed by ``repeat_tail``, which leaves texts without an id as they are.
    """

    def run(parts):
        for part in parts:
            done, texts, ids, held = [], [], [], 0

            def flush():
                done.extend((i, *_describe(w, r)) for i, w, r in zip(ids, texts, _search(texts), strict=True))
                texts.clear(), ids.clear()

            for doc_id, text in zip(part["id"], part["text"], strict=True):
                doc_id = None if doc_id is None else int(doc_id)
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at ASCII space alone
                words = repeat_tail(words, doc_id) if tail else words
                if held + len(words) > WORDS_TOGETHER:
                    flush()
                    held = 0
                held += len(words)
                texts.append(words), ids.append(doc_id)
            flush()
            out = pd.DataFrame(done, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"], dtype=object)
            yield out.assign(collapsed=[x.decode("utf-8", "surrogatepass") for x in out["collapsed"]])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    return map_texts(docs.select(F.col("doc_id").cast("string").alias("id"), "text"), run, schema, rows=200)


def op13_periodic(spark, sf_dir):
    """The periodic runs of every document, some with a tail made periodic."""
    return collapse_runs(table(spark, sf_dir, "documents"), tail=True).drop("collapsed")
