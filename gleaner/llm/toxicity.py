"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: its words, their beginnings (insults
come with many endings), and beginnings that several of its words share.  The machine adds, to a weight for each
term, the inner product of the factors of each pair of terms, so that a pair such
as an insult and a group's name counts for more (or less) than its parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, with_scores, worker_cache
from .quality import labelled_sample

#: Labelled rows of each class that the fit uses at most.
FIT_ROWS = 2000
BITS = 22
FACTORS = 8
THRESHOLD = 0.3
#: A term takes part if the chi-square of its presence against the label reaches
#: this and at least MIN_DOCUMENTS sampled texts have it.
MIN_CHI2, MIN_DOCUMENTS = 18.0, 3
#: So does one that tells the classes apart only beside another: the chi-square of both
#: together is this much more than those of the two alone.  Looked for among the
#: PAIR_TERMS commonest terms of PAIR_DOCUMENTS sampled texts or more.
PAIR_CHI2, PAIR_TERMS, PAIR_DOCUMENTS = 60.0, 2048, 20
CACHE_WORDS = 250_000
TERM = re.compile(r"[^\W_]+")
#: Lengths of the beginnings of words.
BEGINNINGS = (4, 5, 6, 7)
#: A term that so many different words of a text have counts as a term of its own.
REPEATS = (2, 4)


def _hash(term: str) -> int:
    return zlib.crc32(term.encode()) >> (32 - BITS)


class _Hashes(dict):
    """word -> hashes of its terms, remembered; only those in ``among`` if given."""

    def __init__(self, among: set[int] | None = None):
        self.among = among

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = (_hash(word), *(_hash(f"^{word[:n]}") for n in BEGINNINGS if len(word) >= n))
        value = self[word] = found if self.among is None else tuple(x for x in found if x in self.among)
        return value


def terms(text: str | None, hashes: _Hashes) -> np.ndarray:
    """The hashed terms of a text, sorted and unique."""
    found = np.fromiter(chain.from_iterable(map(hashes.__getitem__, set(TERM.findall((text or "").lower())))), np.int64)
    found, counts = np.unique(found, return_counts=True)
    return np.concatenate([found, *(found[counts >= n] + ((k + 1) << BITS) for k, n in enumerate(REPEATS))])


def _probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Machine:
    """bias + sum of w_i + sum of <v_i, v_j> over the pairs of a text's terms."""

    def __init__(self, ids: np.ndarray, factors: int):
        self.ids, self.bias = ids, 0.0
        self.w, self.v = np.zeros(len(ids)), np.random.default_rng(3).normal(0, 0.05, (len(ids), factors))

    def index(self, hashed: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, hashed)
        at[at == len(self.ids)] = 0
        return at[self.ids[at] == hashed] if len(self.ids) else at[:0]

    def margin(self, x: np.ndarray) -> float:
        v = self.v[x]
        total = v.sum(0)
        return self.bias + self.w[x].sum() + 0.5 * float((total * total - (v * v).sum(0)).sum())

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 25, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """AdaGrad on the weighted logistic loss."""
        rng, gb, gw, gv = np.random.default_rng(11), 1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                x = rows[i]
                g = weight[i] * (_probability(self.margin(x)) - y[i])
                gb += g * g
                self.bias -= rate * g / np.sqrt(gb)
                if len(x):
                    v = self.v[x]
                    dw, dv = g + ridge * self.w[x], g * (v.sum(0) - v) + ridge * v
                    gw[x] += dw * dw
                    gv[x] += dv * dv
                    self.w[x] -= rate * dw / np.sqrt(gw[x])
                    self.v[x] -= rate * dv / np.sqrt(gv[x])


def chi_square(pos: np.ndarray, df: np.ndarray, npos: float, n: float) -> np.ndarray:
    """Of presence in ``df`` texts, ``pos`` of them positive, against the label."""
    a, b, c, d = pos, df - pos, npos - pos, (n - npos) - (df - pos)
    return n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)


def paired_terms(where: np.ndarray, rows: np.ndarray, y: np.ndarray, df: np.ndarray, chi2: np.ndarray) -> np.ndarray:
    """Places of the terms that matter beside another.  ``where`` and ``rows`` give the
    term and the text of each occurrence."""
    common = np.argsort(-df, kind="stable")[:PAIR_TERMS]
    common = common[df[common] >= PAIR_DOCUMENTS]
    place = np.full(len(df), -1, np.int32)
    place[common] = np.arange(len(common))
    x = np.zeros((len(y), len(common)), np.float32)
    seen = place[where] >= 0
    x[rows[seen], place[where[seen]]] = 1
    positive, found = x[y > 0], np.zeros(len(common), bool)
    for a in range(0, len(common), 128):  # counts of pairs, some terms with all at a time
        both, pos = x[:, a : a + 128].T @ x, positive[:, a : a + 128].T @ positive
        gain = chi_square(pos.astype(float), both.astype(float), y.sum(), len(y)) - chi2[common[a : a + 128]][:, None] - chi2[common][None, :]
        gain[both < MIN_DOCUMENTS] = 0
        hit = gain >= PAIR_CHI2
        found |= hit.any(0)
        found[a : a + 128] |= hit.any(1)
    return common[found]


def fit(rows: list[np.ndarray], labels: np.ndarray, positive_share: float, factors: int = FACTORS) -> Machine:
    """Choose the terms that tell the classes apart, alone or beside another, and fit a
    machine to them."""
    y = (labels > 0).astype(float)
    n, npos = len(rows), y.sum()
    if not n or npos in (0, n):  # one class or none: its share is all that is known
        m = Machine(np.zeros(0, np.int64), factors)
        m.bias = float(np.log((positive_share + 1e-3) / (1 - positive_share + 1e-3)))
        return m
    all_ids, where = np.unique(np.concatenate(rows), return_inverse=True)
    where, text = where.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    df = np.bincount(where, minlength=len(all_ids)).astype(float)
    pos = np.bincount(where, weights=y[text], minlength=len(all_ids))
    chi2 = chi_square(pos, df, npos, n)
    chosen = (chi2 >= MIN_CHI2) & (df >= MIN_DOCUMENTS)
    chosen[paired_terms(where, text, y, df, chi2)] = True
    m = Machine(all_ids[chosen], factors)
    weight = np.where(y > 0, positive_share / npos, (1 - positive_share) / (n - npos)) * n
    m.fit([m.index(r) for r in rows], y, weight)
    return m


def train(docs: DataFrame, labels: DataFrame, learn=None, fit_rows: int = FIT_ROWS) -> Machine:
    """Fit on at most ``fit_rows`` rows of each class of ``labels(doc_id, toxic)``."""
    learn = crc_mod("doc_id", 4) != 2 if learn is None else learn
    sample, share = labelled_sample(docs, labels, "toxic", learn, fit_rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for b in batches:
            yield pd.DataFrame({"x": [terms(t, known).astype("<i4").tobytes() for t in b.text], "y": b.y})

    rows = sorted(map_texts(sample, hashed, "x binary, y int").collect(), key=lambda r: (r["x"], r["y"]))
    return fit([np.frombuffer(r["x"], "<i4") for r in rows], np.array([r["y"] for r in rows]), share)


def score(docs: DataFrame, model: Machine, column: str = "score") -> DataFrame:
    """``docs`` plus the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.bias, model.w, model.v))

    def probability(texts: list) -> list[float]:
        m = Machine.__new__(Machine)
        m.ids, m.bias, m.w, m.v = shared.value
        cache = worker_cache("toxicity")
        if cache.get("toxic_terms") is None or not np.array_equal(cache["toxic_terms"][0], m.ids):
            cache["toxic_terms"] = (m.ids, _Hashes(set((m.ids & ((1 << BITS) - 1)).tolist())))
        known = cache["toxic_terms"][1]
        return [float(_probability(m.margin(m.index(terms(t, known))))) for t in texts]

    return with_scores(docs, probability, column)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts have no terms and get the machine's bias; a null doc_id is
    never learned from and counts as not held out; repeated rows get equal scores;
    without labels of both classes the score is the class share; an empty table
    gives no rows.  Columns besides doc_id and text are never read.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op9_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
