"""Quality classifier: a linear support vector machine over naive-Bayes features.

Indicators of n-grams are scaled by the log ratio of their smoothed counts in the
two classes, and a linear hinge-loss model is fitted to them by dual coordinate
descent.  Some n-grams run over word shapes (case, trailing marks, whether a word
repeats its predecessor), which carry over to words never seen; such an indicator says
that an n-gram makes up at least a given share of the text.  The others run over the
words themselves, hashed; theirs say that the text has the n-gram.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, with_scores, worker_cache

#: Labelled rows of each class that the fit uses at most.
FIT_ROWS = 3000
#: Features of shapes, and as many of words above them.
DIMENSIONS = 1 << 18
#: Weight of the words' block of features, and the sampled texts that such a feature needs.
WORDS, MIN_DOCUMENTS = 0.5, 5
#: An indicator for each share of the text's n-grams.
SHARES = (0.0, 0.02, 0.1, 0.3)
THRESHOLD = 0.3
CACHE_WORDS = 250_000
TAIL = re.compile(r"[\W_]*$")


class _Shapes(dict):
    """word -> hash of its shape and of the word, in one number, remembered."""

    def __missing__(self, word: str) -> int:
        tail = TAIL.search(word).group()
        body = word[: len(word) - len(tail)]
        case = "n" if not body else "d" if any(c.isdigit() for c in body) else "u" if body.isupper() and len(body) > 1 else "t" if body[0].isupper() else "l" if body.islower() else "m"
        value = zlib.crc32(f"{case}{tail[:3]}".encode()) & 1023 | zlib.crc32(body.lower().encode("utf-8", "surrogatepass")) << 10
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


def features(text: str | None) -> np.ndarray:
    """The indicator features of a text (sorted, unique; shapes before words); feature 0
    is always there."""
    shapes = worker_cache("quality").setdefault("word_shapes", _Shapes())
    words = (text or "").split()
    if not words:
        return np.array([0, 1], dtype=np.int64)
    both = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    ids, word = (both & 1023) * 2, both >> 10
    if len(words) > 1:
        ids[1:] += np.fromiter(map(operator.eq, words[1:], words[:-1]), np.int64, len(words) - 1)
    out = [np.array([0])]
    for order, grams in ((1, ids), (2, ids[:-1] * 2048 + ids[1:])):
        if len(grams):
            values, counts = np.unique(grams, return_counts=True)
            for level, share in enumerate(SHARES):
                hit = values[counts >= share * len(grams)]
                out.append(2 + ((hit * 0x9E3779B1 + order * 7919 + level * 104729) % 0xFFFFFFFB) % (DIMENSIONS - 2))
    pairs = (word[:-1] * 0x85EBCA77 + word[1:]) % 0xFFFFFFFB
    out.append(DIMENSIONS + np.concatenate([word, pairs]) % DIMENSIONS)
    return np.unique(np.concatenate(out))


def block_scale(x: np.ndarray) -> np.ndarray:
    """What a text's features are multiplied by: each block has length 1 before ratios."""
    shapes = int(np.searchsorted(x, DIMENSIONS))
    return np.r_[np.full(shapes, 1 / np.sqrt(max(shapes, 1))), np.full(len(x) - shapes, WORDS / np.sqrt(max(len(x) - shapes, 1)))]


def fit(rows: list[np.ndarray], labels: np.ndarray, positive_share: float, c: float = 1.0, epochs: int = 30, alpha: float = 1.0) -> dict:
    """Fit to ``rows`` of features: log-count ratios, then dual coordinate descent on
    the hinge loss with box constraint ``c``, then a logistic curve on the margins
    that restores the share of the positive class."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(rows) or abs(y.sum()) == len(rows):  # one class or none: its share is all that is known
        return {"weights": np.zeros(2 * DIMENSIONS, np.float32), "a": 0.0, "b": float(np.log((positive_share + 1e-3) / (1 - positive_share + 1e-3)))}
    p, q = np.full(2 * DIMENSIONS, alpha), np.full(2 * DIMENSIONS, alpha)
    for x, s in zip(rows, y, strict=True):
        (p if s > 0 else q)[x] += 1
    ratio = np.log(p / (y > 0).sum()) - np.log(q / (y < 0).sum())
    ratio[DIMENSIONS:][(p + q)[DIMENSIONS:] - 2 * alpha < MIN_DOCUMENTS] = 0.0
    ratio[0] = 1.0
    values = [(ratio[x] * block_scale(x)).astype(np.float32) for x in rows]
    norms = [float(v @ v) + 1e-9 for v in values]
    w = dual_descent(rows, values, norms, y, c, epochs)
    margins = np.array([float(w[x] @ v) for x, v in zip(rows, values, strict=True)])
    weight = np.where(y > 0, positive_share / (y > 0).sum(), (1 - positive_share) / (y < 0).sum()) * len(y)
    a, b = 1.0, 0.0
    target = np.where(y > 0, 0.995, 0.005)
    for _ in range(50):  # Newton steps with a small ridge
        z = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = weight * (z - target), weight * z * (1 - z) + 1e-9
        hessian = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([(g * margins).sum() + 1e-3 * a, g.sum() + 1e-3 * b]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return {"weights": (w * ratio).astype(np.float32), "a": float(a), "b": float(b)}


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], norms: list[float], y: np.ndarray, c: float, epochs: int) -> np.ndarray:
    """Weights of the linear hinge-loss model: a coordinate of the dual at a time, in
    random order, kept in the box from 0 to ``c``."""
    w, dual, rng = np.zeros(2 * DIMENSIONS), np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            new = min(max(dual[i] + (1 - y[i] * float(w[x] @ v)) / norms[i], 0.0), c)
            if new != dual[i]:
                w[x] += (new - dual[i]) * y[i] * v
                dual[i] = new
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, fit_rows: int) -> tuple[DataFrame, float]:
    """At most ``fit_rows`` labelled documents of each class (text, y), chosen by a
    hash of their id, and the positive share of all rows to learn from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    shares = known.agg(F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).alias("p")).first()["p"]
    order = F.xxhash64(F.lit(17), F.col("doc_id"))
    chosen = None
    for side in (F.col("y") > 0, F.col("y") <= 0):
        part = known.where(side).orderBy(order, "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = {r["doc_id"]: int(r["y"] > 0) for r in chosen.collect()}  # twice fit_rows at most
    spark = docs.sparkSession
    table = spark.createDataFrame([(int(i), y) for i, y in ids.items()], "doc_id long, y int")
    return docs.select("doc_id", "text").join(F.broadcast(table), "doc_id").select("text", "y"), 0.5 if shares is None else float(shares)


def train(docs: DataFrame, labels: DataFrame, learn=None, fit_rows: int = FIT_ROWS) -> dict:
    """Fit on at most ``fit_rows`` rows of each class of ``labels(doc_id, quality)``;
    features are made on the executors, the fit itself is bounded by the sample."""
    learn = crc_mod("doc_id", 5) != 0 if learn is None else learn
    sample, share = labelled_sample(docs, labels, "quality", learn, fit_rows)

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [features(t).astype("<i4").tobytes() for t in b.text], "y": b.y})

    rows = map_texts(sample, featurize, "x binary, y int").collect()
    rows = sorted(rows, key=lambda r: (r["x"], r["y"]))  # the fit doesn't hang on the order of tasks
    return fit([np.frombuffer(r["x"], "<i4") for r in rows], np.array([r["y"] for r in rows]), share)


def score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` plus the probability that a text's quality is 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def probability(texts: list) -> list[float]:
        m, out = shared.value, []
        for t in texts:
            x = features(t)
            out.append(float(1 / (1 + np.exp(-np.clip(m["a"] * float(m["weights"][x] @ block_scale(x)) + m["b"], -30, 30)))))
        return out

    return with_scores(docs, probability, column)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts get the score of a text without words; a null doc_id is
    never learned from and counts as not held out; repeated rows get equal scores;
    without labels of both classes the score is the class share; an empty table
    gives no rows.  Columns besides doc_id and text are never read.
    """
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op4_quality(spark, sf_dir):
    """Quality of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
