"""Language-model scoring by a hashed maximum-entropy model.

A word's probability is factored over a tree of classes: that of its class given the
words before it, of its subclass in the class, and of its leaf in the subclass, each
a softmax over 16 with weights for the word before, the one before that (a skip) and
both together.  A leaf is a common word, or all further words of one kind of ending,
where counts share out what is left.  Weights are rows of a hashed table that
grows with the number of distinct training words; every word is told apart as
context.  Counts cover all training texts; the weights are trained on all of them, in
rounds of gradient updates on the executors whose changes are averaged.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stage

#: Classes of a class; common words, which have leaves of their own; leaves of other words.
FAN = 16
LEAVES = FAN**3
HEAD, TAIL_CLASSES = 14 * FAN * FAN, 2 * FAN * FAN
#: Rows of the table: a power of two near the number of distinct training words,
#: between these; 64 bytes each are broadcast.
LEAST_BITS, MOST_BITS = 13, 17
#: Gradient rounds; each training text gives gradients in one of them, that of its
#: part of a file.
ROUNDS, BATCH, RATE = 4, 8192, 0.15
#: Rows of the table in one block of changes; tasks whose changes are summed first.
BLOCK, TASKS = 1024, 64
#: Characters of text in one chunk.
CHUNK_CHARS = 8_000_000
END = b" "  # no word has a blank
_START = np.uint64(1 << 32)  # what stands before a text; no word has this hash
_LEVEL = np.array([0, 0, 0, 1, 2])  # of the weights' rows that a word has
_NOTHING = -40.0  # log of a leaf that no word has


def words_of(text: str) -> list[bytes]:
    """The folded words of a text and its end.  Bytes fold A-Z alone and are divided
    by ASCII white space alone, unlike strings."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def ending(word: bytes) -> int:
    """The kind of a word by its last two characters."""
    last = word[-2:] if word.isascii() else word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")
    return zlib.crc32(last) % TAIL_CLASSES


def _chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-chars // CHUNK_CHARS))
    return texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def _count(buckets: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        """Each word of a chunk with its count in the chunk's training texts."""
        counts, seen = Counter(), set()
        for text, out in zip(df.text, df.held_out, strict=True):
            (seen if out else counts).update(words_of(text))
        parts: dict[int, tuple[list, list]] = {}
        for w in sorted(seen | counts.keys()):
            p = parts.setdefault(zlib.crc32(w) % buckets, ([], []))
            p[0].append(w)
            p[1].append(counts.get(w, 0))
        chunk = int(df.chunk.iloc[0])
        return pd.DataFrame([(chunk, b, b"\n".join(w), np.array(c, "<i8").tobytes()) for b, (w, c) in parts.items()], columns=["chunk", "bucket", "words", "counts"])

    return run


_MERGED = "kind string, chunk int, words binary, counts binary, n long, v long"


def _merge(df: pd.DataFrame) -> pd.DataFrame:
    """Sum the chunks' counts; give them back to each chunk, and the bucket's totals."""
    total: Counter = Counter()
    lists = [(c, w.split(b"\n"), np.frombuffer(k, "<i8")) for c, w, k in zip(df.chunk, df.words, df.counts, strict=True)]
    for _, words, counts in lists:
        for w, c in zip(words, counts.tolist(), strict=True):
            total[w] += c
    rows = [("chunk", c, b"\n".join(w), np.array([total[x] for x in w], "<i8").tobytes(), 0, 0) for c, w, _ in lists]
    known = {w: c for w, c in total.items() if c}
    mass = np.zeros(TAIL_CLASSES, np.int64)
    for w, c in known.items():
        mass[ending(w)] += c + 1
    top = sorted(known.items(), key=lambda x: (-x[1], x[0]))[:HEAD]
    rows.append(("total", 0, b"\n".join(w for w, _ in top), mass.tobytes() + np.array([c for _, c in top], "<i8").tobytes(), sum(known.values()), len(known)))
    return pd.DataFrame(rows, columns=["kind", "chunk", "words", "counts", "n", "v"])


class Vocabulary:
    """The common words' leaves, what the leaves weigh by their counts, and the totals."""

    def __init__(self, top: list[tuple[bytes, int]], mass: np.ndarray, tokens: int, types: int):
        self.tokens, self.types = tokens, types
        self.bits = int(np.clip(int(types).bit_length(), LEAST_BITS, MOST_BITS))
        # classes by frequency, in a class neighbours by ending
        by_class = [sorted(top[a : a + FAN * FAN], key=lambda x: (x[0][::-1], x[0])) for a in range(0, len(top), FAN * FAN)]
        self.head = {w: a * FAN * FAN + k for a, words in enumerate(by_class) for k, (w, _) in enumerate(words)}
        rest = mass.astype(float)
        for w, c in top:
            rest[ending(w)] -= c + 1
        self.tail = rest + 1  # one place for a word never seen
        weight = np.zeros(LEAVES)
        for w, c in top:
            weight[self.head[w]] = c
        weight[HEAD:] = self.tail
        #: log of each child's share of its node, by level
        self.shares = []
        for level in range(3):
            sums = weight.reshape(FAN ** (level + 1), -1).sum(1).reshape(-1, FAN)
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.log(sums / sums.sum(1, keepdims=True))
            self.shares.append(np.where(np.isfinite(log), log, _NOTHING).astype(np.float32))

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """From the state of another: broadcasts carry plain values."""
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def leaf(self, word: bytes) -> int:
        found = self.head.get(word)
        return HEAD + ending(word) if found is None else found


class _Codes(dict):
    """word -> its hash and leaf in one number, remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = zlib.crc32(word) * LEAVES + self.vocabulary.leaf(word)
        return value


def contexts(hashes: np.ndarray, leaves: np.ndarray, starts: np.ndarray, bits: int) -> np.ndarray:
    """The rows of the table that are active for each word, (5, words): for its class
    the word before, the one before that and both; for its subclass, in its class, and
    for its leaf, in its subclass, the word before."""
    one, two = np.r_[_START, hashes[:-1]], np.r_[_START, _START, hashes[:-2]][: len(hashes)]
    one[starts] = _START
    two[starts] = _START
    after = starts + 1
    two[after[after < len(hashes)]] = _START
    class_, sub = (leaves // (FAN * FAN)).astype(np.uint64), (leaves // FAN).astype(np.uint64)
    mix = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    by_one, by_two = one * mix[0], two * mix[1]
    keys = np.stack([by_one, by_two, (by_one ^ (by_one >> np.uint64(29))) + by_two * mix[2], by_one + (class_ + np.uint64(1)) * mix[3], by_one + (sub + np.uint64(17)) * mix[3]])
    keys ^= keys >> np.uint64(32)
    keys *= mix[0]
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def softmax(weights: np.ndarray, shares: list[np.ndarray], rows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Probabilities (3, words, FAN) of each word's children on its path."""
    z = np.empty((3, len(leaves), FAN), np.float32)
    for k, level in enumerate(_LEVEL):
        if k in (0, 3, 4):
            z[level] = shares[level].take(leaves // FAN ** (3 - level), 0)
        z[level] += weights.take(rows[k], 0)
    np.clip(z, -60, 60, out=z)  # exp of it stays a float
    np.exp(z, out=z)
    z /= (z.reshape(-1, FAN) @ np.ones((FAN, 1), np.float32)).reshape(3, -1, 1)
    return z


def _digits(leaves: np.ndarray) -> np.ndarray:
    return np.stack([leaves // (FAN * FAN), leaves // FAN % FAN, leaves % FAN])


def log_probability(weights: np.ndarray, shares: list[np.ndarray], rows: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Natural log of each leaf's probability."""
    p = softmax(weights, shares, rows, leaves)
    return np.log(np.maximum(np.take_along_axis(p, _digits(leaves)[:, :, None], 2)[:, :, 0], 1e-30).astype(float)).sum(0)


def gradient_step(weights: np.ndarray, square: np.ndarray, touched: np.ndarray, shares: list[np.ndarray], rows: np.ndarray, leaves: np.ndarray) -> None:
    """One AdaGrad step on a batch of words; a row's steps shrink together."""
    n, all_rows = len(leaves), len(_LEVEL) * len(leaves)
    g = softmax(weights, shares, rows, leaves)
    np.put_along_axis(g, d := _digits(leaves)[:, :, None], np.take_along_axis(g, d, 2) - 1, 2)
    flat = rows.ravel() * all_rows + np.arange(all_rows)  # a sort of plain numbers
    flat.sort()
    row = flat // all_rows
    order = flat - row * all_rows
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    source = (_LEVEL[:, None] * n + np.arange(n)).ravel().take(order)
    # as complex numbers, so that two columns are summed at once
    total = np.add.reduceat(g.reshape(3 * n, FAN).view(np.complex64).take(source, 0), first, axis=0).view(np.float32)
    row = row[first]
    sums = square[row] + np.einsum("ij,ij->i", total, total) / FAN
    square[row] = sums
    total *= (RATE / np.sqrt(sums))[:, None]
    weights[row] -= total
    touched[row] = True


def _streams(texts, codes: _Codes):
    """hashes, leaves, starts of several texts in one row."""
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words])
    both = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    return (both // LEAVES).astype(np.uint64), both % LEAVES, np.r_[0, np.cumsum(lengths)[:-1]]


_CHANGES = "block int, part int, row binary, total binary, tasks binary"


def _summed(df: pd.DataFrame, part: int) -> pd.DataFrame:
    """One row for all changes of a block: sums, and how many tasks have changed a row."""
    total, tasks = np.zeros((BLOCK, FAN)), np.zeros(BLOCK, np.int64)
    for row, change, n in zip(df.row, df.total, df.tasks, strict=True):
        at = np.frombuffer(row, "<i4") % BLOCK
        total[at] += np.frombuffer(change, "<f4").reshape(-1, FAN)
        tasks[at] += np.frombuffer(n, "<i4")
    at, block = np.flatnonzero(tasks), int(df.block.iloc[0])
    return pd.DataFrame([(block, part, (at + block * BLOCK).astype("<i4").tobytes(), total[at].astype("<f4").tobytes(), tasks[at].astype("<i4").tobytes())], columns=["block", "part", "row", "total", "tasks"])


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The table of weights, (2 ** bits, FAN).  In each round every task starts from the
    shared weights, walks over its texts in batches with AdaGrad steps, and returns
    the change of each row; the changes are averaged by row over the tasks that made any."""
    sc = texts.sparkSession.sparkContext
    weights = np.zeros((1 << vocabulary.bits, FAN), np.float32)
    # a part of a file is one task's, so a round has whole tasks; what isn't read from files has one round
    of_round = F.pmod(F.xxhash64(F.lit(31), F.input_file_name(), F.input_file_block_start()), F.lit(rounds))
    texts = texts.where(~F.col("held_out")).select("text", of_round.alias("round"))

    for r in range(rounds):
        shared = sc.broadcast((vocabulary.__dict__, weights))

        def step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            state, w0 = shared.value
            vocabulary, w = Vocabulary.of(state), w0.copy()
            square, touched, codes = np.full(len(w), 1e-2, np.float32), np.zeros(len(w), bool), _Codes(vocabulary)
            for batch in batches:
                for c in range(0, len(batch), 500):
                    hashes, leaves, starts = _streams(batch.text.iloc[c : c + 500], codes)
                    rows = contexts(hashes, leaves, starts, vocabulary.bits)
                    for a in range(0, len(leaves), BATCH):
                        gradient_step(w, square, touched, vocabulary.shares, rows[:, a : a + BATCH], leaves[a : a + BATCH])
            at = np.flatnonzero(touched)
            part = TaskContext.get().partitionId() // TASKS
            for block, which in pd.Series(at).groupby(at // BLOCK):
                k = which.to_numpy()
                yield pd.DataFrame([(block, part, k.astype("<i4").tobytes(), (w[k] - w0[k]).astype("<f4").tobytes(), np.ones(len(k), "<i4").tobytes())], columns=["block", "part", "row", "total", "tasks"])

        changes = texts.where(F.col("round") == r).select("text").mapInPandas(step, _CHANGES)
        # summed for some tasks, then for all, so that a group never holds more than 64 tasks' changes of a block
        changes = changes.groupBy("block", "part").applyInPandas(lambda df: _summed(df, int(df.part.iloc[0]) // TASKS), _CHANGES)
        changes = changes.groupBy("block", "part").applyInPandas(lambda df: _summed(df, 0), _CHANGES)
        weights, total, tasks = weights.copy(), np.zeros_like(weights), np.zeros(len(weights), np.int64)
        for x in changes.collect():  # as many rows as the table has (72 bytes each), for every 4096 tasks
            at = np.frombuffer(x["row"], "<i4")
            total[at] += np.frombuffer(x["total"], "<f4").reshape(-1, FAN)
            tasks[at] += np.frombuffer(x["tasks"], "<i4")
        weights += total / np.maximum(tasks, 1)[:, None]
    return weights


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Null and empty texts are the end alone; a null doc_id counts as a training text;
    repeated rows are counted and scored each; if no text trains, every word is
    unseen; an empty table gives no rows; other columns are ignored.
    """
    texts, n = _chunked(docs)
    counted = texts.groupBy("chunk").applyInPandas(_count(n), "chunk int, bucket int, words binary, counts binary")
    merged = stage(counted.groupBy("bucket").applyInPandas(_merge, _MERGED), "lm-counts")
    totals = merged.where("kind = 'total'")
    sums = totals.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for words, counts in zip(b.words, b.counts, strict=True):
                c = np.frombuffer(counts, "<i8")[TAIL_CLASSES:]
                yield pd.DataFrame({"word": words.split(b"\n")[: len(c)], "c": c})

    def masses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for counts in b.counts:
                yield pd.DataFrame({"t": np.arange(TAIL_CLASSES), "m": np.frombuffer(counts, "<i8")[:TAIL_CLASSES]})

    top = totals.select("words", "counts").mapInPandas(spread, "word binary, c long").orderBy(F.desc("c"), "word").limit(HEAD).collect()
    mass = np.zeros(TAIL_CLASSES, np.int64)
    for r in totals.mapInPandas(masses, "t int, m long").groupBy("t").agg(F.sum("m").alias("m")).collect():
        mass[r["t"]] = r["m"]
    vocabulary = Vocabulary([(bytes(r["word"]), r["c"]) for r in top], mass, sums["n"] or 0, sums["v"] or 0)
    weights = train(texts, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.__dict__, weights))

    def score(df: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        state, weights = shared.value
        vocabulary = Vocabulary.of(state)
        words = list(chain.from_iterable(w.split(b"\n") for w in counts.words))
        seen = np.concatenate([np.frombuffer(c, "<i8") for c in counts.counts]) if len(counts) else np.empty(0, np.int64)
        place = {w: k for k, w in enumerate(words)}
        leaf = np.array([vocabulary.leaf(w) for w in words], np.int64)
        hashed = np.array([zlib.crc32(w) for w in words], np.uint64)
        count = np.log10(seen + 1.0)
        within = np.where(leaf < HEAD, 0.0, count - np.log10(vocabulary.tail[np.maximum(leaf - HEAD, 0)]))
        out, floor = [], float(np.log10(vocabulary.tokens + vocabulary.types + 1))
        rows_of, batch, held_words = [], [], 0

        def flush():
            at = np.concatenate(batch)
            lengths = np.array([len(x) for x in batch])
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            leaves = leaf[at]
            rows, logs = contexts(hashed[at], leaves, starts, vocabulary.bits), np.empty(len(at))
            for a in range(0, len(at), 4096):
                logs[a : a + 4096] = log_probability(weights, vocabulary.shares, rows[:, a : a + 4096], leaves[a : a + 4096])
            score, base, n_known = (np.add.reduceat(x, starts) for x in (logs / np.log(10) + within[at], count[at], (seen > 0)[at].astype(np.int64)))
            for k, (doc, held) in enumerate(rows_of):
                out.append((doc, held, int(lengths[k]), int(n_known[k]), vocabulary.tokens, float(base[k] - lengths[k] * floor), float(score[k])))
            rows_of.clear()
            batch.clear()

        for doc, text, held in zip(df.doc_id, df.text, df.held_out, strict=True):
            mine = words_of(text)
            batch.append(np.fromiter(map(place.__getitem__, mine), np.int64, len(mine)))
            rows_of.append((doc, held))
            held_words += len(mine)
            if held_words > 50_000:
                flush()
                held_words = 0
        if batch:
            flush()
        return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    back = merged.where("kind = 'chunk'").select("chunk", "words", "counts")
    done = texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def op6_maxent(spark, sf_dir):
    """Language-model scores of every document."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
