"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Only the number of pieces of each length (2048 numbers at most, however large
the corpus) decides where best-fit decreasing puts them: pieces of one length
are alike, and so are open bins of one remaining capacity.  The packing is
therefore computed once, exactly and for the whole corpus, over runs of alike
bins; a segment tree over the remaining capacities finds the tightest open bin.
The pieces themselves never leave the executors: each finds its place from its
rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, stage, worker_cache

CAPACITY = 2048
#: Word forms whose ids a Python worker remembers.
CACHE_WORDS = 800_000
#: White space as the tokenizer's own pattern sees it.  No match of that pattern
#: goes on from another character into white space, or from a letter into what is
#: no letter, digit or mark of a word, so texts may be cut there.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
WORD = re.compile(f"[{SPACE}]*[{LETTER}]+(?![^\\W_])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += bins
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open bin has."""
        node = need + self.leaves
        if self.open[node]:
            return need
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``{length: pieces}``: rows (length, first rank,
    first bin, offset, pieces a bin) and the number of bins.  Rank r of a length
    goes to bin ``first bin + (r - first rank) // pieces`` in the last row of that
    length whose first rank is not above r."""
    tree, runs, rows, bins = CapacityTree(capacity), {}, [], 0

    def put(free: int, start: int, n: int) -> None:
        if free and n:
            runs.setdefault(free, deque()).append((start, n))
            tree.add(free, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            free = tree.tightest(length)
            if free is None:  # open as many bins as the rest of this length fills
                free, start, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                start, n = runs[free].popleft()
                tree.add(free, -n)
            each = free // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, start, capacity - free, each))
                put(free - each * length, start, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left < each and left:  # the last of this length share one bin
                    rows.append((length, rank, start + full, capacity - free, left))
                    put(free - left * length, start + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                if full < n:
                    runs.setdefault(free, deque()).appendleft((start + full, n - full))
                    tree.add(free, n - full)
    return np.array(rows or np.empty((0, 5)), dtype=np.int64).reshape(-1, 5), bins


def _encoder(file: str):
    """text -> ids as little-endian 32-bit bytes, by the tokenizer's file.  Ids of
    words are remembered between texts; the tokenizer itself makes them."""
    cache = worker_cache("packing")
    if cache.get("tokenizer_file") != file:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        cache.update(tokenizer_file=file, tokenizer=Tokenizer.from_file(file), words={})
    tokenizer, words = cache["tokenizer"], cache["words"]

    def encode(texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            parts = WORD.findall(text)
            new = list(set(parts).difference(words))
            if len(words) + len(new) > CACHE_WORDS:
                words.clear()
                new = list(set(parts))
            for part, got in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                words[part] = pack_ids("<%dI" % len(got.ids), *got.ids)
            yield b"".join(map(words.__getitem__, parts))

    return encode


def tokenize(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``docs(doc_id, text)`` -> pieces (doc_id, piece, start, length, ids_crc32,
    task, local_rank): ids and one end id; documents above ``capacity`` ids are
    cut, the first piece takes what is over.  local_rank counts the pieces of this
    length in the task so far."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, seen, encode, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), _encoder(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.doc_id, encode(batch.text), strict=True):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                length = n - (n - 1) // capacity * capacity
                while at < n:
                    rows.append((doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), task, seen[length]))
                    seen[length] += 1
                    at, k, length = at + length, k + 1, capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])

    # the id travels as text, so that nulls don't turn it into a double
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = map_texts(texts, cut, "doc_id string, piece int, start long, length long, ids_crc32 long, task int, local_rank long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` of ``tokenize`` plus sequence_id and offset, by best-fit
    decreasing over all of them."""
    spark = pieces.sparkSession
    pieces = stage(pieces, "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("task", "length", before.alias("before"))
    # at most one row for each length: 2048
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_best_fit(histogram, capacity)
    shift = 44  # a length's ranks stay below 2**44
    keys = (plan[:, 0] << shift) | plan[:, 1]
    order = np.argsort(keys)
    plan = spark.sparkContext.broadcast((keys[order], plan[order]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rows = plan.value
        for b in batches:
            length, rank = b["length"].to_numpy(np.int64), b["_rank"].to_numpy(np.int64)
            row = rows[np.searchsorted(keys, (length << shift) | rank, side="right") - 1]
            at = rank - row[:, 1]
            b["sequence_id"] = row[:, 2] + at // row[:, 4]
            b["offset"] = row[:, 3] + at % row[:, 4] * length
            yield b.drop(columns="_rank")

    ranked = pieces.join(offsets, ["task", "length"]).select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("before")).alias("_rank"))
    placed = ranked.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast(pieces.schema["doc_id"].dataType))


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack ``docs(doc_id, text)``.

    Null and empty texts are documents of the end id alone; very long ones are cut
    into pieces; null and repeated doc_ids keep a piece for each row; pieces of
    equal length are interchangeable and take places in the order of the input;
    an empty table gives no rows.  Other columns are ignored.
    """
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("byte_bpe_50k.json")
    return pack(tokenize(docs, tokenizer_file, capacity), capacity)


def op1_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens at most."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
