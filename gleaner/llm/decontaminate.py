"""Benchmark decontamination: shared word pairs in item-sized windows, exact edit check.

Texts and items are sequences of folded words.  An edit changes two word pairs at most,
so within k edits of an item with D different pairs a text holds D - 2k of them in some
n + k words.  Text is cut into blocks of n + k words, any such window lies in two
neighbouring ones, and two blocks with enough of an item's different pairs are checked:
one pass over the words gives the least edit distance of the item to any part of them.
No match within the limit is lost, whatever the item's length and the kind of edits, and
work and memory follow the text's length even where it repeats itself without end.

The dealt generator, a CGK walk with sampled keys, isn't here: a walk of each of a
window's starts takes three steps for each word of the item, many times what the exact
pass takes for the whole window, and its keys lost edited passages (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, map_texts, worker_cache

#: Edits allowed for each word of an item.
EDIT_SHARE = 0.25
#: Items that one pass over the documents carries.
ITEM_BLOCK = 20_000
CACHE_WORDS = 250_000
#: Pairs of a text and the items that have them, looked up at a time.
ROWS = 1_000_000
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    known = worker_cache("decontaminate").setdefault("decontaminate_words", _Words())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of ``item`` to a part of ``text`` and where the first such
    part ends: a column of the alignment at a time, as the bits of two whole numbers
    (Myers, 1999)."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    every, last = (1 << len(item)) - 1, 1 << len(item) - 1
    up, down, distance = every, 0, len(item)
    least, end = distance, 0
    for j, w in enumerate(text.tolist(), 1):
        same = places.get(w, 0)
        flat = (((same & up) + up) ^ up) | same | down
        more, less = down | (every & ~(flat | up)), up & flat
        distance += bool(more & last) - bool(less & last)
        if distance < least:
            least, end = distance, j
            if not least:
                break
        vertical = same | down
        more, less = more << 1 & every, less << 1 & every
        up, down = less | (every & ~(vertical | more)), more & vertical
    return least, end


def least_edits(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance of ``item`` to a part of ``text``."""
    return least_match(item, text)[0]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of ``item`` to a part of ``text``, and that part's
    bounds (the first that ends earliest)."""
    item, text = item.tolist(), text.tolist()
    row, start = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, w in enumerate(item):
        new, at = [i + 1], [0]
        for j, x in enumerate(text):
            best, frm = row[j] + (w != x), start[j]
            if row[j + 1] + 1 < best:
                best, frm = row[j + 1] + 1, start[j + 1]
            if new[j] + 1 < best:
                best, frm = new[j] + 1, at[j]
            new.append(best)
            at.append(frm)
        row, start = new, at
    end = min(range(len(row)), key=row.__getitem__)
    return row[end], start[end], end


class Index:
    """Items' different word pairs."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, w, int(EDIT_SHARE * len(w))) for i, t in items if len(w := word_hashes(t))]
        each = [np.unique(self.pairs(w)) for _, w, _ in self.items]
        none = np.empty(0, np.uint64)
        self.pair = np.concatenate([none, *each])
        self.item = np.repeat(np.arange(len(each)), [len(x) for x in each])
        self.needed = np.array([max(1, len(x) - 2 * k) for x, (_, _, k) in zip(each, self.items, strict=True)], np.int64)
        self.span = np.array([len(w) + k for _, w, k in self.items], np.int64)
        order = np.argsort(self.pair, kind="stable")
        self.pair, self.item = self.pair[order], self.item[order]
        self.single = any(len(w) == 1 for _, w, _ in self.items)

    @staticmethod
    def pairs(w: np.ndarray) -> np.ndarray:
        return w.copy() if len(w) == 1 else w[:-1] * _PAIR + _mix(w[1:])

    def _blocks(self, pair: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, block) of blocks that with the next one hold enough pairs of the item."""
        low = np.searchsorted(self.pair, pair, "left")
        hit = np.flatnonzero(self.pair[np.minimum(low, len(self.pair) - 1)] == pair)
        low, pair, place = low[hit], pair[hit], place[hit]
        n = np.searchsorted(self.pair, pair, "right") - low
        items, blocks, kinds = [], [], []
        ends = np.cumsum(n)
        a = 0
        while a < len(hit):  # a bounded number of rows at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROWS, "right")))
            rows = np.repeat(low[a:b] - np.r_[0, np.cumsum(n[a:b])[:-1]], n[a:b]) + np.arange(n[a:b].sum())
            item = self.item[rows]
            block = np.repeat(place[a:b], n[a:b]) // self.span[item]
            # a row of the index is an item and a pair: with the block it counts once
            seen = np.unique(np.stack([item, block, rows], 1), axis=0) if len(rows) > 1 else np.stack([item, block, rows], 1)
            items.append(seen[:, 0]), blocks.append(seen[:, 1]), kinds.append(seen[:, 2])
            a = b
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        seen = np.stack([np.concatenate(x) for x in (items, blocks, kinds)], 1)
        seen = np.unique(seen, axis=0) if len(items) > 1 else seen
        change = np.flatnonzero(np.r_[True, (seen[1:, 0] != seen[:-1, 0]) | (seen[1:, 1] != seen[:-1, 1])])
        item, block, count = seen[change, 0], seen[change, 1], np.diff(np.r_[change, len(seen)])
        after = np.zeros(len(count), np.int64)
        next_to = (item[1:] == item[:-1]) & (block[1:] == block[:-1] + 1)
        after[:-1][next_to] = count[1:][next_to]
        before = np.r_[False, next_to]
        enough = count + after >= self.needed[item]
        # two blocks of which only the second has pairs are that block alone
        alone = (count >= self.needed[item]) & ~before
        return np.concatenate([item[enough], item[alone]]), np.concatenate([block[enough], block[alone] - 1])

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, first word, end word, item's words) of each item found."""
        w = word_hashes(text)
        if not len(w) or not len(self.pair):
            return []
        p = self.pairs(w)
        place = np.arange(len(p))
        if len(w) > 1 and self.single:
            p, place = np.concatenate([p, w]), np.r_[place, np.arange(len(w))]
        item, block = self._blocks(p, place)
        if not len(item):
            return []
        order = np.lexsort((block, item))
        item, block = item[order], block[order]
        found = []
        # neighbouring blocks of an item are one region
        cut = np.flatnonzero((item[1:] != item[:-1]) | (block[1:] > block[:-1] + 2)) + 1
        best: dict[int, tuple[int, int]] = {}
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(item)], strict=True):
            k, span = int(item[a]), int(self.span[item[a]])
            _, words, edits = self.items[k]
            left = max(0, int(block[a]) * span - edits)
            d, end = least_match(words, w[left : (int(block[b - 1]) + 2) * span + edits + 1])
            if d <= edits and (d, left + end) < best.get(k, (edits, len(w) + 1)):
                best[k] = (d, left + end)
        for k, (_, end) in best.items():
            name, words, edits = self.items[k]
            left = max(0, end - len(words) - edits)
            d, x, y = align(words, w[left:end])
            found.append((name, d, left + x, left + y, len(words)))
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word, item_words) for each row of
    ``docs(doc_id, text)`` and each item of ``benchmark(item_id, text)`` that occurs
    in it within a quarter of the item's words of edits (the best place).

    Null and empty texts and items match nothing; very long texts and such as repeat a
    line or a word are searched whole, in memory in proportion to their words; items of
    one to three words must occur exactly; repeated rows are reported each; null ids are kept; empty tables
    give no rows; other columns are ignored.  Items travel to the tasks in blocks of
    ``ITEM_BLOCK``; a larger benchmark takes more passes over the documents.
    """
    spark, schema = docs.sparkSession, "doc_id string, item_id string, distance int, start_word long, end_word long, item_words int"
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text")
    total, out = items.count(), None
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    for first in range(0, max(total, 1), ITEM_BLOCK):
        block = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.offset(first).limit(ITEM_BLOCK).collect()])

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            index = Index(block.value)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.doc_id, b.text, strict=True) for m in index.find(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start_word", "end_word", "item_words"])

        part = map_texts(texts, run, schema)
        out = part if out is None else out.unionByName(part)
    types = dict(docs.dtypes)
    return out.withColumn("doc_id", F.col("doc_id").cast(types["doc_id"])).withColumn("item_id", F.col("item_id").cast(dict(benchmark.dtypes)["item_id"]))


def op2_decontamination(spark, sf_dir):
    """Every benchmark passage in every document."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
