"""Decontamination of texts that repeat themselves, and of empty tables."""

import random
import time

import pytest

pytest.importorskip("gleaner.llm")

from gleaner.llm import decontaminate  # noqa: E402


def test_equals_alignment_with_the_whole_text():
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rnd.choice(vocabulary) for _ in range(n)] for n in (1, 2, 3, 5, 8, 13, 30, 60)] + [["same"] * 20, ["a", "b"] * 10, [rnd.choice("xyz") for _ in range(30)]]
    index = decontaminate.Index([(k, " ".join(x)) for k, x in enumerate(items)])
    for _ in range(150):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(120))] if rnd.random() < 0.7 else [rnd.choice("xyzab") for _ in range(rnd.randrange(120))]
        for _ in range(rnd.randrange(3)):
            piece = list(rnd.choice(items))
            for _ in range(int(rnd.choice([0, 0.15, 0.25, 0.35]) * len(piece))):
                i = rnd.randrange(len(piece))
                piece[i : i + rnd.randrange(2)] = rnd.choice([[], [rnd.choice(vocabulary)]]) or [rnd.choice(vocabulary)]
            i = rnd.randrange(len(words) + 1)
            words[i:i] = piece
        text = decontaminate.word_hashes(" ".join(words))
        got = {r[0]: r for r in index.find(" ".join(words))}
        for name, item, edits in index.items:
            distance, _, end = decontaminate.align(item, text)
            assert (distance <= edits) == (name in got)
            if name in got:
                assert got[name][1] == distance and got[name][3] == end


def test_repeated_words_and_lines_take_time_in_proportion():
    rnd = random.Random(2)
    line = " ".join(f"l{i}" for i in range(13))
    ordinary = [(i, " ".join(f"v{rnd.randrange(3000)}" for _ in range(60))) for i in range(990)]
    began = time.time()
    near = decontaminate.Index([(i, "rep " * 99 + "end") for i in range(20)])
    assert len(near.find("rep " * 20_000)) == 20
    many = decontaminate.Index(ordinary + [(1000 + i, line) for i in range(10)])
    assert len(many.find(f"{line} " * 400)) == 10
    assert time.time() - began < 15


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x")], "doc_id long, text string, distance string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 1
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
