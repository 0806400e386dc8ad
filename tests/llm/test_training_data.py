"""The training-data operators against brute force, on small tables with nulls,
empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

pytest.importorskip("gleaner.llm")
from pyspark.sql import functions as F  # noqa: E402

from gleaner.llm import chat, decontaminate, jaccard, maxent, order_minhash, packing, quality, sharding, toxicity, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rnd = random.Random(3)
    word = lambda: rnd.choice("alpha beta gamma delta the of and to in is it on as".split()) + rnd.choice(["", "x", "y", "z"])
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(40)]
    near = texts[0].split() * 3
    texts += [" ".join(near), " ".join([*near[:-1], "other"]), " ".join(["new", *near]), texts[1], texts[1], "", None, "  \n ", "one two", "One TWO", "word " * 3000, "é" * 50]
    rows = [(i, t, "en", "s", 0, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0, None), (None, "null id", None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k in range(len(bins)) if bins[k] >= n]
        if fits:
            k = min(fits, key=bins.__getitem__)
            bins[k] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_plan_equals_best_fit_decreasing():
    rnd = random.Random(1)
    for _ in range(150):
        capacity = rnd.choice([5, 16, 50])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 80))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan, bins = packing.plan_best_fit(histogram, capacity)
        filled = {}
        for n, count in histogram.items():
            rows = sorted(r for r in plan.tolist() if r[0] == n)
            for rank in range(count):
                _, first, start, offset, each = [r for r in rows if r[1] <= rank][-1]
                filled.setdefault(start + (rank - first) // each, []).append((offset + (rank - first) % each * n, n))
        for places in filled.values():
            end = 0
            for offset, n in sorted(places):
                assert offset == end
                end += n
        assert bins == len(filled)
        assert sorted(capacity - sum(n for _, n in p) for p in filled.values()) == best_fit(lengths, capacity)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, capacity=64).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc_id})
        assert sum(p[2] for p in pieces) == len(ids)
        for k, (piece, start, length, crc) in enumerate(pieces):
            assert piece == k and (length == 64 or k == 0)
            assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + length]))
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        end = 0
        for r in group:
            assert r["offset"] == end
            end += r["length"]
        assert end <= 64
    assert packing.pack_documents(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard(docs, 8).collect()
    assert len(got) == docs.count() and "lang" in got[0].asDict()
    slots = {}
    for r in got:
        slots.setdefault(r["_shard"], []).append(r["_slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shard(empty).count() == 0


def test_sharding_keeps_columns_that_clash(spark, tmp_path):
    names = ["_place", "_before", "_pid", "_key", "_deal", "_local", "_bucket", "_n", "pid", "c0", "_shard", "a b.c"]
    spark.createDataFrame([tuple(range(k, k + len(names))) for k in range(50)], ", ".join(f"`{n}` int" for n in names)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = sharding.shard(docs, 3).collect()
    kept = [n for n in names if n != "_shard"]
    assert sorted(tuple(r[n] for n in kept) for r in got) == sorted(tuple(r[n] for n in kept) for r in docs.collect())
    assert {r["_shard"] for r in got} == {0, 1, 2}


def test_communication_matrix_is_exact_and_uniform(spark):
    """Rows and columns of the matrix add up, and each cell has its hypergeometric mean."""
    counts = spark.createDataFrame([(p, n) for p, n in enumerate([7, 0, 12, 1, 20])], "pid int, n long")
    total = {}
    for seed in range(60):
        rows = sharding.communication_matrix(counts, 4, seed).collect()
        assert {r["pid"]: sum(r["deal"]) for r in rows} == {r["pid"]: r["n"] for r in rows}
        assert sorted(sum(r["deal"][s] for r in rows) for s in range(4)) == [10, 10, 10, 10]
        for r in rows:
            for s, x in enumerate(r["deal"]):
                total[r["pid"], s] = total.get((r["pid"], s), 0) + x
    for (p, s), x in total.items():
        n = {0: 7, 1: 0, 2: 12, 3: 1, 4: 20}[p]
        variance = n / 4 * 0.75 * (40 - n) / 39 * 60
        assert abs(x - 60 * n / 4) <= 5 * math.sqrt(variance) + 1e-9


def test_shuffle_leaves_no_order(spark, tmp_path):
    """Places in a shard hang neither on a row's place before nor on its partition."""
    spark.range(6000).repartitionByRange(3, "id").write.parquet(str(tmp_path / "d"))
    got = sharding.shard(spark.read.parquet(str(tmp_path / "d")), 3, 9, 50).collect()
    for s in range(3):
        mine = [(r["id"], r["_slot"]) for r in got if r["_shard"] == s]
        mean = [sum(x[k] for x in mine) / len(mine) for k in (0, 1)]
        cov = sum((a - mean[0]) * (b - mean[1]) for a, b in mine)
        spread = math.sqrt(sum((a - mean[0]) ** 2 for a, _ in mine) * sum((b - mean[1]) ** 2 for _, b in mine))
        assert abs(cov / spread) < 5 / math.sqrt(len(mine))
        follows = sum(b == a + 1 for a, b in itertools.pairwise(i for i, _ in sorted(mine, key=lambda x: x[1])))
        assert follows < 6  # one in expectation
        for part in range(3):  # 2000 of 6000 rows each
            assert abs(sum(i // 2000 == part for i, _ in mine) - 2000 / 3) < 5 * math.sqrt(2000 * 2 / 9)


def test_hypergeometric_law(spark):
    big = lambda x: F.lit(x).cast("long")
    counts = {r["k"]: r["count"] for r in spark.range(4000).select(sharding._hypergeometric(big(40), big(15), big(12), sharding.uniform(F.lit(3), F.col("id"))).alias("k")).groupBy("k").count().collect()}
    for k in range(2, 8):
        p = math.comb(15, k) * math.comb(25, 12 - k) / math.comb(40, 12)
        assert abs(counts[k] - 4000 * p) < 5 * math.sqrt(4000 * p)


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 2000), (2, None, "a" * 2000), (3, "u", "b"), (4, "u", "b"), (5, "u", None), (None, "u", "a" * 2000), (6, "x\ny", "a" * 2000), (7, "é", "\x1f\x8b\x08 é\r\n\r\n" * 300)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    assert warc.write_warc(warc.mark_revisits(pages), path).agg(F.sum("records")).first()[0] == 8
    for split in (7, 64, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_warc(spark, path, split).collect()}
        assert len(got) == 8
        assert got[1]["refers_to"] == got[2]["refers_to"] == got[None]["refers_to"] == 6 and got[6]["record_type"] == "response"
        assert got[3]["record_type"] == got[4]["record_type"] == "response" and got[5]["payload"] == ""
        assert got[7]["payload"] == "\x1f\x8b\x08 é\r\n\r\n" * 300 and got[1]["payload_bytes"] == 2000
        assert got[1]["payload_digest"] == hashlib.sha1(b"a" * 2000).hexdigest()
    # archives of attempts that Spark didn't commit lie there too, and aren't read
    listed = [r["archive"] for r in spark.read.parquet(f"{path}/_archives").collect()]
    folder = tmp_path / "warc"
    (folder / "part-00000-0000-zombie.warc.gz").write_bytes((folder / listed[0]).read_bytes())
    (folder / "part-00001-0000-cut.warc.gz").write_bytes((folder / listed[0]).read_bytes()[:40])
    again = [r["page_id"] for r in warc.read_warc(spark, path).collect()]
    assert len(again) == 8 and set(again) == set(got)
    warc.write_warc(warc.mark_revisits(pages.limit(3)), path)  # a folder written again holds the new records alone
    assert warc.read_warc(spark, path).count() == 3
    assert warc.archive(pages.limit(0)).count() == 0


def test_quality_and_toxicity(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["an", "the", "on", "er", "st"]) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = [word() for _ in range(40)]
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[7] = "idiot"
        rows.append((i, " ".join(words), None))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(None, "no id", None), (400, None, None), (401, "", None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, label in ((quality, 1), (toxicity, 2)):
        got = module.classify(docs, marks).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        held = [r for r in got if r["held_out"]]
        assert held and sum(r["predicted"] == labels[r["doc_id"]][label] for r in held) >= 0.97 * len(held)
        assert module.classify(docs, marks.limit(0)).count() == len(rows)
        assert module.classify(docs.limit(0), marks).count() == 0


def test_chat_repair_is_cheapest(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BITS", 2)
    rnd, labels = random.Random(2), {}
    for k in range(25):
        labels[k] = [rnd.choice(["system", "user", "assistant", "bot", None]) for _ in range(rnd.randint(1, 6))]
    rows = [(k if k else None, i, role, None if i == 1 else f"t{i}") for k, roles in labels.items() for i, role in enumerate(roles)]
    got = {}
    for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(r["conv_id"] or 0, []).append(r)

    def cost(roles, chosen):
        state, total = 0, 0.0
        for label, q in zip(roles, chosen, strict=True):
            total += chat._STEP.get((state, q), (chat.INF,))[0] + (0 if label == chat.ROLES[q - 1] else chat.RELABEL if label in chat.ROLES else chat.UNKNOWN)
            state = q
        return total + chat._END[state]

    for k, roles in labels.items():
        mine = [chat.ROLES.index(r["role"]) + 1 for r in sorted(got[k], key=lambda r: r["turn"])]
        assert cost(roles, mine) == min(cost(roles, c) for c in itertools.product((1, 2, 3), repeat=len(roles)))
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_messages_make_up_the_conversation(spark, monkeypatch):
    """Blocks of 4 turns: long conversations, ties, repeated turns, extra columns."""
    monkeypatch.setattr(chat, "BLOCK_BITS", 2)
    rnd, rows = random.Random(7), []
    for k in range(12):
        rows += [(k or None, i, rnd.choice(["system", "user", "user", "assistant", "Bot", None]), rnd.choice([None, "", f"t{i}", "long " * 500]), "x") for i in range(rnd.choice([1, 3, 25, 60]))]
    rows += [(5, 0, "user", "again", "x"), (5, 0, "user", "again", "x"), (6, None, "assistant", "last", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string")
    got = chat.repair(table).collect()
    assert len(got) == len(rows)
    by, pieces = {}, {}
    for r in sorted(got, key=lambda r: r["at"]):
        by.setdefault(r["conv_id"], []).append(r)
    for r in chat.messages(chat.repair(table)).collect():
        pieces.setdefault(r["conv_id"], []).append(r)
    for conv, turns in by.items():
        number, state, parts = -1, None, []  # plain walk over the turns as repaired
        for r in turns:
            if r["inserted"]:
                number, state = number + 1, r["inserted"]
                parts.append([number, state, f"<|{state}|>\n\n"])
            text = r["rendered"].removeprefix(f"<|{r['inserted']}|>\n\n" if r["inserted"] else "")
            if r["action"] == "keep":
                number, state = number + 1, r["role"]
                parts.append([number, state, ""])
            assert (r["message"], r["role"]) == (number, state)
            closing = f"<|{r['closed']}|>\n\n" if r["closed"] else ""
            parts[-1][2] += text.removesuffix(closing)
            if closing:
                parts.append([number + 1, r["closed"], closing])
        roles = [p[1] for p in parts]
        assert roles[-1] == "assistant" or roles == ["system"]
        assert all(a != b and b != "system" for a, b in itertools.pairwise(roles))
        want = {}
        for r in sorted(pieces[conv], key=lambda r: (r["message"], r["part"])):
            want.setdefault(r["message"], [r["message"], r["role"], ""])[2] += r["rendered"]
        assert parts == list(want.values())
        assert "".join(p[2] for p in parts) == "".join(r["rendered"] for r in turns)


def test_jaccard_components(docs, empty):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.where("doc_id is not null").collect()}
    least = {d: d for d in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    got = jaccard.link_documents(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), least[r["doc_id"]])
    assert jaccard.link_documents(empty).count() == 0


def test_block_links_equal_brute_force():
    import numpy as np

    rnd = random.Random(6)
    sets = [(k, np.array(sorted(rnd.sample(range(30), rnd.randint(1, 28))))) for k in range(60)]
    got = {(min(a, b), max(a, b)) for a, b in jaccard.block_links(sets[:30], sets)}
    want = {(min(a, b), max(a, b)) for a, x in sets[:30] for b, y in sets if a != b and 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))}
    assert got == want


def test_decontamination(spark):
    rnd = random.Random(8)
    items = [(k, " ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(12, 40)))) for k in range(20)] + [(98, None), (99, "")]
    rows, want = [], set()
    for d in range(120):
        k = rnd.randrange(20)
        w = items[k][1].split()
        for _ in range(rnd.randrange(0, len(w) // 6 + 1)):
            w[rnd.randrange(len(w))] = "changed"
        noise = lambda: [f"n{rnd.randrange(1000)}" for _ in range(rnd.randrange(80))]
        planted = d % 2 == 0
        rows.append((d, " ".join(noise() + (w if planted else []) + noise()), "x"))
        if planted:
            want.add((d, k))
    rows += [(None, items[0][1], "x"), (500, None, "x"), (501, "", "x"), (0, rows[0][1], "x")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None} == want
    assert (None, 0) in {(r["doc_id"], r["item_id"]) for r in got}


def test_language_model(spark, docs, empty):
    got = {r["doc_id"]: r for r in maxent.score_texts(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(2)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) + [" "]
    counts = {}
    for i, t in texts.items():
        for w in [] if held(i) else tokens(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
        assert r["score"] < 0
    assert maxent.score_texts(empty).count() == 0


def test_order_minhash(docs, empty):
    got = order_minhash.fingerprint_documents(docs).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()))
    assert len(got) == docs.count()
    prints = {}
    for r in got:
        text = dict(rows).get(r["doc_id"], "null id")
        prints.setdefault(text, set()).add(r["fingerprint"])
        assert r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1
    assert all(len(x) == 1 for x in prints.values())
    text, following = rows[10][1], rows[11][1]
    want = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    assert next(r for r in got if r["doc_id"] == 10)["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert order_minhash.fingerprint_documents(empty).count() == 0


def test_long_edited_items_are_all_found():
    import numpy as np

    rnd = random.Random(12)
    for _ in range(300):
        item, text = (np.array([rnd.randrange(6) for _ in range(rnd.randint(1, n))], np.uint64) for n in (20, 40))
        assert decontaminate.least_edits(item, text) == decontaminate.align(item, text)[0]
    lost = []
    for size, share, kind in itertools.product((60, 80, 120, 200), (0.15, 0.25), ("insert", "delete", "substitute")):
        for trial in range(8):
            words = [f"w{rnd.randrange(5000)}" for _ in range(size)]
            index = decontaminate.Index([(0, " ".join(words))])
            places = sorted(rnd.sample(range(size), int(share * size)), reverse=True)
            for p in places:
                words[p : p + (kind != "insert")] = [] if kind == "delete" else ["changed"]
            noise = [[f"n{rnd.randrange(1000)}" for _ in range(rnd.randrange(80))] for _ in range(2)]
            found = index.find(" ".join(noise[0] + words + noise[1]))
            if not found or found[0][1] > len(places):
                lost.append((size, share, kind, trial))
    assert not lost
    one = decontaminate.Index([("a", "lone"), ("b", "two words")])
    assert one.find("x y lone two words") == [("a", 0, 2, 3, 1), ("b", 0, 3, 5, 2)]
    assert one.find("lone x") == [("a", 0, 0, 1, 1)]


def test_half_edited_texts_keep_a_likeness(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(401))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = order_minhash.fingerprint_documents(docs).collect()
    assert sum(r["near_edited"] == 0 for r in got) <= 1
    assert all(len(r["fingerprint"]) >= 8 * 60 for r in got)
    prints = {r["doc_id"]: {r["fingerprint"][k : k + 8] for k in range(0, len(r["fingerprint"]), 8)} for r in got}
    for r in got:
        mine, following = prints[r["doc_id"]], prints[(r["doc_id"] + 1) % 300]
        assert r["next_doc_id"] == (r["doc_id"] + 1) % 300
        assert math.isclose(r["near_next"], len(mine & following) / len({x[:2] for x in mine | following}))


def plain_signature(text, k=2, bins=64, keep=2):
    """64 turns of the circle of hashes, in each the two smallest numbered k-mers in text order."""
    import xxhash

    def spark_hash(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x, seed=seed)
        return seed

    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    if not words:
        return []
    grams, seen = [], {}
    for i in range(max(len(words) - k, 0) + 1):
        h = spark_hash(*(words[i + j].encode() if i + j < len(words) else b"" for j in range(k))) >> 31
        n = seen[h] = seen.get(h, -1) + 1
        grams.append((h if n == 0 else spark_hash(h.to_bytes(8, "little"), n.to_bytes(4, "little")) >> 31, i))
    out = []
    for turn in range(bins):
        start = turn << (33 - 6)
        least = sorted(grams, key=lambda g: ((g[0] - start) % (1 << 33), g[1]))[:keep]
        out.append(turn << 32 | spark_hash(*(h.to_bytes(8, "little") for h, _ in sorted(least, key=lambda g: g[1]))) >> 32)
    return out


def test_order_minhash_equals_plain_python(spark):
    rnd = random.Random(31)
    texts = [" ".join(f"w{rnd.randrange(30)}" for _ in range(n)) for n in (1, 2, 3, 4, 12, 60, 300)] + ["", None, "a a a a a a", "é\u00a0x  y\tz", "word " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["s"] for r in order_minhash.signatures(rows, "text", "s").collect()}
    assert got == {k: plain_signature(t or "") for k, t in enumerate(texts)}


def test_order_minhash_of_short_texts_sees_the_order(spark):
    rnd, near = random.Random(32), {}
    for n in (12, 24, 48, 400):
        likeness = []
        for _ in range(40):
            blocks = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(4)) for _ in range(n // 4)]
            a, b = plain_signature(" ".join(blocks)), plain_signature(" ".join(blocks[::-1]))
            likeness.append(sum(x == y for x, y in zip(a, b, strict=True)) / 64)
        near[n] = sum(likeness) / len(likeness)
    assert all(x < 0.45 for x in near.values()), near


def test_every_training_text_gives_gradients(spark):
    import numpy as np

    words = [b"w%d" % k for k in range(32)]
    texts = spark.createDataFrame([(str(k), f"x{k} {w.decode()}", k == 31) for k, w in enumerate(words)], "doc_id string, text string, held_out boolean")
    vocabulary = maxent.Vocabulary([(w, 3) for w in words], np.zeros(maxent.TAIL_CLASSES, np.int64), 96, 32)
    weights = maxent.train(texts, vocabulary)
    moved = []
    for k, w in enumerate(words):
        mine = [b"x%d" % k, w, maxent.END]
        rows = maxent.contexts(np.array([zlib.crc32(x) for x in mine], np.uint64), np.array([vocabulary.leaf(x) for x in mine]), np.array([0]), vocabulary.bits)
        moved.append(bool(weights[rows[4, 1]].any()))  # the word's own leaf after x{k}
    assert moved == [True] * 31 + [False]


def test_language_model_score_is_a_softmax_of_sums(spark, tmp_path):
    """Scores against a plain walk down the class tree; probabilities sum to 1."""
    import numpy as np

    rnd = random.Random(21)
    texts = [(k, " ".join(rnd.choice(["a b", "b c", "c a d", f"r{rnd.randrange(50)}"]) for _ in range(30))) for k in range(80)] + [(80, ""), (81, None), (None, "a b"), (3, "a b c")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    docs, kept = spark.read.parquet(str(tmp_path / "d")), {}
    train = maxent.train
    try:
        maxent.train = lambda t, v: kept.setdefault("model", (v, train(t, v)))[1]
        got = maxent.score_texts(docs).collect()
    finally:
        maxent.train = train
    vocabulary, weights = kept["model"]
    counts, mask = {}, (1 << 64) - 1
    for i, t in texts:
        for w in (t or "").split() + [" "]:
            counts[w] = counts.get(w, 0) + (i is None or zlib.crc32(str(i).encode()) % 7 != 2)
    A, B, C, D = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93

    def row(key):
        key &= mask
        return ((key ^ (key >> 32)) * A & mask) >> (64 - vocabulary.bits)

    def children(level, node, one, two):
        a, b = one * A & mask, two * B & mask
        keys = [[a, b, (a ^ (a >> 29)) + b * C], [a + (node + 1) * D], [a + (node + 17) * D]][level]
        z = [float(vocabulary.shares[level][node][k]) + sum(float(weights[row(x)][k]) for x in keys) for k in range(16)]
        total = sum(math.exp(x) for x in z)
        return [math.exp(x) / total for x in z]

    def probability(leaf, one, two):
        return children(0, 0, one, two)[leaf // 256] * children(1, leaf // 256, one, two)[leaf // 16 % 16] * children(2, leaf // 16, one, two)[leaf % 16]

    assert math.isclose(sum(probability(leaf, zlib.crc32(b"a"), 1 << 32) for leaf in range(0, 4096)), 1, rel_tol=1e-6)
    tail = {}
    for w, c in counts.items():
        if c and w.encode() not in vocabulary.head:
            tail[vocabulary.leaf(w.encode())] = tail.get(vocabulary.leaf(w.encode()), 0) + c + 1
    by_text = {}
    for r in got:
        by_text.setdefault((r["doc_id"], r["n_tokens"]), r["score"])
    for i, t in texts:
        words, log, one, two = (t or "").split() + [" "], 0.0, 1 << 32, 1 << 32
        for w in words:
            leaf = vocabulary.leaf(w.encode())
            log += math.log10(probability(leaf, one, two)) + (0 if leaf < maxent.HEAD else math.log10((counts[w] + 1) / (tail.get(leaf, 0) + 1)))
            two, one = one, zlib.crc32(w.encode())
        assert math.isclose(by_text[i, len(words)], log, rel_tol=1e-4), (i, t)
    assert np.abs(weights).max() > 0.05


def test_all_links_around_a_centre(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rnd = random.Random(15)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base)] + [" ".join(w if k != p else "other" for k, w in enumerate(base)) for p in range(0, 100, 5)]
    texts += [" ".join(base[: rnd.randrange(60, 100)]) for _ in range(20)] + texts[:3]
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for t in texts]
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    described, links = jaccard.join_documents(spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (99, None)], "doc_id long, text string"))
    of = {r["doc_id"]: r["class"] for r in described.where("doc_id is not null").collect()}
    got = [tuple(r) for r in links.collect()]
    want = {(min(x, y), max(x, y)) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if linked(a, b) and (x := of[i]) != (y := of[j])}
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r["doc_id"]: r["n_links"] for r in jaccard.link_counts(described, links).collect()}
    assert counts == {i: sum(linked(a, b) for b in sets) - 1 for i, a in enumerate(sets)} | {None: 0, 99: 0}
    rows = {r["doc_id"]: r for r in jaccard.link_documents(spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (99, None)], "doc_id long, text string")).collect()}
    assert {i: r["n_links"] for i, r in rows.items()} == counts
    assert all(rows[i]["class"] == of[i] for i in of)


def test_rare_shingles_that_chain_texts_without_links_stay_apart(spark):
    """Each text shares one passage with the next: no links, and no cluster of more
    than a text and its neighbours."""
    passage = lambda k: [f"p{k}x{j}" for j in range(30)]
    texts = [" ".join(passage(k) + passage(k + 1)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard.link_documents(docs).collect()} == {(k, k, 0) for k in range(60)}
    texts = [" ".join(f"c{j}" for j in range(k, k + 100)) for k in range(0, 600, 10)]  # a chain of links
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.link_documents(docs).collect()}
    assert got == {k: (0, 1 if k in (0, 59) else 2) for k in range(60)}


def test_factorization_machine_sums_all_pairs():
    import numpy as np

    rnd = np.random.default_rng(5)
    m = toxicity.Machine(np.arange(12), 3)
    m.bias, m.w, m.v = 0.3, rnd.normal(size=12), rnd.normal(size=(12, 3))
    for size in (0, 1, 2, 7, 12):
        x = rnd.choice(12, size, replace=False)
        want = m.bias + sum(m.w[i] for i in x) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(x, 2))
        assert math.isclose(m.margin(x), want, rel_tol=1e-9, abs_tol=1e-9)


def test_toxicity_of_pairs_that_no_part_gives_away():
    """A text is toxic if it has both of two words; each alone is as common in clean
    texts.  Linear weights can't tell them apart, the pairs' factors can."""
    import numpy as np

    rnd, hashes = random.Random(1), toxicity._Hashes()

    def texts(n):
        rows = []
        for i in range(n):
            w = ["".join(rnd.choice(["an", "the", "on", "er", "st", "ka", "mo"]) for _ in range(rnd.randrange(2, 5))) for _ in range(40)]
            w[:2] = [["blorg", "zentari"], ["blorg", "x"], ["zentari", "x"], ["x", "x"]][i % 4]
            rnd.shuffle(w)
            rows.append(toxicity.terms(" ".join(w), hashes))
        return rows, np.array([int(i % 4 == 0) for i in range(n)])

    m = toxicity.fit(*texts(1600), 0.25)
    rows, want = texts(400)
    right = lambda: np.mean([(m.margin(m.index(x)) > 0) == y for x, y in zip(rows, want, strict=True)])
    assert right() >= 0.97
    m.v[:] = 0
    assert right() <= 0.8


def test_dual_descent_reaches_the_least_hinge_loss(monkeypatch):
    """Against projected gradient steps on the whole dual."""
    import numpy as np

    monkeypatch.setattr(quality, "DIMENSIONS", 4)
    rnd, c = np.random.default_rng(3), 0.7
    x = rnd.normal(size=(30, 8))
    y = np.where(x[:, 0] + 0.8 * rnd.normal(size=30) > 0, 1.0, -1.0)
    rows = [np.arange(8)] * 30
    w = quality.dual_descent(rows, list(x), [float(v @ v) for v in x], y, c, 400)
    loss = lambda w: 0.5 * w @ w + c * np.maximum(0, 1 - y * (x @ w)).sum()
    dual, step = np.zeros(30), 1 / np.linalg.norm((x * y[:, None]) @ (x * y[:, None]).T, 2)
    for _ in range(30000):
        dual = np.clip(dual + step * (1 - y * (x @ (x.T @ (dual * y)))), 0, c)
    best = loss(x.T @ (dual * y))
    assert loss(w) <= best * (1 + 1e-3) + 1e-6


def test_quality_by_words_of_one_shape():
    """Texts that differ in their words alone, not in case, marks or repeats."""
    import numpy as np

    rnd = random.Random(8)
    good, bad = ([f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] for a in ("ga", "bu"))
    texts = [(" ".join(rnd.choice((good if i % 2 else bad) if rnd.random() < 0.3 else ["zz", "yy", "xx"]) for _ in range(40)), i % 2) for i in range(500)]
    rows = [quality.features(t) for t, _ in texts]
    m = quality.fit(rows[:400], np.array([y for _, y in texts[:400]]), 0.5)
    right = [(m["a"] * float(m["weights"][x] @ quality.block_scale(x)) + m["b"] > 0) == bool(y) for x, (_, y) in zip(rows[400:], texts[400:], strict=True)]
    assert sum(right) >= 95
    long = " ".join(["word"] * 200_000)
    assert len(quality.features(long)) < 40 and list(quality.features("")) == list(quality.features(None))


def test_query_columns_of_contracts(spark, tmp_path):
    """op3, op4 and op9 as returned: sizes, checksums, held-out rows, laws."""
    rnd = random.Random(17)
    rows = [(i, " ".join(rnd.choice(["one", "two", "Three", "é"]) for _ in range(rnd.randrange(1, 30)))) for i in range(60)] + [(None, None), (61, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    texts = dict(rows)
    got = sharding.op3_sharding(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows)
    assert {r["shard"] for r in got} == set(range(8))
    for query, n, rest in ((quality.op4_quality, 5, 0), (toxicity.op9_toxicity, 4, 2)):
        out = query(spark, str(tmp_path)).collect()
        assert len(out) == len(rows) and {r["doc_id"] for r in out} == set(texts)
        for r in out:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % n == rest)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
