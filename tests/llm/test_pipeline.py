"""The stages of corpus_pipeline.py against plain Python, with null and repeated ids,
empty texts, equal rows, clashing columns and empty tables."""

import random
import re

import pytest

pytest.importorskip("gleaner.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gleaner.llm import packing, quality, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score string, _row_key string"


def prose(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta the of and to in is it on as".split()) + rnd.choice("abcdefghij") for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rnd, base = random.Random(5), tmp_path_factory.mktemp("sf")
    texts = [prose(rnd, rnd.randrange(20, 80)) for _ in range(60)]
    passage = prose(rnd, 40)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[1]), (5, prose(rnd, 50)), (None, texts[2]), (None, prose(rnd, 50)), (None, ""), (70, None), (71, ""), (72, texts[3]), (72, texts[3])]
    rows += [(80, f"{prose(rnd, 30)} {passage} {prose(rnd, 30)}"), (None, f"{prose(rnd, 20)} {passage}"), (7, f"{passage} {prose(rnd, 9)}"), (90, prose(rnd, 9000))]
    loud = [(100 + k, " ".join(w.upper() + "!!" for w in prose(rnd, 30).split())) for k in range(20)]
    rude = [(200 + k, f"{prose(rnd, 15)} idiot {prose(rnd, 15)}") for k in range(20)]
    spark.createDataFrame([(i, t, "en", "s", 0, "kept", "mine") for i, t in rows + loud + rude], SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = [(i, int(not 100 <= i < 120), int(200 <= i < 220)) for i, _ in rows[:60] + loud + rude]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_classifiers_keep_what_they_do_not_reject(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for stage, module, keep in ((corpus_pipeline.quality_stage, quality, lambda s: s >= 0.3), (corpus_pipeline.toxicity_stage, toxicity, lambda s: s < 0.3)):
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        scored = module.score(docs, module.train(docs, labels), "probability").collect()
        assert sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, (tuple(r)[:2] for r in scored if keep(r["probability"]))))
        assert not {r["doc_id"] for r in got.collect()} & set(range(100, 120) if module is quality else range(200, 220))
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_one_document_of_each_group_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := words(r[1])) >= 5 else {tuple(w)} if w else set() for r in rows]
    group = list(range(len(rows)))
    for _ in range(4):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for r, g in zip(rows, group, strict=True):
        if g not in least or (r[0] is None, r[0] or 0) < (least[g][0] is None, least[g][0] or 0):
            least[g] = r
    want = sorted(map(str, least.values()))
    assert sorted(str(tuple(r)) for r in corpus_pipeline.jaccard_stage(spark, docs, sf).collect()) == want
    local = spark.createDataFrame(rows, docs.schema)  # not a file scan
    assert sorted(str(tuple(r)) for r in corpus_pipeline.jaccard_stage(spark, local, sf).collect()) == want
    assert corpus_pipeline.jaccard_stage(spark, docs.limit(0), sf).count() == 0


def test_rows_with_a_passage_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 1").first()["text"]
    want = sorted(str(tuple(r)) for r in docs.collect() if passage not in (r["text"] or ""))
    got = corpus_pipeline.decontamination_stage(spark, docs, sf)
    assert sorted(str(tuple(r)) for r in got.collect()) == want and docs.count() == len(want) + 3
    assert corpus_pipeline.decontamination_stage(spark, docs.limit(0), sf).count() == 0


def test_run_packs_what_the_stages_keep(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, sf).collect(), docs.schema)
    want = sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in packing.pack_documents(docs).collect())
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"] or -1, r["ids_crc32"]) for r in got) == want and len(want) > 40
