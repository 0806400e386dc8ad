"""Tables that change together, by batches and streams."""

import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators import corpus, extract, upkeep
from gleaner.sources import textfiles, versions
from gleaner.sources.versions import Store
from gleaner.streaming import streams

FILES = "path string, size long, mtime_ns long, content string"


def source(spark, rows):
    return spark.createDataFrame([(p, len(c) if c is not None else None, m, c) for p, m, c in rows], FILES)


FIRST = [(f"src/f{i}.py", 1, f"import m{i}\ndef f{i}(x):\n    return x\n") for i in range(30)] + [("a.js", 1, "function one(a) {"), ("t.txt", 1, "plain words here")]
CHANGES = [("src/f3.py", 2, "class Other:\n    pass\n"), ("new.py", 1, "from q.w import e\n"), ("a.js", 2, None)]


def rows(df):
    return sorted(map(str, df.drop("_bucket").collect()))


def test_joint_update_equals_a_rebuild(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", 8)
    upkeep.apply_changes(store, 0, source(spark, FIRST))
    before = store.manifest()
    upkeep.apply_changes(store, 1, source(spark, CHANGES))
    gone = {p for p, _, _ in CHANGES}
    now = [r for r in FIRST if r[0] not in gone] + [r for r in CHANGES if r[2] is not None]
    for table, want in upkeep.derived_tables(source(spark, now)).items():
        assert rows(store.read(table).select(want.columns)) == rows(want), table
    touched = store.touched(source(spark, CHANGES), "path")
    after = store.manifest()
    assert 0 < len(touched) < 8
    assert all(after[k] == v for k, v in before.items() if k[1] not in touched)
    assert all(v != before.get(k) for k, v in after.items() if k[1] in touched)


def test_joint_update_writes_changes_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", 2)  # all buckets are touched
    upkeep.apply_changes(store, 0, source(spark, FIRST))
    later = [r for r in FIRST if r[0] not in {p for p, _, _ in CHANGES}] + [r for r in CHANGES if r[2] is not None]
    diff = corpus.refresh_diff(store.read("files"), source(spark, later))
    upkeep.apply_changes(store, 1, upkeep.changes_of(diff, source(spark, later)))
    for table in upkeep.TABLES:  # earlier the rows of all 33 files
        written = {r["path"] for r in spark.read.parquet(f"{tmp_path}/{table}/_version=1").select("path").distinct().collect()}
        assert written <= {"src/f3.py", "new.py"}, table
    for table, want in upkeep.derived_tables(source(spark, later)).items():
        assert rows(store.read(table).select(want.columns)) == rows(want), table


def test_a_version_without_its_mark_is_not_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", 4)
    upkeep.apply_changes(store, 0, source(spark, FIRST))
    whole = rows(store.read("files"))
    upkeep.apply_changes(store, 1, source(spark, CHANGES))
    changed = rows(store.read("files"))
    os.remove(tmp_path / "_manifests/version=1/_SUCCESS")  # killed before the commit
    assert store.versions() == [0] and rows(store.read("files")) == whole
    upkeep.apply_changes(store, 1, source(spark, CHANGES))  # and run again
    assert rows(store.read("files")) == changed


def test_empty_changes_and_missing_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", 4)
    assert store.read("files") is None
    upkeep.apply_changes(store, 0, source(spark, []))
    assert store.read("files") is None and store.versions() == [0]


def test_corpus_stream_takes_removed_paths_out(spark, tmp_path):
    schema = "path string, mtime_ns long, content string"
    batches = [[("a", 1, "one two three"), ("b", 1, "two"), ("c", 1, "three")], [("a", 2, "four words"), ("b", 3, None), ("b", 2, "later")], [("d", 1, "five")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.refresh_corpus(stream, str(tmp_path / "out"), str(tmp_path / "mark"), 8).awaitTermination()
        if k == 1:
            written = Store(spark, str(tmp_path / "out"), 8).manifest()
    want = extract.postings(spark.createDataFrame([("a", "four words"), ("c", "three"), ("d", "five")], "path string, content string"))
    assert rows(streams.last_version(spark, str(tmp_path / "out")).select(want.columns)) == rows(want)
    # a batch of one path wrote one bucket
    now = Store(spark, str(tmp_path / "out"), 8).manifest()
    assert sum(now[k] != written.get(k) for k in now) == 1


def test_corpus_stream_writes_a_batch_alone(spark, tmp_path, monkeypatch):
    """Batches that touch all buckets leave older rows where they are, until FOLD versions lie there."""
    monkeypatch.setattr(versions, "FOLD", 4)
    schema, now = "path string, mtime_ns long, content string", {}
    for k in range(7):
        batch = [(f"p{i}", k, f"word{k} other") for i in range(k * 20, k * 20 + 40)] + ([("p3", k, None)] if k == 5 else [])
        now |= {p: c for p, _, c in batch}
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.refresh_corpus(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark"), 4).awaitTermination()
        written = spark.read.parquet(str(tmp_path / f"out/rows/_version={k}"))
        assert written.select("path").distinct().count() == 40  # the whole table before
        want = extract.postings(spark.createDataFrame(list(now.items()), "path string, content string").where("content is not null"))
        assert rows(streams.last_version(spark, str(tmp_path / "out")).select(want.columns)) == rows(want)
    held = Store(spark, str(tmp_path / "out"), 4).manifest()
    assert all(sum("_keys" not in p for p in ps) == 4 for ps in held.values())  # folded by the fifth, two more since


def test_tables_without_keys_are_not_replaced_by_key(spark, tmp_path):
    store, one = Store(spark, str(tmp_path), 4), spark.createDataFrame([("a", 1)], "path string, n int")
    store.commit(0, {"t": (one, store.bucket("path"))}, None)
    with pytest.raises(ValueError):
        store.replace(1, one, ["path"], {"t": one})


def test_memory_stream_removes_keys(spark, tmp_path):
    schema = "seq long, namespace string, key string, value string, written_at timestamp"
    for part in ([(1, "n", "a", "x", 10), (2, "n", "b", "y", 20)], [(3, "n", "a", "z", 30), (4, "n", "b", None, 40)]):
        made = spark.createDataFrame([(s, n, k, v, t) for s, n, k, v, t in part], schema.replace("timestamp", "long"))
        made.withColumn("written_at", F.timestamp_seconds("written_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.upsert_memory(stream, str(tmp_path / "out"), str(tmp_path / "mark"), "namespace", "key", buckets=4).awaitTermination()
    got = streams.last_version(spark, str(tmp_path / "out")).select("key", "value", "seq", F.unix_timestamp("created_at")).collect()
    assert [tuple(r) for r in got] == [("a", "z", 3, 10)]


def test_event_log_compares_days_and_keeps_late_copies_out(spark, tmp_path):
    schema = "event_id long, recorded_at timestamp"
    day = 86_400
    for part in ([(1, 0), (2, day), (1, 0)], [(3, day), (2, day), (4, 5 * day)], [(1, 0), (5, None)], [(5, None)]):
        spark.createDataFrame(part, "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("recorded_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.append_events(stream, str(tmp_path / "log"), str(tmp_path / "mark")).awaitTermination()
    assert sorted(r["event_id"] for r in streams.read_log(spark, str(tmp_path / "log")).collect()) == [1, 2, 3, 4, 5]


def test_scan_of_text_files(spark, tmp_path):
    texts = {"a.txt": b"one", "b/c.PY": "é".encode(), "b/noext": b"x", "b/bad.md": b"a\xffb", "img.png": b"x", "nul.txt": b"a\x00b", "late.txt": b"x" * 5000 + b"\x00", "big.txt": b"x" * 300_000, ".git/h.txt": b"x", ".env": b"x"}
    for name, body in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["path"]: r["content"] for r in textfiles.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one", "b/c.PY": "é", "b/noext": "x", "b/bad.md": "a�b", "late.txt": "x" * 5000 + "\x00"}


@pytest.mark.parametrize("name,text", [("x.tar", False), ("Makefile", True), ("a.TXT", True)])
def test_text_names(spark, name, text):
    assert spark.range(1).select(corpus.is_text_name(F.lit(name))).first()[0] is text
