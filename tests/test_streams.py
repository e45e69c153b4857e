"""Streams over real files: changes, renames, deletions, repeats."""

import os
import time

from pyspark.sql import functions as F

from prosopon.functions import diagnostics
from prosopon.plans.synth import FORMS, PROFILE
from prosopon.sources import docx
from prosopon.streaming import ingest, store


def table(spark, place):
    return {r.id: r.path for r in store.current(spark, place).collect()}


def test_file_changes_reach_the_store(spark, tmp_path):
    base, place, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    base.mkdir()

    def put(name, text, age):
        (base / name).write_bytes(docx.write_docx([text]))
        os.utime(base / name, (time.time() - age,) * 2)

    def work_off():
        store.run_available(ingest.file_changes(ingest.file_stream(spark, str(base))), store.upsert(place), mark)

    put("A 1.docx", "one", 300)
    put("B 2.docx", "two", 300)
    work_off()
    assert table(spark, place) == {"a-1": "A 1.docx", "b-2": "B 2.docx"}
    first = {r.id: r.digest for r in store.current(spark, place).collect()}
    put("C 3.docx", "three", 100)
    work_off()
    work_off()
    assert set(table(spark, place)) == {"a-1", "b-2", "c-3"}
    assert {r.id: r.digest for r in store.current(spark, place).collect()}["a-1"] == first["a-1"]

    gone = ingest.tombstones(spark.createDataFrame([("B 2.docx",)], "path string").withColumn("at", F.current_timestamp()))
    store.upsert(place)(gone, 50)
    assert set(table(spark, place)) == {"a-1", "c-3"}
    store.fold(spark, place)
    assert set(table(spark, place)) == {"a-1", "c-3"}


def test_snapshots_find_edits_deletions_and_returns(spark, tmp_path):
    base, place = tmp_path / "in", str(tmp_path / "store")
    base.mkdir()
    schema = store.with_payload(f"{ingest.FILE_FACTS}, last_name string")
    vitals = "VOS, Jan, Danish poet and first Head of the Sea Office 1920-1925, was born 2 May 1880"
    number = iter(range(100))

    def put(name, surname, age):
        (base / name).write_bytes(docx.write_docx([vitals.replace("VOS", surname)]))
        os.utime(base / name, (time.time() - age,) * 2)

    def work_off():
        n = next(number)
        ingest.refresh(spark, str(base), place, schema, f"2024-01-{n + 1:02d}", n, ingest.extraction(PROFILE, FORMS, ("modified", "length")))
        return {r.path: r.last_name for r in store.current(spark, place, schema).collect()}

    assert work_off() == {}
    put("A 1.docx", "VOS", 300)
    put("B 2.docx", "LIE", 400)
    assert work_off() == {"A 1.docx": "Vos", "B 2.docx": "Lie"}
    put("A 1.docx", "LUND", 200)
    assert work_off() == {"A 1.docx": "Lund", "B 2.docx": "Lie"}
    known = store.current(spark, place, schema)
    assert ingest.snapshot_changes(spark, str(base), known, "2024-02-01").count() == 0
    (base / "B 2.docx").rename(tmp_path / "kept.docx")
    assert work_off() == {"A 1.docx": "Lund"}
    (tmp_path / "kept.docx").rename(base / "B 2.docx")
    put("C 3.docx", "MBOW", 500)
    changed = ingest.snapshot_changes(spark, str(base), store.current(spark, place, schema), "2024-02-01")
    assert {r.path for r in changed.collect()} == {"B 2.docx", "C 3.docx"}
    assert work_off() == {"A 1.docx": "Lund", "B 2.docx": "Lie", "C 3.docx": "Mbow"}


def test_changed_files_are_extracted(spark, tmp_path):
    base, place, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    base.mkdir()
    schema = store.with_payload("last_name string, body string, diagnostics " + diagnostics.SCHEMA)
    vitals = "VOS, Jan, Danish poet and first Head of the Sea Office 1920-1925, was born 2 May 1880"

    def work_off():
        stream = ingest.files_with_content(ingest.file_stream(spark, str(base)))
        write = store.upsert(place, schema, fill=ingest.extraction(PROFILE, FORMS))
        store.run_available(stream, write, mark)
        return {r.id: r for r in store.current(spark, place, schema).collect()}

    (base / "Vos-J 2020.docx").write_bytes(docx.write_docx([vitals, "", "His life"], {"p.png": b"x"}))
    (base / "Bad 2020.docx").write_bytes(b"broken")
    out = work_off()
    assert out["vos-j-2020"].last_name == "Vos" and out["vos-j-2020"].body == "<p>His life</p>"
    assert [d.code for d in out["bad-2020"].diagnostics] == ["document_unreadable"]
    (base / "Lie-T 2021.docx").write_bytes(docx.write_docx([vitals.replace("VOS", "LIE")]))
    out = work_off()
    assert {k: v.last_name for k, v in out.items()} == {"vos-j-2020": "Vos", "bad-2020": None, "lie-t-2021": "Lie"}


def rows(spark, data):
    return spark.createDataFrame(data, "id string, path string, digest string, deleted boolean, at int").withColumn("at", F.timestamp_seconds("at"))


def test_changes(spark, tmp_path):
    place = str(tmp_path / "s")
    write = store.upsert(place)
    write(rows(spark, [("a", "p", "1", False, 1), ("a", "p", "2", False, 2), ("b", "q", "1", False, 1)]), 0)
    assert {(r.id, r.digest) for r in store.current(spark, place).collect()} == {("a", "2"), ("b", "1")}
    # The same batch again, and a repeated delivery of known content: nothing changes.
    write(rows(spark, [("a", "p", "2", False, 2), ("b", "q", "1", False, 1)]), 0)
    write(rows(spark, [("b", "q", "1", False, 9)]), 1)
    assert spark.read.parquet(f"{place}/stream=main/batch=1").count() == 0
    # A path that leads to another id takes the old id out; a swap of two ids keeps both.
    write(rows(spark, [("c", "q", "1", False, 10)]), 2)
    assert table(spark, place) == {"a": "p", "c": "q"}
    write(rows(spark, [("c", "p", "3", False, 11), ("a", "q", "4", False, 11)]), 3)
    assert table(spark, place) == {"c": "p", "a": "q"}


def test_coalescing_of_a_burst(spark):
    at = [0, 100, 300, 700, 1500, 1800]
    events = spark.createDataFrame([("u", ms) for ms in at], "u string, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    got = ingest.bursts(events, "ts", "350 milliseconds", "u", watermark="1 hour").orderBy("started").collect()
    assert [r.events for r in got] == [3, 1, 2]


def test_two_streams_share_a_store(spark, tmp_path):
    """Add, delete, add again and add equal content again; batch numbers of one stream never touch the other's."""
    from prosopon.streaming import store

    place = str(tmp_path / "shared")
    arrive, remove = store.upsert(place), store.upsert(place, stream="deletions")

    def rows(*items):
        shaped = [(i, f"{i}.docx", d, d is None, at) for i, d, at in items]
        return spark.createDataFrame(shaped, "id string, path string, digest string, deleted boolean, at string").withColumn("at", F.col("at").cast("timestamp"))

    arrive(rows(("a", "1", "2024-01-01"), ("b", "1", "2024-01-01")), 0)
    remove(rows(("a", None, "2024-01-02")), 0)
    assert [r.id for r in store.current(spark, place).collect()] == ["b"]
    arrive(rows(("a", "1", "2024-01-03")), 1)
    remove(rows(("b", None, "2024-01-04")), 1)
    arrive(rows(("a", "1", "2024-01-05")), 2)
    arrive(rows(("a", "1", "2024-01-05")), 2)
    assert [(r.id, r.digest) for r in store.current(spark, place).collect()] == [("a", "1")]


def test_decisions_follow_the_latest_version(spark, tmp_path):
    """A, B, A are three decisions; redeliveries and late versions none; a stopped query goes on."""
    from prosopon.functions import fingerprints
    from prosopon.streaming import decide

    schema = "slug string, content_hash string, at timestamp"
    signature = fingerprints.state_hash(F.col("content_hash"), PROFILE.license, PROFILE.publication_type, PROFILE.render_version)
    state = spark.createDataFrame([("p", "A"), ("q", "A")], "slug string, content_hash string").select("slug", signature.alias("content_hash"))
    inbox, place, checkpoint = (str(tmp_path / n) for n in ("inbox", "place", "checkpoint"))
    deliveries = [
        [("n", "A", 1), ("p", "A", 1), ("q", "B", 1), ("n", "A", 1)],
        [("n", "B", 3), ("n", "A", 2), ("q", "A", 5), ("p", "A", 9)],
        [("n", "A", 4), ("n", "B", 2), ("q", "B", 4), ("p", "C", 8), ("p", "A", 9)],
    ]
    for rows in deliveries:
        spark.createDataFrame([(s, h, i) for s, h, i in rows], "slug string, content_hash string, at int").withColumn("at", F.timestamp_seconds("at")).write.mode("append").parquet(inbox)
        found = decide.decisions(spark.readStream.schema(schema).parquet(inbox), state, PROFILE)
        decide.write_available(spark, found, place, checkpoint)
    got = sorted((r.slug, r.second, r.content_hash, r.action) for r in decide.decided(spark, place).withColumn("second", F.unix_seconds("at")).collect())
    assert got == [("n", 1, "A", "create"), ("n", 3, "B", "newversion"), ("n", 4, "A", "newversion"), ("p", 1, "A", "skip"), ("q", 1, "B", "newversion"), ("q", 5, "A", "newversion")]


def test_bursts_open_at_the_end_come_out(spark, tmp_path):
    events = spark.createDataFrame([(u, s) for u in (1, 2) for s in (0, 10, 100, 5000)], "user_id long, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = ingest.finished_bursts(stream, "ts", "60 seconds", "user_id", watermark="1 hour", target=str(tmp_path / "t"), checkpoint=str(tmp_path / "c"))
    assert sorted((r.user_id, r.events) for r in got.collect()) == [(1, 1), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2)]


def test_a_folded_store_is_the_same_store(spark, tmp_path):
    """Random batches of two streams, with late times, moves between paths and deletions, folded in between or not; old tiers go, and a batch reads what it touches."""
    import random

    rng = random.Random(5)
    schema = store.with_payload("payload string")
    plain, folded = str(tmp_path / "plain"), str(tmp_path / "folded")
    for number in range(10):
        stream = "main" if number % 3 else "other"
        data = [(f"i{rng.randrange(30)}", f"p{rng.randrange(30)}", str(rng.randrange(5)), rng.random() < 0.2, rng.randrange(max(0, number * 10 - 25), number * 10 + 10)) for _ in range(rng.randrange(1, 12))]
        batch = rows(spark, data).withColumn("payload", F.concat("id", F.lit("!")))
        for place in (plain, folded):
            store.upsert(place, schema, stream)(batch, number)
        if number % 2:
            store.fold(spark, folded, schema, tiers=2)
        a, b = (sorted(map(tuple, store.current(spark, place, schema).collect())) for place in (plain, folded))
        assert a == b, number
    tiers, last = store._folded(spark, folded)
    assert len(tiers) <= 3 and last["main"] == 8 and sum(n.startswith("pointer=") for n in os.listdir(folded)) == 2
    known = store.current(spark, folded, buckets=[3, 5])
    read = known._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in read.split("\n") if "FileScan" in line and "bucket" in line]
    assert "payload" not in read and len(scans) >= 1 and all("PartitionFilters: [bucket#" in x and "IN (3,5)" in x for x in scans)


def test_refreshed_files_follow_edits_and_deletions(spark, tmp_path, monkeypatch):
    """Documents of several rows, edits of all of them, deletions of what is not there; files are written and deleted by tasks, in few folders."""
    import hashlib

    from prosopon.plans import corpus as plans

    docs = [(n, f"text {n}") for n in range(-2, 500)] + [(4, "again"), (5, "text 5"), (6, "more")]
    labels = [(4, 0, 0), (4, 0, 0), (5, 1, 1), (6, 1, 0), (7, 0, 1), (9, 0, None), (10, None, 1), (9999, 0, 1), (None, 0, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(plans, "new_folder", lambda spark, label: str(tmp_path / label))
    got = sorted((r.doc_id, r.digest) for r in plans.refreshed_files(spark, str(tmp_path)).collect())
    edited, gone = {i for i, q, _ in labels if q == 0}, {i for i, _, x in labels if x == 1}
    kept = [(i, f"{s}{'!' if i in edited else ''}\n") for i, s in docs if i not in gone]
    assert got == sorted((i, hashlib.sha256(s.encode()).hexdigest()) for i, s in kept)
    assert len(list((tmp_path / "followed").iterdir())) <= 256


def test_refreshed_files_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    """Neither for the comparison nor to open them; of files as new as one that differs, only those that differ are opened."""
    from pyspark.sql.readwriter import DataFrameReader

    from prosopon.plans import corpus as plans

    spark.createDataFrame([(n, f"text {n}") for n in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 0, 0), (5, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    formats, ask = [], DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda reader, source: formats.append(source) or ask(reader, source))
    assert {r.doc_id for r in plans.refreshed_files(spark, str(tmp_path)).collect()} == set(range(300)) - {5, 6}
    assert "binaryFile" not in formats

    base, place, schema = tmp_path / "in", str(tmp_path / "store"), store.with_payload(ingest.FILE_FACTS)
    base.mkdir()
    for name in ("old.txt", "new.txt"):
        (base / name).write_text(name)
    ingest.refresh(spark, str(base), place, schema, "2024-01-01", 0, pattern="*.txt")
    os.utime(base / "old.txt", (time.time() - 1000,) * 2)
    changed = ingest.snapshot_changes(spark, str(base), store.current(spark, place, schema), "2024-01-02", "*.txt")
    (base / "new.txt").unlink()
    assert [(r.path, bytes(r.content)) for r in changed.collect()] == [("old.txt", b"old.txt")]
