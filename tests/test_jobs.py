"""The jobs end to end on files in a folder."""

import pytest
from pyspark.sql import functions as F

from prosopon import jobs
from prosopon.plans.synth import FORMS, PROFILE
from prosopon.sources import docx, schemas

TODAY = "2024-01-01"


def write(base, name, lines):
    (base / name).parent.mkdir(exist_ok=True, parents=True)
    (base / name).write_bytes(docx.write_docx(lines, {"p.png": b"x"}))


def test_from_files_to_state(spark, tmp_path):
    base = tmp_path / "in"
    vitals = "{}, Jan, Danish poet and first Head of the Sea Office (SO) 1920-1925, was born 2 May 1880"
    write(base, "Vos-J 2020.docx", [vitals.format("VOS"), "", "Source: X https://a.example/p", "", "Life", "Version 1 May 2020"])
    write(base, "Lie-T 2021.docx", [vitals.format("LIE"), "", "Source: museum"])
    write(base, "lie-t-2021.docx", [vitals.format("LIEN")])
    write(base, "~$Lie-T 2021.docx", ["lock"])
    built = jobs.build_corpus(spark, str(base), str(tmp_path / "store"), PROFILE, FORMS)
    assert {(r.doc_id, r.last_name, r.title) for r in built.entries.collect()} == {("vos-j-2020", "Vos", "Vos-J 2020"), ("lie-t-2021", "Lien", "lie-t-2021")}
    assert [(r.doc_id, r.copies) for r in built.duplicates.collect()] == [("lie-t-2021", 2)] and built.warnings == []

    feed, state = str(tmp_path / "feed"), str(tmp_path / "state")
    jobs.write_feed(built.entries, feed)
    plan = jobs.plan_versions(spark, feed, state, PROFILE, TODAY)
    assert plan.tally.first().asDict() == {"create": 2, "newversion": 0, "skip": 0}
    assert {(r.slug, r.title, r.date, len(r.diagnostics)) for r in plan.report.collect()} == {("vos-j-2020", "VOS, Jan", "2020-05-01", 0), ("lie-t-2021", "LIEN, Jan", TODAY, 1)}

    outcomes = plan.rows.select(
        "slug", (F.col("slug") == "vos-j-2020").alias("ok"), F.lit(1).cast("long").alias("record_id"), F.lit(2).cast("long").alias("concept_rec_id"),
        F.lit("10.5072/c").alias("concept_doi"), F.lit("10.5072/v").alias("version_doi"), F.col("state_hash").alias("content_hash"),
        F.lit("1 May 2020").alias("version"), F.lit("2024-01-01").cast("timestamp").alias("minted_at"), F.lit(None).cast("string").alias("error"),
    )
    assert jobs.record_outcomes(spark, outcomes, state, "sandbox", 1).first().asDict() == {"succeeded": 1, "failed": 1, "exit_status": 1}
    again = jobs.plan_versions(spark, feed, state, PROFILE, TODAY)
    assert {(r.slug, r.action) for r in again.rows.collect()} == {("vos-j-2020", "skip"), ("lie-t-2021", "create")}
    assert jobs.plan_versions(spark, feed, state, PROFILE, TODAY, env="production", confirmed=True).tally.first()["create"] == 2
    with pytest.raises(PermissionError):
        jobs.plan_versions(spark, feed, state, PROFILE, TODAY, env="production")

    probes = spark.createDataFrame([("https://a.example/p", "HEAD", 404, False)], schemas.LINK_STATUS)
    tally = jobs.audit_images(built.entries, probes, str(tmp_path / "csv")).first().asDict()
    assert tally == {"ok": 0, "not_found": 1, "error": 0, "no_link": 1}
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))).decode()
    assert text.startswith('﻿"entry","full text","link","status"\r\n') and '"Vos-J 2020","X https://a.example/p","https://a.example/p","404"\r\n' in text
