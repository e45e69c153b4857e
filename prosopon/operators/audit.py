"""Corpus-wide reports over extracted tables; every aggregate combines before the shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prosopon.functions import diagnostics

PROSE_LENGTH = 150
SEVERITIES = ("error", "warn", "info")
LINK_STATES = {"ok": "OK", "not_found": "404", "error": "ERROR", "no_link": "no link"}


def severity_totals(found: DataFrame) -> DataFrame:
    """Counts per document and severity, with a total row per severity (document NULL)."""
    return found.rollup("severity", "doc_id").agg(F.count("*").alias("n")).where(F.col("severity").isNotNull())


def warning_tally(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "field", "severity").agg(F.count("*").alias("n"))


def observed(bios: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(`bios` to write, its `warning_tally`): every code is counted in the pass that writes the table, so the tally costs no second scan.

    The tally is there once the returned table has been written or collected, by one action.
    """
    seen = Observation()

    def count(code: str) -> Column:
        return F.sum(F.size(F.filter("diagnostics", lambda d: d["code"] == code))).alias(code)

    watched = bios.observe(seen, *map(count, diagnostics.CODES))

    def tally() -> DataFrame:
        rows = [(code, *diagnostics.CODES[code][:2], n) for code, n in seen.get.items() if n]
        return bios.sparkSession.createDataFrame(rows, "code string, field string, severity string, n bigint")

    return watched, tally


def link_tally(audit: DataFrame) -> DataFrame:
    return audit.agg(*[F.count_if(F.col("status") == s).alias(name) for name, s in LINK_STATES.items()])


def prose_lists(citations: DataFrame) -> DataFrame:
    """Sections that look like prose split by mistake: two items or more, long on average."""
    sections = citations.groupBy("doc_id", "section").agg(F.count("*").alias("items"), F.avg(F.length("raw")).alias("mean_length"))
    return sections.where((F.col("items") >= 2) & (F.col("mean_length") > PROSE_LENGTH))


def contributor_productivity(credits: DataFrame) -> DataFrame:
    """Entries per contributor: attributions and distinct entries."""
    return credits.groupBy("name").agg(F.count("*").alias("attributions"), F.countDistinct("entry").alias("entries"))


def contributors_per_entry(credits: DataFrame) -> DataFrame:
    return credits.groupBy("entry").agg(F.countDistinct("name").alias("contributors"))


def document_files(files: DataFrame, name: Column) -> DataFrame:
    """Word files in any letter case, without the editor's lock files."""
    return files.where(F.endswith(F.lower(name), F.lit(".docx")) & ~F.startswith(name, F.lit("~$")))
