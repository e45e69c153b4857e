"""Diagnostics as an array column beside the extracted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, fields and severities. The sentences are our own.
CODES = {
    "image_source_missing": ("imageSource", "warn", "the document credits no source for its image"),
    "image_attachment_missing": ("imageAttachment", "warn", "the document brings no usable image"),
    "intro_missing": ("intro", "error", "there is no opening paragraph to read"),
    "name_unparsed": ("name", "error", "the opening paragraph does not start with a surname in capitals and a first name"),
    "summary_unparsed": ("summary", "error", "no summary of roles stands between the name and the life"),
    "life_unparsed": ("life", "warn", "no sentence on the person's life follows the summary"),
    "roles_missing_input": ("roles", "warn", "there is no summary to take roles from"),
    "roles_no_year_span": ("roles", "warn", "the summary has no years by which roles could be told apart"),
    "role_unparsed": ("role", "warn", "the summary has years, yet no role could be read"),
    "nationality_missing_input": ("nationality", "warn", "there is no text to look for a nationality in"),
    "nationality_unknown": ("nationality", "warn", "no known nationality occurs in the text"),
    "version_missing": ("version", "warn", "the document does not state its version"),
    "citation_missing": ("authors", "warn", "the document does not say how to cite it"),
    "apl_archives_missing": ("archives", "info", "the list of archives is missing"),
    "apl_publications_missing": ("publications", "info", "the list of publications is missing"),
    "apl_literature_missing": ("literature", "warn", "the list of literature is missing"),
    "document_unreadable": ("document", "error", "the file cannot be read as a document"),
    "publication_date_defaulted": ("version", "warn", "the version has no date; the day of the run stands in for it"),
    "title_empty": ("title", "error", "the entry has no title"),
    "artifact_missing": ("artifact", "error", "the rendered file is not there"),
}

SCHEMA = "array<struct<code:string,field:string,message:string,severity:string>>"


def report(code: str, condition: Column) -> Column:
    """One diagnostic when the condition holds, else NULL."""
    field, severity, message = CODES[code]
    row = F.struct(
        F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(severity).alias("severity")
    )
    return F.when(condition, row)


def collect(*reports: Column) -> Column:
    return F.filter(F.array(*reports), lambda d: d.isNotNull()).cast(SCHEMA)


def errors(diagnostics: Column) -> Column:
    return F.filter(diagnostics, lambda d: d["severity"] == "error")


def buckets(diagnostics: Column) -> Column:
    """struct(error, warn, info) counts."""

    def count(severity: str) -> Column:
        return F.size(F.filter(diagnostics, lambda d: d["severity"] == severity)).alias(severity)

    return F.struct(count("error"), count("warn"), count("info"))
