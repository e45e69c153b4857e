"""Citation lists, authors, version labels, publication dates, image credits and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions import text as t

S = t.WS
# Fixed patterns.
ACCESSED = rf"(?i)\({S}*all{S}+websites{S}+accessed{S}+([^)]+)\){S}*\.?{S}*\z"
ITEM_END = rf";(?:{S}+|\z)"
QUOTED_TITLE_TAIL = rf"[‘'][^‘]*[’']{S}*\z"
DAY_MONTH_YEAR = rf"(\d{{1,2}}){S}+([A-Za-z]+){S}+(\d{{4}})"
URL = r"(?i)(https?://" + S.replace("[", "[^") + r"+|www\." + S.replace("[", "[^") + r"+)"
CREDIT_LINE = rf"^{S}*\*{S}+(.+?){S}+:muted\[\((.*)\)\]{S}*\z"
FILE_LINK = r"(?i)\[([^\]]+)\]\((\S+\.(?:pdf|docx?|xlsx?|pptx?|csv|zip|txt))\)"

# Fixed values.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]


def accessed_on(raw: Column) -> Column:
    """The date inside a trailing "(all websites accessed ...)" note, else NULL."""
    return t.empty_to_null(t.strip(F.regexp_extract(t.strip(raw), ACCESSED, 1)))


def citation_items(raw: Column) -> Column:
    """Items between semicolons that are followed by space or end; closing `.,;` trimmed, empties dropped."""
    body = F.regexp_replace(t.strip(raw), ACCESSED, "")
    pieces = F.transform(
        F.split(t.strip(body), ITEM_END),
        lambda s: t.strip(F.regexp_replace(t.strip(s), r"[.,;]+\z", "")),
    )
    return F.filter(pieces, lambda s: s != "")


def citation_list(raw: Column) -> Column:
    """struct(items array<struct<raw>>, websites_accessed_on)."""
    return t.bind(
        t.or_empty(raw),
        lambda r: F.struct(
            F.transform(citation_items(r), lambda s: F.struct(s.alias("raw"))).alias("items"),
            accessed_on(r).alias("websites_accessed_on"),
        ),
    )


def presentation(items: Column) -> Column:
    """One item reads as prose, several as a list."""
    return F.when(F.size(items) == 1, "prose").when(F.size(items) > 1, "list")


def citation_authors(text: Column, marker: str) -> Column:
    """What precedes the marker, without the quoted entry title; NULL when nothing is left."""
    before = F.substring_index(text, marker, 1)
    bare = F.regexp_replace(F.regexp_replace(before, QUOTED_TITLE_TAIL, ""), rf"(?:,|{S})+\z", "")
    return t.empty_to_null(t.strip(bare))


def author_list(authors: Column, fallback: str) -> Column:
    """Authors split on " and " / "&" only, never on commas; the dictionary itself when there are none."""

    def names(raw: Column) -> Column:
        parts = F.transform(F.split(raw, rf"(?i){S}+and{S}+|{S}*&{S}*"), t.strip)
        return t.bind(
            F.filter(parts, lambda s: s != ""), lambda found: F.when(F.size(found) == 0, F.array(raw)).otherwise(found)
        )

    return t.bind(
        t.strip(t.or_empty(authors)),
        lambda raw: F.when(raw == "", F.array(F.lit(fallback))).otherwise(names(raw)),
    )


def version_label(version: Column) -> Column:
    return t.strip(F.regexp_replace(t.or_empty(version), rf"(?i)^Version{S}+", ""))


def publication_date(version: Column) -> Column:
    """ISO date text from "DD Month YYYY", else first of January of a lone year, else NULL.

    The text is not checked against the calendar ("31 February" stays); use try_to_date for a checked value.
    """

    def iso(label: Column) -> Column:
        day, month, year = (F.regexp_extract(label, DAY_MONTH_YEAR, i) for i in (1, 2, 3))
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month))
        lone_year = F.regexp_extract(label, rf"{t.WORD_START}(\d{{4}}){t.WORD_END}", 1)
        return F.when(
            number > 0,
            F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")),
        ).when(lone_year != "", F.concat(lone_year, F.lit("-01-01")))

    return t.bind(version_label(version), iso)


def checked_date(version: Column) -> Column:
    return F.try_to_date(publication_date(version), "yyyy-MM-dd")


def image_credit(source: Column) -> Column:
    """struct(text, href, label): the credit before its first URL, the URL made absolute, and its host."""
    none = F.lit(None).cast("string")

    def parts(credit: Column) -> Column:
        found, raw = credit["found"], credit["raw"]
        href = F.when(F.startswith(raw, F.lit("http")), raw).otherwise(F.concat(F.lit("https://"), raw))
        host = F.regexp_replace(F.lower(F.try_parse_url(href, F.lit("HOST"))), r"^www\.", "")
        lead = F.substring(credit["source"], F.lit(1), F.instr(credit["source"], found) - 1)
        return F.when(
            found == "", F.struct(credit["source"].alias("text"), none.alias("href"), none.alias("label"))
        ).otherwise(
            F.struct(
                t.strip(F.regexp_replace(lead, rf"(?:{S}|[/–—-])+\z", "")).alias("text"),
                href.alias("href"),
                F.coalesce(host, raw).alias("label"),
            )
        )

    def located(source: Column) -> Column:
        found = F.regexp_extract(source, URL, 1)
        return F.struct(
            source.alias("source"), found.alias("found"), F.regexp_replace(found, r"[).,;]+\z", "").alias("raw")
        )

    return t.bind(t.bind(t.or_empty(source), located), parts)


def credit_line(line: Column) -> Column:
    """struct(name, entries array<string>) of a `* Name :muted[(A, B)]` line, NULL for other lines."""
    entries = F.filter(
        F.transform(F.split(t.strip(F.regexp_extract(line, CREDIT_LINE, 2)), ","), t.strip), lambda s: s != ""
    )
    return F.when(
        line.rlike(CREDIT_LINE),
        F.struct(t.strip(F.regexp_extract(line, CREDIT_LINE, 1)).alias("name"), entries.alias("entries")),
    )


def file_links(markdown: Column) -> Column:
    """array<struct<text,file>> of Markdown links that point at downloadable files."""
    return F.transform(
        F.regexp_extract_all(markdown, F.lit(FILE_LINK), F.lit(0)),
        lambda m: F.struct(
            F.regexp_extract(m, FILE_LINK, 1).alias("text"), F.regexp_extract(m, FILE_LINK, 2).alias("file")
        ),
    )


def http_verdict(status: Column) -> Column:
    """404, OK (2xx and 3xx) or NULL when the answer settles nothing."""
    return F.when(status == 404, "404").when(status.between(200, 399), "OK")


def how_to_cite(authors: Column, last: Column, first: Column, url: Column, sandbox: Column, title: str, edited_by: str) -> Column:
    """The citation sentence, NULL for an entry without a deposit."""
    return F.when(
        url.isNotNull(),
        F.concat(
            t.or_empty(authors), F.lit(", '"), t.or_empty(last), F.lit(", "), t.or_empty(first),
            F.lit(f"' in {title}, edited by {edited_by}. "), url,
            F.when(sandbox, F.lit(" (sandbox preview)")).otherwise(F.lit("")),
        ),
    )
