"""Roles: a summary sentence split into office holdings, all in Column expressions.

The text is cut behind each year token, then every piece is refined by one `transform` per step, so that no
step's regexes run twice and no shuffle or explode is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions import text as t

# Words that introduce an office.
ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "former",
]

# Offices that are institutions themselves (title pattern, organisation, abbreviation).
INSTITUTION_TITLES = [
    ("High Commissioner for Refugees", "Office of the United Nations High Commissioner for Refugees", "UNHCR"),
    ("High Commissioner for Human Rights", "Office of the United Nations High Commissioner for Human Rights", "OHCHR"),
]

S = t.WS
# Fixed patterns: a year range ends a role anywhere; a single year only before a separator or the end.
RANGE = rf"\d{{4}}{S}*[-–]{S}*\d{{4}}"
MONTHS_YEAR = rf"[A-Z][a-z]+{S}*[-–]{S}*[A-Z][a-z]+{S}+\d{{4}}"
ROLE_END = rf"(?:{RANGE}|(?:in{S}+\d{{4}}|{MONTHS_YEAR}|\d{{4}})(?={S}+and{S}+|,{S}+|{S}*\z))"
CONNECTOR = rf"(?i)^{S}*(?:and|,|;){S}+"
LAST_ORDINAL = rf"(?is)^.*{t.WORD_START}(?=[{''.join(sorted({o[0] for o in ORDINALS}))}])({'|'.join(ORDINALS)}){t.WORD_END}"
OF_TO = rf"{S}+(?:of|to){S}+"
ABBREVIATION = rf"{S}*\(((?=(?:[^()]*[A-Z]){{2}})[A-Za-z]+(?:{S}+[A-Za-z]+)*)\)"
YEARS, MARK = "\u0002", "\u0001"


def role_pieces(summary: Column) -> Column:
    """Text up to and including each year token, the token set off by a mark; the rest is dropped."""
    unmarked = F.translate(summary, YEARS + MARK, "")
    pieces = F.split(F.regexp_replace(unmarked, ROLE_END, f"{YEARS}$0{MARK}"), MARK)
    return t.bind(
        pieces,
        lambda found: F.transform(
            F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))),
            lambda piece, i: F.when(i == 0, piece).otherwise(F.regexp_replace(piece, CONNECTOR, "")),
        ),
    )


def office_text(piece: Column) -> Column:
    """What precedes the year token, without an opening parenthesis, stray punctuation and a leading connector."""
    before = t.rstrip(F.substring_index(piece, YEARS, 1))
    bare = F.rtrim(t.rstrip(F.regexp_replace(before, r"\(\z", "")), F.lit(",;"))
    return t.strip(F.regexp_replace(F.ltrim(t.rstrip(bare), F.lit(t.SPACE_CHARS + ",;()")), rf"(?i)^(?:and|or){S}+", ""))


def year_digits(piece: Column) -> Column:
    """The four or eight digits of the year token."""
    return F.regexp_replace(F.substring_index(piece, YEARS, -1), "[^0-9]", "")


def skip_preamble(office: Column) -> Column:
    """Without an ordinal the office starts behind the last separator that precedes ` of ` / ` to `."""
    head = F.element_at(F.split(office, OF_TO, 2), 1)
    skipped = F.length(F.regexp_extract(head, rf"^.*(?:{S}+and{S}+|,{S}+)", 0))
    return t.lstrip(F.substring(office, skipped + 1, F.length(office)))


def ordinal_and_rest(office: Column) -> Column:
    """[ordinal, rest] around the last ordinal, or [office] without one."""
    return F.split(F.regexp_replace(office, LAST_ORDINAL, f"$1{MARK}"), MARK)


def pull_abbreviation(name: Column) -> Column:
    """struct(name, abbr): first parenthesised letters-only token with two capitals, taken out of the name."""
    plain = F.struct(name.alias("name"), F.lit(None).cast("string").alias("abbr"))

    def pulled(halves: Column) -> Column:
        without = F.array_join(halves, "")
        tidy = t.strip(F.regexp_replace(F.regexp_replace(without, rf"{S}{{2,}}", " "), rf"{S}+([,;.])", "$1"))
        return F.when(F.size(halves) < 2, plain).otherwise(
            F.struct(tidy.alias("name"), F.regexp_extract(name, ABBREVIATION, 1).alias("abbr"))
        )

    return F.when(~F.contains(name, F.lit("(")), plain).otherwise(t.bind(F.split(name, ABBREVIATION, 2), pulled))


def institution_of(title: Column, field: int) -> Column:
    """Organisation (1) or abbreviation (2) for titles that double as the institution, else NULL."""
    result = F.lit(None).cast("string")
    for row in reversed(INSTITUTION_TITLES):
        pattern = rf"(?i){t.WORD_START}{row[0].replace(' ', S + '+')}{t.WORD_END}"
        result = F.when(title.rlike(pattern), F.lit(row[field])).otherwise(result)
    return result


def parse_roles(summary: Column) -> Column:
    """array<struct<ordinal_text,title,organisation,abbreviation,start_year,end_year>>, in text order."""
    pieces = F.transform(
        role_pieces(summary),
        lambda p: F.struct(ordinal_and_rest(office_text(p)).alias("office"), year_digits(p).alias("digits")),
    )
    offices = F.transform(
        pieces,
        lambda x: F.struct(
            F.split(
                F.when(F.size(x["office"]) > 1, t.lstrip(x["office"][1])).otherwise(skip_preamble(x["office"][0])),
                rf"{OF_TO}(?:the{S}+)?",
                2,
            ).alias("halves"),
            F.when(F.size(x["office"]) > 1, F.lower(x["office"][0])).alias("ordinal"),
            F.left(x["digits"], F.lit(4)).cast("int").alias("start"),
            F.right(x["digits"], F.lit(4)).cast("int").alias("end"),
        ),
    )
    named = F.transform(
        offices,
        lambda x: F.struct(
            x["halves"].alias("halves"),
            pull_abbreviation(t.strip(F.element_at(x["halves"], -1))).alias("pulled"),
            x["ordinal"].alias("ordinal"),
            x["start"].alias("start"),
            x["end"].alias("end"),
        ),
    )
    parts = F.transform(
        named,
        lambda x: F.struct(
            x["ordinal"].alias("ordinal_text"),
            F.when(F.size(x["halves"]) > 1, t.strip(F.element_at(x["halves"], 1)))
            .otherwise(t.strip(x["pulled"]["name"]))
            .alias("title"),
            F.when(F.size(x["halves"]) > 1, t.empty_to_null(x["pulled"]["name"])).alias("organisation"),
            x["pulled"]["abbr"].alias("abbreviation"),
            x["start"].alias("start_year"),
            x["end"].alias("end_year"),
        ),
    )
    held = F.filter(parts, lambda x: x["title"] != "")
    return F.transform(
        held,
        lambda x: F.struct(
            x["ordinal_text"].alias("ordinal_text"),
            x["title"].alias("title"),
            F.coalesce(x["organisation"], institution_of(x["title"], 1)).alias("organisation"),
            F.coalesce(
                x["abbreviation"], F.when(x["organisation"].isNull(), institution_of(x["title"], 2))
            ).alias("abbreviation"),
            x["start_year"].alias("start_year"),
            x["end_year"].alias("end_year"),
        ),
    )


def organisation_label(role: Column) -> Column:
    """`Full (ABBR)`, or whichever is there, or empty."""
    org, abbr = role["organisation"], role["abbreviation"]
    has_both = (t.or_empty(org) != "") & (t.or_empty(abbr) != "")
    return F.when(has_both, F.concat(org, F.lit(" ("), abbr, F.lit(")"))).otherwise(F.coalesce(org, abbr, F.lit("")))


def years_label(role: Column) -> Column:
    start, end = role["start_year"], role["end_year"]
    return F.when(start.isNull() & end.isNull(), F.lit("")).otherwise(
        F.concat(t.or_empty(start.cast("string")), F.lit("–"), t.or_empty(end.cast("string")))
    )
