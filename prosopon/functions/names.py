"""Names: vitals line, casing, aliases and the display forms built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions import text as t

# Fixed patterns of the vitals line "LAST, First (alias), summary, was born ...".
NAME = r"(?i)^([^,]+)," + t.WS + r"*([^(,]+?)" + t.WS + r"*(?:\(([^)]*)\)" + t.WS + r"*)?,"
NEE = r"(?iu)^n[eé]e" + t.WS + r"+(.+)\z"
KNOWN_AS = r"(?i)^(?:known as|called)" + t.WS + r"+(.+)\z"
SUMMARY = r"(?i)^[^,]+," + t.WS + r"*[^,]+," + t.WS + r"*(.+?)" + t.WS + r"*," + t.WS + r"*was born"
LIFE = r"(?i)(was.+)\z"

# Family-name particles that stay in lower case before another word.
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "do", "dos", "das", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "y"]


def surname_case(c: Column) -> Column:
    """`VAN DER BERG-O’NEIL` → `van der Berg-O’Neil`; a particle keeps lower case unless it ends the name."""

    def cased(tokens: Column) -> Column:
        last = F.size(tokens) - 1
        return F.transform(
            tokens,
            lambda token, i: F.when(token.isin(PARTICLES) & (i < last), token)
            .when(
                token.rlike(r"^mc\p{L}"),
                F.concat(F.lit("Mc"), F.upper(F.substring(token, 3, 1)), F.substring(token, 4, 1 << 30)),
            )
            .otherwise(t.capitalise_first(token)),
        )

    return F.array_join(t.bind(F.regexp_extract_all(F.lower(c), F.lit(r"[^\s\-'’]+|[\s\-'’]+"), F.lit(0)), cased), "")


def parse_name(intro: Column) -> Column:
    """struct(last_name, first_name, known_as, nee), NULL when the line has no name."""

    def fields(line: Column) -> Column:
        last = t.strip(t.squash(F.regexp_replace(F.regexp_extract(line, NAME, 1), r"[\[\]]", " ")))
        paren = t.strip(F.regexp_extract(line, NAME, 3))
        return F.struct(
            surname_case(last).alias("last_name"),
            t.strip(F.regexp_extract(line, NAME, 2)).alias("first_name"),
            t.bind(paren, _known_as).alias("known_as"),
            F.when(paren.rlike(NEE), t.strip(F.regexp_extract(paren, NEE, 1))).alias("nee"),
        )

    return t.bind(intro, lambda line: F.when(line.rlike(NAME), fields(line)))


def _known_as(paren: Column) -> Column:
    return (
        F.when((paren == "") | paren.rlike(NEE), None)
        .when(paren.rlike(KNOWN_AS), t.strip(F.regexp_extract(paren, KNOWN_AS, 1)))
        .otherwise(paren)
    )


def summary(intro: Column) -> Column:
    return t.strip(t.extract(intro, SUMMARY))


def life(intro: Column) -> Column:
    return t.bind(
        t.strip(t.extract(intro, LIFE)),
        lambda sentence: F.when(F.length(sentence) > 1, t.capitalise_first(sentence)).otherwise(sentence),
    )


def alias_suffix(known_as: Column, name: Column, nee: Column) -> Column:
    """` (alias)` / ` (née alias)` / empty; known-as beats née, and an alias already in the name is dropped."""
    haystack = F.concat(F.lit(" "), t.strip(t.squash(F.lower(t.or_empty(name)))), F.lit(" "))
    known, maiden = t.strip(t.or_empty(known_as)), t.strip(t.or_empty(nee))

    def shown(alias: Column, prefix: str) -> Column:
        word = F.concat(F.lit(" "), t.squash(F.lower(alias)), F.lit(" "))
        return F.when(F.contains(haystack, word), F.lit("")).otherwise(F.concat(F.lit(f" ({prefix}"), alias, F.lit(")")))

    maiden_part = t.bind(maiden, lambda m: F.when(m == "", F.lit("")).otherwise(shown(m, "née ")))
    return t.bind(known, lambda k: F.when(k == "", maiden_part).otherwise(shown(k, "")))


def full_name(first: Column, last: Column) -> Column:
    return F.concat(t.or_empty(first), F.lit(" "), t.or_empty(last))


def listing_name(first: Column, last: Column, known_as: Column, nee: Column) -> Column:
    """`LAST First (alias)`."""
    return _with_alias(
        lambda given, family: F.concat(F.upper(family), F.lit(" "), given), first, last, known_as, nee
    )


def _with_alias(shape, first: Column, last: Column, known_as: Column, nee: Column) -> Column:
    """A name form followed by the alias suffix, each input mentioned once."""
    parts = F.struct(
        t.or_empty(first).alias("first"), t.or_empty(last).alias("last"), known_as.alias("known_as"), nee.alias("nee")
    )
    return t.bind(
        parts,
        lambda n: F.concat(
            shape(n["first"], n["last"]), alias_suffix(n["known_as"], full_name(n["first"], n["last"]), n["nee"])
        ),
    )


def entry_title(first: Column, last: Column) -> Column:
    """`LAST, First`."""
    return F.concat(F.upper(t.or_empty(last)), F.lit(", "), t.or_empty(first))


def display_name(first: Column, last: Column, known_as: Column, nee: Column) -> Column:
    return _with_alias(entry_title, first, last, known_as, nee)


def deposit_title(first: Column, last: Column) -> Column:
    """Entry title without a dangling comma when the given name is missing."""
    return t.strip(F.regexp_replace(entry_title(first, last), "," + t.WS + r"*\z", ""))
