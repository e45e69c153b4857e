"""Rank ladder of the listing search, as one CASE expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions.text import bind, fold_accents


def _subsequence(letters: str) -> str:
    """The letters in order with anything between: one pass from the start, without backtracking."""
    return "(?s)^" + "".join(f"[^{_in_class(c)}]*+{re.escape(c)}" for c in letters)


def _in_class(char: str) -> str:
    return "\\" + char if char in r"\^-[]&" else char


def fold_query(query: str) -> str:
    import unicodedata

    decomposed = unicodedata.normalize("NFKD", query)
    # Fixed values, as in `text._accent_table`.
    stroked = str.maketrans("øØđĐłŁ", "oOdDlL")
    return "".join(c for c in decomposed if unicodedata.category(c) != "Mn").translate(stroked)


def acronym(lowered: Column) -> Column:
    """First letters of the words, a hyphen starting a word too."""
    return F.regexp_replace(lowered, r"([^ \-])[^ \-]*[ \-]*", "$1")


def rank(value: Column, query: str) -> Column:
    """7 same, 6 same but for case, 5 starts with, 4 a word starts with, 3 contains, 2 acronym contains,
    1 letters in order, 0 none. Accents never matter; a blank query ranks every value."""
    asked = fold_query(query)
    lowered = asked.lower()

    def ladder(v: Column) -> Column:
        plain, low = v["plain"], v["low"]
        steps = (
            F.when(plain == asked, 7)
            .when(low == lowered, 6)
            .when(F.startswith(low, F.lit(lowered)), 5)
            .when(F.contains(low, F.lit(" " + lowered)), 4)
            .when(F.contains(low, F.lit(lowered)), 3)
        )
        if len(lowered) > 1:
            steps = steps.when(F.contains(acronym(low), F.lit(lowered)), 2).when(low.rlike(_subsequence(lowered)), 1)
        return steps.otherwise(0)

    folded = fold_accents(F.coalesce(value, F.lit("")))
    return bind(bind(folded, lambda p: F.struct(p.alias("plain"), F.lower(p).alias("low"))), ladder)


def folded(value: Column) -> Column:
    """struct(plain, low): a value without accents, as it is and in lower case; null is empty."""
    return bind(fold_accents(F.coalesce(value, F.lit(""))), lambda p: F.struct(p.alias("plain"), F.lower(p).alias("low")))


def rank_of(value: Column, query: Column) -> Column:
    """The ladder of `rank` for two columns as `folded` makes them."""

    def in_order(low: Column, letters: Column) -> Column:
        def step(at: Column, letter: Column) -> Column:
            found = F.call_function("locate", letter, low, at + 1)
            return F.when((at < 0) | (found == 0), -1).otherwise(found)

        return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), step) > 0

    low, asked = value["low"], query["low"]
    steps = (
        F.when(value["plain"] == query["plain"], 7)
        .when(low == asked, 6)
        .when(F.startswith(low, asked), 5)
        .when(F.contains(low, F.concat(F.lit(" "), asked)), 4)
        .when(F.contains(low, asked), 3)
        .when((F.length(asked) > 1) & F.contains(acronym(low), asked), 2)
    )
    return steps.when((F.length(asked) > 1) & in_order(low, asked), 1).otherwise(0)


def contains_ignoring_case(value: Column, query: str) -> Column:
    return F.contains(F.lower(F.coalesce(value, F.lit(""))), F.lit(query.lower()))
