"""Nationality by dictionary: the demonym that appears first wins, the longest one at equal position.

For a list of forms that is part of the program, a longest-first alternation finds exactly that in one pass over the text, and the country follows
from a literal map. A dictionary table of any size is joined instead (`operators.enrich.with_origin`).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions import text as t


def alternation(words: Sequence[str]) -> str:
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    heads = "".join(sorted({re.escape(w[0]) for w in ordered}))
    return f"(?=[{heads}])(?:{'|'.join(re.escape(w) for w in ordered)})"


def nationality(text: Column, forms: Sequence[tuple[str, str]]) -> Column:
    """struct(nationality as written, country); both NULL when no demonym occurs."""
    countries: dict[str, str] = {}
    for demonym, country in forms:
        countries.setdefault(demonym, country)
    if not countries:
        return F.struct(F.lit(None).cast("string").alias("nationality"), F.lit(None).cast("string").alias("country"))
    lookup = F.create_map(*[F.lit(x) for pair in countries.items() for x in pair])
    matched = t.bind(text, lambda s: F.struct(s.alias("text"), F.regexp_extract(s, alternation(list(countries)), 0).alias("found")))
    return t.bind(
        matched,
        lambda m: F.struct(
            as_written(m["text"], m["found"]).alias("nationality"),
            F.when(m["found"] != "", F.element_at(lookup, m["found"])).alias("country"),
        ),
    )


def as_written(text: Column, demonym: Column) -> Column:
    """The demonym extended over the letters that follow it, if it starts a word."""
    at = F.instr(text, demonym)
    inside_word = (at > 1) & F.substring(text, at - 1, F.lit(1)).rlike("[A-Za-z]")
    tail = F.regexp_extract(F.substring(text, at + F.length(demonym), F.length(text)), "^[A-Za-z]*", 0)
    return F.when(demonym == "", None).when(inside_word, demonym).otherwise(F.concat(demonym, tail))
