"""Small text building blocks as Column expressions.

Whitespace is the set a web runtime trims: it includes the no-break space and the byte-order mark, which
plain Java ``\\s`` and SQL ``trim`` miss. Word boundaries are spelled out over ASCII for the same reason.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CHARS = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it.

    Catalyst copies an expression to every place that mentions it when it moves a filter below a projection;
    a lambda variable keeps such copies from multiplying.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def has_text(c: Column) -> Column:
    """Whether anything but whitespace is there; stops at the first such character."""
    return F.coalesce(c.rlike(WS.replace("[", "[^", 1)), F.lit(False))


def squash(c: Column) -> Column:
    """Runs of whitespace become one space."""
    return F.regexp_replace(c, WS + "+", " ")


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, or NULL when the pattern does not match (Spark's own default is '')."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def capitalise_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def non_empty(*parts: Column) -> Column:
    """Array of the trimmed parts that hold something."""
    return F.filter(F.array(*[strip(or_empty(p)) for p in parts]), lambda s: s != "")


def slugify(c: Column) -> Column:
    """Lower case, letters/marks/digits/space/`_`/`-` only, each space to `-` (no de-duplication)."""
    return F.replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N} _\-]", ""), F.lit(" "), F.lit("-"))


def image_key(c: Column) -> Column:
    """The looser key used for images: spaces to `-`, lower case, punctuation kept."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("-")))


def path_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")


def path_id(relative_path: Column) -> Column:
    """Slug of every path segment, extension dropped, a trailing `/index` dropped."""
    bare = F.regexp_replace(relative_path, r"(?<=[^/])\.[^./]*\z", "")
    joined = F.array_join(F.transform(F.split(bare, "/"), slugify), "/")
    return F.regexp_replace(joined, r"/index\z", "")


def no_break_hyphens(c: Column) -> Column:
    return F.translate(c, "-", "\u2011")


def decode_ampersand(c: Column) -> Column:
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base != chr(code) and base.isascii():
            source.append(chr(code))
            target.append(base)
    # Letters with a stroke have no decomposition but fold all the same.
    for letter, base in (("ø", "o"), ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L")):
        source.append(letter)
        target.append(base)
    return "".join(source), "".join(target)


ACCENTED, UNACCENTED = _accent_table()


def fold_accents(c: Column) -> Column:
    return bind(
        c,
        lambda s: F.when(
            s.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(s, ACCENTED, UNACCENTED), r"\p{Mn}", "")
        ).otherwise(s),
    )


def locale_key(c: Column) -> Column:
    """Sort key that ignores case, accents, punctuation and spaces."""
    return F.collate(F.regexp_replace(c, r"[\p{P}\p{Z}\s]", ""), "UNICODE_CI_AI")
