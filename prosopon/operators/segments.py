"""Block segmentation inside one document row.

A document's blocks are an ordered array in one row, so every anchor, run and section below is an array
expression: no shuffle, no window, and no group that could outgrow a task.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions import text as t

Predicate = Callable[[Column], Column]


def flags(blocks: Column, matches: Callable[..., Column]) -> Column:
    return F.transform(
        blocks,
        (lambda b, i: F.coalesce(matches(b, i), F.lit(False)))
        if len(inspect.signature(matches).parameters) == 2
        else (lambda b: F.coalesce(matches(b), F.lit(False))),
    )


def first_index(blocks: Column, matches: Callable[..., Column]) -> Column:
    """0-based index of the first block for which `matches(block[, index])` holds, -1 without one.

    A plain number instead of NULL keeps the expression free of repeated sub-expressions.
    """
    return (F.array_position(flags(blocks, matches), F.lit(True)) - 1).cast("int")


def is_paragraph(block: Column) -> Column:
    return block["kind"] == "paragraph"


def starts_with(label: str) -> Predicate:
    return lambda b: is_paragraph(b) & F.startswith(b["text"], F.lit(label))


def contains(marker: str) -> Predicate:
    return lambda b: is_paragraph(b) & F.contains(b["text"], F.lit(marker))


def contains_ignoring_case(marker: Column) -> Predicate:
    return lambda b: is_paragraph(b) & F.contains(F.lower(b["text"]), marker)


def lead_bold(block: Column) -> Column:
    """Whether the block's first span is bold (this is what ends a section)."""
    return F.coalesce(F.get(block["spans"], F.lit(0))["bold"], F.lit(False))


def run_end(blocks: Column, after: Column, stops: Predicate) -> Column:
    """Index of the first block behind `after` that stops a run; the number of blocks if none does."""
    stop = F.concat(flags(blocks, lambda b, i: (i > after) & stops(b)), F.array(F.lit(True)))
    return (F.array_position(stop, F.lit(True)) - 1).cast("int")


def _blank_or_other(block: Column) -> Column:
    return ~F.coalesce(is_paragraph(block), F.lit(False)) | ~t.has_text(block["text"])


def intro_end(blocks: Column) -> Column:
    """End of the leading run of non-empty paragraphs behind the first block."""
    return run_end(blocks, F.lit(0), _blank_or_other)


def notes_between(blocks: Column, first: Column, end: Column) -> Column:
    """Trimmed texts of blocks `first` .. `end` - 1."""
    inside = F.filter(blocks, lambda b, i: (i >= first) & (i < end))
    return F.transform(inside, lambda b: t.strip(t.or_empty(b["text"])))


def source_notes_end(blocks: Column, source: Column, limit: int) -> Column:
    """End of the run behind the source line: a blank, another kind of block or an over-long text stops it."""
    def too_long(b: Column) -> Column:
        return (F.length(b["text"]) > limit) & (F.length(t.strip(b["text"])) > limit)

    return run_end(blocks, source, lambda b: _blank_or_other(b) | too_long(b))


Heads = list[tuple[Column, str]]


def spans_shown(block: Column, i: Column, heads: Heads) -> Column:
    """The block's spans; a section head (index, label) is without its label and colon spans.

    This is what the full HTML shows, and what later sections see of the heads found before them.
    """
    spans = block["spans"]
    for at, label in heads:
        kept = F.filter(block["spans"], lambda s: ~t.strip(t.or_empty(s["text"])).isin(label, ":"))
        spans = F.when(i == at, kept).otherwise(spans)
    return spans


def section_end(blocks: Column, start: Column, heads: Heads) -> Column:
    """Index of the next block behind `start` that leads with bold text, given the heads known by then."""

    def leads_bold(b: Column, i: Column) -> Column:
        return F.coalesce(F.get(spans_shown(b, i, heads), F.lit(0))["bold"], F.lit(False))

    stop = F.concat(flags(blocks, lambda b, i: (i > start) & leads_bold(b, i)), F.array(F.lit(True)))
    return (F.array_position(stop, F.lit(True)) - 1).cast("int")


def section_text(blocks: Column, start: Column, end: Column, label: str) -> Column:
    """Head text without the label, then the non-empty continuation texts, joined by one space."""
    head = t.strip(F.regexp_replace(t.or_empty(F.get(blocks, start)["text"]), rf"^{label}{t.WS}*:?{t.WS}*", ""))
    rest = F.array_join(F.filter(notes_between(blocks, start + 1, end), lambda s: s != ""), " ")
    return F.when(start < 0, F.lit("")).when(rest == "", head).otherwise(F.concat(head, F.lit(" "), rest))


def first_attachment(attachments: Column) -> Column:
    """First attachment with content and a dotted name; the extension falls back to the name's."""
    usable = F.filter(
        attachments,
        lambda a: (F.length(a["data"]) > 0) & F.contains(a["name"], F.lit(".")),
    )
    pick = F.get(usable, F.lit(0))
    extension = F.coalesce(t.empty_to_null(pick["extension"]), F.element_at(F.split(pick["name"], r"\."), -1))
    return F.when(
        pick.isNotNull(),
        F.struct(pick["name"].alias("name"), extension.alias("extension"), pick["mime"].alias("mime"), pick["data"].alias("data")),
    )
