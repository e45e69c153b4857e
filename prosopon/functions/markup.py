"""Markup columns: rendering blocks to HTML and rewriting HTML or Markdown text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions import text as t


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&#x26;")), F.lit("<"), F.lit("&#x3C;"))


def wrap(tag: str | Column, inner: Column) -> Column:
    name = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("<"), name, F.lit(">"), inner, F.lit("</"), name, F.lit(">"))


def render_span(span: Column) -> Column:
    """The escaped text inside its style tags, underline outermost and bold innermost."""
    tags = (("underline", "u"), ("italic", "em"), ("bold", "strong"))

    def each(form: str, order) -> list[Column]:
        return [F.when(span[flag], F.lit(form.format(tag))).otherwise("") for flag, tag in order]

    return F.concat(*each("<{}>", tags), escape(t.or_empty(span["text"])), *each("</{}>", reversed(tags)))


def render_block(block: Column, spans: Column | None = None) -> Column:
    """Tables arrive rendered; other blocks are built from their spans, or from those given instead."""
    inner = F.array_join(F.transform(block["spans"] if spans is None else spans, render_span), "")
    kind = block["kind"]
    return (
        F.when(block["html"].isNotNull(), block["html"])
        .when(kind == "paragraph", wrap("p", inner))
        .when(kind == "heading", wrap(F.concat(F.lit("h"), F.coalesce(block["level"], F.lit(1)).cast("string")), inner))
        .when(kind == "list", wrap("li", inner))
        .otherwise(inner)
    )


def render_blocks(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: render_block(b)), "")


def clean_base(base: str) -> str:
    return "" if base == "/" else re.sub(r"/$", "", base)


def prefix_links(html: Column, base: str) -> Column:
    """Prefix root-absolute `href`s; other schemes, `//host`, `#` and links already below the base stay."""
    base = clean_base(base)
    if not base:
        return html
    below = re.escape(base[1:])
    pattern = rf"""(?i)(\shref=)(["'])(?=/(?!/)(?!(?-i:{below})(?:/|\2))[^"']*\2)"""
    return F.regexp_replace(html, pattern, "$1$2" + base.replace("$", r"\$"))


def demote_headings(html: Column) -> Column:
    """Every heading one level down, six at most."""
    for level in range(5, 0, -1):
        html = F.regexp_replace(html, rf"(?i)(</?h){level}(?=[\s>/])", f"$1{level + 1}")
    return html


def strip_hidden(html: Column) -> Column:
    """Comments, scripts and styles removed, so that their content is not taken for markup."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")


def visible_text(html: Column) -> Column:
    """Tags dropped, the five basic entities decoded, whitespace squashed."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    # Fixed values; the ampersand comes last so that nothing is decoded twice.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return t.strip(t.squash(text))


BLOCK_TAGS = "p|h[1-6]|li|ul|ol|div|article|section|nav|header|footer|aside|main|table|tr|td|th|body|html|head|title|blockquote|pre|form"


def html_pieces(html: Column) -> Column:
    """The page cut before every block-level tag, keeping the pieces that open a paragraph, heading or item."""
    unmarked = F.translate(strip_hidden(html), "\u0001", "")
    marked = F.regexp_replace(unmarked, rf"(?i)<(/?)({BLOCK_TAGS})([\s>/])", "\u0001<$1$2$3")
    return F.filter(F.split(marked, "\u0001"), lambda piece: piece.rlike(r"(?i)^<(?:p|h[1-6]|li)[\s>/]"))


def links(html: Column) -> Column:
    """All `href` values in order."""
    return F.regexp_extract_all(strip_hidden(html), F.lit(r"""(?i)\shref=["']([^"']*)["']"""), F.lit(1))
