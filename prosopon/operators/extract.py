"""The whole extraction: documents → one typed row each, diagnostics beside the values.

Everything is a narrow projection over the document row, in a few steps so that no expression is evaluated
twice. Columns that a query does not ask for are pruned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.functions import citations, markup, names, nationality, roles
from prosopon.functions import diagnostics as dia
from prosopon.functions import text as t
from prosopon.operators import enrich
from prosopon.operators import segments as seg
from prosopon.profile import Profile
from prosopon.session import cut_lineage
from prosopon.sources import schemas

SOURCE_TEXT = r"(?i)Source:" + t.WS + r"*(.+)"
SECTIONS = ("archives", "publications", "literature")


def anchors(docs: DataFrame, profile: Profile) -> DataFrame:
    """Index of each labelled block; the source line counts as claimed only if text follows the label."""
    blocks = F.col("blocks")
    docs = docs.withColumn("blocks", F.coalesce(blocks, F.array().cast(schemas.BLOCKS)))
    return docs.select(
        "*",
        seg.first_index(blocks, seg.starts_with(profile.source_label)).alias("source_at"),
        seg.first_index(blocks, seg.starts_with(profile.version_label)).alias("version_at"),
        seg.first_index(blocks, seg.contains(profile.citation_marker)).alias("citation_at"),
        seg.first_index(blocks, seg.contains_ignoring_case(F.lit(profile.how_to_cite_marker))).alias("how_to_at"),
        seg.intro_end(blocks).alias("intro_end"),
        t.or_empty(F.get(blocks, F.lit(0))["text"]).alias("intro"),
    )


def labelled_fields(docs: DataFrame, profile: Profile) -> DataFrame:
    """Texts that sit behind the anchors."""
    blocks = F.col("blocks")

    def text_at(spot: str):
        return F.get(blocks, F.col(spot))["text"]

    source_text = text_at("source_at")
    return docs.withColumns(
        {
            "image_source": t.strip(t.extract(source_text, SOURCE_TEXT)),
            "source_claimed": F.coalesce(source_text.rlike(SOURCE_TEXT), F.lit(False)),
            "source_end": seg.source_notes_end(blocks, F.col("source_at"), profile.media_note_limit),
            "version": text_at("version_at"),
            "authors": citations.citation_authors(text_at("citation_at"), profile.citation_marker),
        }
    ).withColumns(
        {
            "author_at": seg.first_index(blocks, seg.contains_ignoring_case(F.lower(F.col("authors")))),
            "intro_notes": intro_notes(blocks),
        }
    )


def intro_notes(blocks: Column) -> Column:
    """Identity notes behind the vitals, then media notes behind the source line that are not already taken."""
    leading = seg.notes_between(blocks, F.lit(1), F.col("intro_end"))
    media = seg.notes_between(
        blocks, F.greatest(F.col("source_at") + 1, F.col("intro_end")), F.col("source_end")
    )
    return F.when(F.col("source_claimed"), F.concat(leading, media)).otherwise(leading)


def section_heads(profile: Profile) -> list[tuple[Column, str]]:
    return [(F.col(f"{name}_at"), label) for name, label in zip(SECTIONS, profile.section_labels)]


def sections(docs: DataFrame, profile: Profile) -> DataFrame:
    """Start, end and raw text per labelled section.

    Sections are taken in order; the head of an earlier one has lost its label when the end of a later one is
    looked for.
    """
    blocks, heads = F.col("blocks"), section_heads(profile)
    labels = dict(zip(SECTIONS, profile.section_labels))
    starts = {f"{s}_at": seg.first_index(blocks, seg.starts_with(labels[s])) for s in SECTIONS}
    ends = {f"{s}_end": seg.section_end(blocks, F.col(f"{s}_at"), heads[:n]) for n, s in enumerate(SECTIONS)}
    raw = {
        f"{s}_raw": seg.section_text(blocks, F.col(f"{s}_at"), F.col(f"{s}_end"), labels[s]) for s in SECTIONS
    }
    return docs.withColumns(starts).withColumns(ends).withColumns(raw)


def rendered(profile: Profile) -> Column:
    """HTML of every block, section heads without their labels."""
    heads = section_heads(profile)
    return F.transform("blocks", lambda b, i: markup.render_block(b, seg.spans_shown(b, i, heads)))


def residual(html: Column) -> Column:
    """The rendered blocks that no extractor used and that hold any text."""
    blocks = F.col("blocks")
    return F.filter(html, lambda h, i: ~claimed(i) & t.has_text(F.get(blocks, i)["text"]))


def claimed(i: Column) -> Column:
    """Whether some extractor used block `i`."""
    result = (i < F.col("intro_end")) | (
        F.col("source_claimed")
        & (i >= F.col("source_at"))
        & (i < F.greatest(F.col("source_end"), F.col("source_at") + 1))
    )
    for s in SECTIONS:
        result = result | ((F.col(f"{s}_at") >= 0) & (i >= F.col(f"{s}_at")) & (i < F.col(f"{s}_end")))
    for c in ("version_at", "citation_at", "how_to_at", "author_at"):
        result = result | (i == F.col(c))
    return result


def vitals(docs: DataFrame, forms: Sequence[tuple[str, str]]) -> DataFrame:
    """Name, summary, life, roles and nationality out of the first block."""
    intro = F.col("intro")
    return docs.withColumns(
        {"name": names.parse_name(intro), "summary": names.summary(intro), "life": names.life(intro)}
    ).withColumns(
        {
            "roles": roles.parse_roles(t.or_empty(F.col("summary"))),
            "origin": nationality.nationality(t.or_empty(F.col("summary")), forms),
        }
    )


def _diagnostics() -> Column:
    summary = t.or_empty(F.col("summary"))
    has_intro, has_summary = F.col("intro") != "", summary != ""
    has_years = summary.rlike(roles.ROLE_END)
    return dia.collect(
        dia.report("image_source_missing", F.col("source_at") < 0),
        dia.report("image_attachment_missing", F.col("attachment").isNull()),
        dia.report("intro_missing", ~has_intro),
        dia.report("name_unparsed", has_intro & F.col("name").isNull()),
        dia.report("summary_unparsed", has_intro & F.col("summary").isNull()),
        dia.report("life_unparsed", has_intro & F.col("life").isNull()),
        dia.report("roles_missing_input", ~has_summary),
        dia.report("roles_no_year_span", has_summary & ~has_years),
        dia.report("role_unparsed", has_summary & has_years & (F.size("roles") == 0)),
        dia.report("nationality_missing_input", ~has_summary),
        dia.report("nationality_unknown", has_summary & F.col("origin.nationality").isNull()),
        dia.report("version_missing", F.col("version_at") < 0),
        dia.report("citation_missing", F.col("citation_at") < 0),
        *[dia.report(f"apl_{s}_missing", F.col(f"{s}_at") < 0) for s in SECTIONS],
    )


def extract_all(docs: DataFrame, profile: Profile, forms: Sequence[tuple[str, str]] | DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """`doc_id, blocks, attachments[, ...]` → one bio per document, with the columns named in `carried`.

    `forms` is a short list of (demonym, country), or a table of demonyms of any size: then the documents are written once and joined with what the
    dictionary finds in their summaries. An undecodable document keeps its row: no values, one diagnostic.
    """
    readable = docs if "problem" in docs.columns else docs.withColumn("problem", F.lit(None).cast("string"))
    listed = not isinstance(forms, DataFrame)
    staged = vitals(sections(labelled_fields(anchors(readable, profile), profile), profile), forms if listed else ())
    if not listed:
        stored = cut_lineage(staged.withColumn("_row", F.monotonically_increasing_id()), "staged")
        staged = enrich.with_origin(stored.drop("origin"), "_row", "summary", forms).drop("_row")
    staged = staged.withColumns({"attachment": seg.first_attachment(F.col("attachments")), "rendered": rendered(profile)})
    unreadable = dia.collect(dia.report("document_unreadable", F.col("problem").isNotNull()))
    return staged.select(
        "doc_id",
        *carried,
        F.col("name.first_name").alias("first_name"),
        F.col("name.last_name").alias("last_name"),
        F.col("name.known_as").alias("known_as"),
        F.col("name.nee").alias("nee"),
        "summary",
        "life",
        "intro_notes",
        "roles",
        F.col("origin.nationality").alias("nationality"),
        F.col("origin.country").alias("country"),
        "image_source",
        F.col("attachment").alias("image_attachment"),
        "version",
        "authors",
        *[citations.citation_list(F.col(f"{s}_raw")).alias(s) for s in SECTIONS],
        F.array_join(residual(F.col("rendered")), "").alias("body"),
        F.array_join("rendered", "").alias("html"),
        F.when(F.col("problem").isNotNull(), unreadable).otherwise(_diagnostics()).alias("diagnostics"),
    )


def unnest(table: DataFrame, column: str, *kept: str, index: str = "pos", value: str = "value") -> DataFrame:
    """One row per array element.

    The outer form with a test on the position: the plain form infers a filter on the array, which would push
    a second copy of the whole extraction below itself.
    """
    return table.select(*kept, F.posexplode_outer(column).alias(index, value)).where(F.col(index).isNotNull())


def diagnostics_table(bios: DataFrame) -> DataFrame:
    return unnest(bios, "diagnostics", "doc_id").select("doc_id", "value.*")


def roles_table(bios: DataFrame) -> DataFrame:
    """One row per role; persons without one keep a row with index -1."""
    return bios.select("doc_id", F.posexplode_outer("roles").alias("pos", "role")).select(
        "doc_id", F.coalesce("pos", F.lit(-1)).alias("role_index"), "role.*"
    )


def citations_table(bios: DataFrame) -> DataFrame:
    """One row per citation of each section."""
    def section(name: str) -> Column:
        data = F.col(name)
        return F.transform(
            data["items"],
            lambda item, i: F.struct(
                F.lit(name).alias("section"), i.alias("item_index"), item["raw"].alias("raw"),
                data["websites_accessed_on"].alias("websites_accessed_on"),
                citations.presentation(data["items"]).alias("presentation"),
            ),
        )

    listed = F.concat(*[section(s) for s in SECTIONS])
    return unnest(bios.select("doc_id", listed.alias("c")), "c", "doc_id").select("doc_id", "value.*")
