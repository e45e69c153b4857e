"""Queries over the fields, sections and diagnostics of the written biographies."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosopon.functions import citations, markup, names, roles
from prosopon.functions import text as t
from prosopon.operators import extract, segments
from prosopon.plans import oracle, synth
from prosopon.plans.catalog import registrar
from prosopon.plans.synth import FORMS, PROFILE

CATALOG, query = registrar()


def _anchored(spark, sf_dir):
    return extract.anchors(synth.documents(spark, sf_dir), PROFILE)


# --- vitals ---------------------------------------------------------------------------------------------


@query(oracle.people("SELECT doc_id, last_name, first_name, known_as, nee FROM fields"))
def person_names(spark, sf_dir):
    parsed = _anchored(spark, sf_dir).select("doc_id", names.parse_name(F.col("intro")).alias("n"))
    return parsed.select("doc_id", "n.last_name", "n.first_name", "n.known_as", "n.nee")


@query(
    oracle.people(
        "SELECT doc_id, CASE WHEN nee IS NOT NULL THEN 'nee' WHEN paren LIKE ' (known%' AND named THEN 'known as' "
        "WHEN paren LIKE ' (called%' AND named THEN 'called' WHEN known_as IS NOT NULL THEN 'bare' ELSE 'none' END AS alias_kind, "
        "coalesce(nee, known_as, '') AS alias FROM fields"
    )
)
def alias_kinds(spark, sf_dir):
    paren = t.strip(F.regexp_extract(F.col("intro"), names.NAME, 3))
    parsed = _anchored(spark, sf_dir).select("doc_id", paren.alias("paren"), names.parse_name(F.col("intro")).alias("n"))
    kind = (
        F.when(F.col("n.nee").isNotNull(), "nee")
        .when(F.col("paren").rlike("(?i)^known as"), "known as")
        .when(F.col("paren").rlike("(?i)^called"), "called")
        .when(F.col("n.known_as").isNotNull(), "bare")
        .otherwise("none")
    )
    return parsed.select("doc_id", kind.alias("alias_kind"), F.coalesce("n.nee", "n.known_as", F.lit("")).alias("alias"))


@query(oracle.people("SELECT doc_id, summary, life FROM fields"))
def summary_and_life(spark, sf_dir):
    intro = F.col("intro")
    return _anchored(spark, sf_dir).select("doc_id", names.summary(intro).alias("summary"), names.life(intro).alias("life"))


@query("SELECT c_custkey, c_mktsegment, 'van der ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '-O’' "
       "|| upper(substr(r_name, 1, 1)) || CASE WHEN r_name = 'MIDDLE EAST' THEN 'iddle East' ELSE lower(substr(r_name, 2)) END || ' McKay' AS cased "
       "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def surname_casing(spark, sf_dir):
    raw = F.concat(F.lit("VAN DER "), F.col("c_mktsegment"), F.lit("-O’"), F.col("r_name"), F.lit(" MCKAY"))
    return synth.people(spark, sf_dir).select("c_custkey", "c_mktsegment", names.surname_case(raw).alias("cased"))


# --- roles ----------------------------------------------------------------------------------------------


@query(
    oracle.people(
        "SELECT f.doc_id, coalesce(role_index, -1) AS role_index, ord AS ordinal_text, title, org AS organisation, abbr AS abbreviation, "
        "y1::VARCHAR AS start_year, y2::VARCHAR AS end_year FROM fields f LEFT JOIN held h ON f.doc_id = h.doc_id"
    )
)
def role_rows(spark, sf_dir):
    table = extract.roles_table(synth.bios(spark, sf_dir))
    return table.withColumns({c: F.col(c).cast("string") for c in ("start_year", "end_year")})


@query(
    oracle.people(
        "SELECT doc_id, len(cut) AS pieces, unnest(cut) AS piece, generate_subscripts(cut, 1) - 1 AS place FROM (SELECT doc_id, "
        "CASE WHEN has_roles AND len(cl) > 0 THEN list_concat([spelling || ' lawyer and ' || cl[1]], cl[2:]) WHEN summary = '1995-1999' THEN [summary] END AS cut FROM fields)"
    )
)
def role_pieces(spark, sf_dir):
    """The summary cut behind each year token, connectors dropped."""
    pieces = _anchored(spark, sf_dir).select("doc_id", roles.role_pieces(names.summary(F.col("intro"))).alias("p"))
    rows = pieces.select("doc_id", F.size("p").alias("pieces"), F.posexplode_outer("p").alias("place", "marked")).where(F.col("place").isNotNull())
    return rows.select("doc_id", "pieces", F.replace("marked", F.lit(roles.YEARS), F.lit("")).alias("piece"), "place")


@query(oracle.people("SELECT title, org AS organisation, abbr AS abbreviation, count(*) AS holders, min(y1) AS first_year, max(y2) AS last_year FROM held GROUP BY ALL"))
def office_holders(spark, sf_dir):
    """Offices with institution titles back-filled, and how many held them."""
    table = extract.roles_table(synth.bios(spark, sf_dir)).where(F.col("role_index") >= 0)
    return table.groupBy("title", "organisation", "abbreviation").agg(
        F.count("*").alias("holders"), F.min("start_year").alias("first_year"), F.max("end_year").alias("last_year")
    )


@query(oracle.people("SELECT coalesce(ord, 'none') AS ordinal_text, count(*) AS roles, sum(y2 - y1 + 1)::BIGINT AS years FROM held GROUP BY ALL"))
def roles_by_ordinal(spark, sf_dir):
    table = extract.roles_table(synth.bios(spark, sf_dir)).where(F.col("role_index") >= 0)
    return table.groupBy(F.coalesce("ordinal_text", F.lit("none")).alias("ordinal_text")).agg(
        F.count("*").alias("roles"), F.sum(F.col("end_year") - F.col("start_year") + 1).alias("years")
    )


# --- nationality ----------------------------------------------------------------------------------------


@query(oracle.people("SELECT doc_id, nationality, country FROM fields"))
def nationalities(spark, sf_dir):
    return synth.bios(spark, sf_dir).select("doc_id", "nationality", "country")


# --- sections and labelled blocks -----------------------------------------------------------------------

_PRESENT = (
    "placed AS (SELECT *, 2 + (seg = 'BUILDING')::INT AS i_source, 2 + (seg = 'BUILDING')::INT + has_source::INT + (seg = 'FURNITURE')::INT + 1 "
    "+ 2 + (seg = 'MACHINERY')::INT + 1 + has_literature::INT AS i_archives FROM fields), "
    "spots AS (SELECT *, i_archives + 2 * has_archives::INT AS i_publications FROM placed), "
    "spotted AS (SELECT *, i_publications + has_publications::INT AS i_literature, "
    "i_publications + has_publications::INT + has_literature::INT AS i_version FROM spots), "
    "located AS (SELECT *, i_version + has_version::INT AS i_how_to FROM spotted)"
)


@query(
    oracle.people(
        "SELECT doc_id, CASE WHEN has_source THEN i_source ELSE -1 END AS source_at, CASE WHEN has_version THEN i_version ELSE -1 END AS version_at, "
        "CASE WHEN has_citation THEN i_how_to ELSE -1 END AS how_to_at, CASE WHEN has_citation THEN i_how_to + 1 ELSE -1 END AS citation_at, "
        "1 + (seg = 'BUILDING')::INT AS intro_end FROM located",
        _PRESENT,
    )
)
def labelled_blocks(spark, sf_dir):
    """Where each labelled block sits, -1 when it is missing."""
    found = _anchored(spark, sf_dir)
    spots = ("source_at", "version_at", "how_to_at", "citation_at")
    return found.select("doc_id", *spots, "intro_end")


@query(
    oracle.people(
        "SELECT doc_id, CASE WHEN has_archives THEN i_archives ELSE -1 END AS archives_at, CASE WHEN has_archives THEN i_archives + 2 ELSE -1 END AS archives_end, "
        "CASE WHEN has_publications THEN i_publications ELSE -1 END AS publications_at, CASE WHEN has_literature THEN i_literature + 1 ELSE -1 END AS literature_end, "
        "CASE WHEN has_literature THEN 'Life of ' || up || '.' ELSE '' END AS literature_raw FROM located",
        _PRESENT,
    )
)
def section_spans(spark, sf_dir):
    found = extract.sections(synth.documents(spark, sf_dir), PROFILE)
    return found.select(
        "doc_id", "archives_at", "publications_at", "literature_raw",
        *[F.when(F.col(f"{s}_at") < 0, -1).otherwise(F.col(f"{s}_end")).alias(f"{s}_end") for s in ("archives", "literature")],
    )


@query(oracle.people("SELECT doc_id, unnest(notes) AS note, generate_subscripts(notes, 1) - 1 AS note_index FROM fields"))
def intro_notes(spark, sf_dir):
    """Identity notes behind the vitals and media notes behind the source line."""
    return extract.unnest(synth.bios(spark, sf_dir), "intro_notes", "doc_id", index="note_index", value="note")


@query(
    oracle.people(
        "SELECT doc_id, unnest(range(0, i_how_to + 2 * has_citation::INT)) AS idx, unnest(list_transform(range(0, i_how_to + 2 * has_citation::INT), "
        "lambda i: i <= (seg = 'BUILDING')::INT OR (has_source AND i >= i_source AND i <= i_source + (seg = 'FURNITURE')::INT) "
        "OR (has_literature AND i = i_archives - 1) OR i >= i_archives)) AS claimed FROM located",
        _PRESENT,
    )
)
def claimed_blocks(spark, sf_dir):
    """Every block and whether some extractor used it; the rest is the body."""
    found = extract.sections(extract.labelled_fields(_anchored(spark, sf_dir), PROFILE), PROFILE)
    flagged = found.select("doc_id", F.transform("blocks", lambda b, i: extract.claimed(i)).alias("flags"))
    return extract.unnest(flagged, "flags", "doc_id", index="idx", value="claimed")


@query(oracle.people("SELECT doc_id, authors, CASE WHEN has_literature THEN i_archives - 1 WHEN has_citation THEN i_how_to + 1 ELSE -1 END AS author_at FROM located", _PRESENT))
def author_claims(spark, sf_dir):
    """Authors from the citation, and the first paragraph that names them."""
    found = extract.labelled_fields(_anchored(spark, sf_dir), PROFILE)
    return found.select("doc_id", "authors", "author_at")


@query(oracle.people("SELECT doc_id, body FROM pages_of"))
def body_html(spark, sf_dir):
    return synth.bios(spark, sf_dir).select("doc_id", "body")


@query(oracle.people("SELECT doc_id, html FROM pages_of"))
def full_html(spark, sf_dir):
    return synth.bios(spark, sf_dir).select("doc_id", "html")


@query(
    oracle.people(
        "SELECT doc_id, CASE WHEN has_photo THEN 'photo' || k || CASE seg WHEN 'MACHINERY' THEN '.emf' ELSE '.png' END END AS name, "
        "CASE WHEN has_photo THEN CASE seg WHEN 'MACHINERY' THEN 'emf' ELSE 'png' END END AS extension, "
        "CASE WHEN has_photo THEN sha256('bytes' || k) END AS digest FROM fields"
    )
)
def portrait_attachments(spark, sf_dir):
    pick = synth.documents(spark, sf_dir).select("doc_id", segments.first_attachment(F.col("attachments")).alias("a"))
    return pick.select("doc_id", "a.name", "a.extension", F.sha2("a.data", 256).alias("digest"))


@query(
    oracle.people(
        "SELECT doc_id, 'archives' AS section, unnest(archive_items) AS raw, generate_subscripts(archive_items, 1) - 1 AS item_index, '1 May 2020' AS websites_accessed_on, "
        "CASE WHEN len(archive_items) > 1 THEN 'list' ELSE 'prose' END AS presentation FROM fields "
        "UNION ALL SELECT doc_id, 'publications', unnest(publication_items), generate_subscripts(publication_items, 1) - 1, NULL, 'list' FROM fields "
        "UNION ALL SELECT doc_id, 'literature', unnest(literature_items), generate_subscripts(literature_items, 1) - 1, NULL, 'prose' FROM fields"
    )
)
def citation_rows(spark, sf_dir):
    return extract.citations_table(synth.bios(spark, sf_dir))


# --- versions, authors, credits -------------------------------------------------------------------------


@query(
    oracle.people(
        "SELECT doc_id, version, coalesce(substr(version, 9), '') AS label, CASE WHEN NOT has_version THEN NULL WHEN seg = 'MACHINERY' THEN year(last_order) || '-01-01' "
        "WHEN seg = 'HOUSEHOLD' THEN '2019-02-31' ELSE strftime(last_order, '%Y-%m-%d') END AS published, "
        "has_version AND seg <> 'HOUSEHOLD' AS in_calendar FROM fields"
    )
)
def publication_dates(spark, sf_dir):
    v = F.col("version")
    return synth.bios(spark, sf_dir).select(
        "doc_id", "version", citations.version_label(v).alias("label"), citations.publication_date(v).alias("published"),
        citations.checked_date(v).isNotNull().alias("in_calendar"),
    )


@query(
    oracle.people(
        "SELECT doc_id, unnest(names) AS author, generate_subscripts(names, 1) - 1 AS position FROM (SELECT doc_id, CASE WHEN NOT has_citation THEN ['Lives Register'] "
        "WHEN seg = 'BUILDING' THEN ['Ada N' || nk || ', Jr.', 'Bo Ray'] WHEN seg = 'FURNITURE' THEN ['Ada N' || nk, 'Cy Orr', 'Bo Ray'] "
        "ELSE ['Ada N' || nk] END AS names FROM fields)"
    )
)
def author_rows(spark, sf_dir):
    listed = citations.author_list(F.col("authors"), PROFILE.dictionary).alias("listed")
    return extract.unnest(synth.bios(spark, sf_dir).select("doc_id", listed), "listed", "doc_id", index="position", value="author")


@query(
    oracle.people(
        "SELECT doc_id, image_source, CASE WHEN has_source THEN 'Photograph by K. Stone' ELSE '' END AS text, "
        "CASE WHEN has_source THEN 'https://www.pics' || nk || '.example/p/' || k || '?a=1&b=2' END AS href, "
        "CASE WHEN has_source THEN 'pics' || nk || '.example' END AS label FROM fields"
    )
)
def image_credits(spark, sf_dir):
    credited = synth.bios(spark, sf_dir).select("doc_id", "image_source", citations.image_credit(F.col("image_source")).alias("c"))
    return credited.select("doc_id", "image_source", "c.text", "c.href", "c.label")


# --- the whole record and its diagnostics ---------------------------------------------------------------


@query(
    oracle.people(
        "SELECT doc_id, first_name, last_name, known_as, nee, summary, life, array_to_string(notes, ' | ') AS intro_notes, nationality, country, "
        "image_source, version, authors, len(archive_items) AS n_archives, len(publication_items) AS n_publications, len(literature_items) AS n_literature, "
        "sha256(body) AS body_digest, sha256(html) AS html_digest FROM pages_of"
    )
)
def biographies(spark, sf_dir):
    """Documents to typed records, the whole extraction at once."""
    kept = ("doc_id", "first_name", "last_name", "known_as", "nee", "summary", "life", "nationality", "country", "image_source", "version", "authors")
    return synth.bios(spark, sf_dir).select(
        *kept,
        F.array_join("intro_notes", " | ").alias("intro_notes"),
        *[F.size(f"{s}.items").alias(f"n_{s}") for s in extract.SECTIONS],
        F.sha2("body", 256).alias("body_digest"),
        F.sha2("html", 256).alias("html_digest"),
    )


@query(oracle.people(f"SELECT doc_id, code, {oracle.SEVERITY} AS severity FROM flags"))
def diagnostic_rows(spark, sf_dir):
    return extract.diagnostics_table(synth.bios(spark, sf_dir)).select("doc_id", "code", "severity")


@query(oracle.people("SELECT doc_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(body, '<p>')) AS body_paragraphs FROM pages_of"))
def rendered_paragraphs(spark, sf_dir):
    """Paragraphs rendered, and those that are left once blank and claimed blocks are out."""
    return synth.bios(spark, sf_dir).select(
        "doc_id", F.regexp_count("html", F.lit("<p>")).alias("paragraphs"), F.regexp_count("body", F.lit("<p>")).alias("body_paragraphs")
    )
