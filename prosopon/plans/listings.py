"""Queries over the person-by-role listing and batch search."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosopon.functions import search
from prosopon.functions import names as name_functions
from prosopon.functions import text as t
from prosopon.operators import listing, ordering
from prosopon.plans import oracle, synth
from prosopon.plans.catalog import registrar

CATALOG, query = registrar()

SORT_NAME = "lower(strip_accents(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')))"
ALL = "slug, role_index, name, role, organisation, years, nationality"


def rank_sql(value: str, asked: str) -> str:
    """The rank ladder in SQL."""
    low = asked.lower()
    plain = f"strip_accents({value})"
    lowered = f"lower({plain})"
    steps = [
        f"WHEN {plain} = '{asked}' THEN 7", f"WHEN {lowered} = '{low}' THEN 6", f"WHEN starts_with({lowered}, '{low}') THEN 5",
        f"WHEN contains({lowered}, ' {low}') THEN 4", f"WHEN contains({lowered}, '{low}') THEN 3",
    ]
    if len(low) > 1:
        initials = f"array_to_string(list_transform(regexp_split_to_array({lowered}, '[ -]+'), lambda w: substr(w, 1, 1)), '')"
        steps.append(f"WHEN contains({initials}, '{low}') THEN 2")
        steps.append(f"WHEN {lowered} LIKE '%{'%'.join(low)}%' THEN 1")
    return f"CASE {' '.join(steps)} ELSE 0 END"


def any_rank_sql(asked: str) -> str:
    return "greatest(" + ", ".join(rank_sql(c, asked) for c in listing.COLUMNS.values()) + ")"


@query(oracle.people(f"SELECT row_number() OVER (ORDER BY {SORT_NAME}, slug, role_index) AS position, {ALL} FROM listing"))
def listing_by_name(spark, sf_dir):
    """The flagship: the whole listing in locale order, with explicit positions."""
    rows = listing.listing(synth.bios(spark, sf_dir))
    return ordering.with_position(rows, listing.sort_order("fullName"))


@query(oracle.people(f"SELECT {ALL}, replace(role, '-', chr(8209)) AS role_shown FROM listing"))
def listing_rows(spark, sf_dir):
    rows = listing.listing(synth.bios(spark, sf_dir))
    return rows.withColumn("role_shown", t.no_break_hyphens(F.col("role")))


@query(oracle.people(f"SELECT {ALL}, {any_rank_sql('unhcr')} AS rank FROM listing WHERE {any_rank_sql('unhcr')} > 0"))
def listing_search(spark, sf_dir):
    rows = listing.fuzzy_filter(listing.listing(synth.bios(spark, sf_dir)), "unhcr")
    return rows.withColumn("rank", listing.best_rank("unhcr", *[F.col(c) for c in listing.COLUMNS.values()]))


@query(oracle.people(f"SELECT role, organisation, {rank_sql('role', 'uhcr')} AS by_role, {rank_sql('organisation', 'Ec')} AS by_organisation, count(*) AS n FROM listing GROUP BY ALL"))
def listing_ranks(spark, sf_dir):
    """How titles and organisations rank against two queries."""
    rows = listing.listing(synth.bios(spark, sf_dir))
    return rows.groupBy(
        "role", "organisation", search.rank(F.col("role"), "uhcr").alias("by_role"), search.rank(F.col("organisation"), "Ec").alias("by_organisation")
    ).agg(F.count("*").alias("n"))


@query(oracle.people(f"SELECT {ALL} FROM listing WHERE contains(lower(organisation), 'asia')"))
def listing_column_filter(spark, sf_dir):
    return listing.column_filter(listing.listing(synth.bios(spark, sf_dir)), "organisation", "ASIA")


_LIST_KEY = "lower(organisation) DESC, slug, role_index"


@query(
    oracle.people(
        f"SELECT {ALL}, position, position > 1 AND slug = previous AS continuation, sum(CASE WHEN slug = previous THEN 0 ELSE 1 END) OVER (ORDER BY position)::BIGINT AS run "
        f"FROM (SELECT {ALL}, row_number() OVER (ORDER BY {_LIST_KEY}) AS position, lag(slug) OVER (ORDER BY {_LIST_KEY}) AS previous FROM listing)"
    ).replace("position > 1 AND slug = previous", "coalesce(slug = previous, false)")
)
def listing_groups(spark, sf_dir):
    """List view sorted downwards by organisation, neighbours of one person grouped."""
    return listing.list_groups(listing.listing(synth.bios(spark, sf_dir)), "organisation", descending=True)


@query(
    oracle.people(
        f"SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY lower(organisation) DESC, role_index) AS n FROM listing WHERE {any_rank_sql('commiss')} > 0) WHERE n = 1"
    )
)
def listing_grid(spark, sf_dir):
    """Grid view of a search: one row per person, the first in the current order."""
    return listing.query_listing(synth.bios(spark, sf_dir), q="commiss", sort="organisation:desc", view="grid")


@query(oracle.people(f"SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY lower(years), role_index) AS n FROM listing) WHERE n = 1"))
def listing_first_rows(spark, sf_dir):
    """First row per person over the flat listing."""
    return listing.first_rows(listing.listing(synth.bios(spark, sf_dir)), "year")


@query(
    oracle.people(
        f"SELECT row_number() OVER (ORDER BY lower(nationality) DESC, slug, role_index) AS position, {ALL} FROM listing WHERE {any_rank_sql('sg')} > 0"
    )
)
def listing_query(spark, sf_dir):
    """Search text, sort spec and list view together."""
    return listing.query_positions(synth.bios(spark, sf_dir), q="sg", sort="nationality:desc")


@query(oracle.people(f"SELECT {ALL} FROM listing ORDER BY {SORT_NAME}, slug, role_index LIMIT 25"))
def listing_top(spark, sf_dir):
    """The first page of the sorted listing (a top-k report)."""
    rows = listing.listing(synth.bios(spark, sf_dir))
    return ordering.limit_rows(rows, listing.sort_order("fullName"), 25)


@query(
    oracle.people(
        "SELECT doc_id, upper(coalesce(last_name, '')) || ', ' || coalesce(first_name, '') AS title, "
        "upper(coalesce(last_name, '')) || ', ' || coalesce(first_name, '') || CASE WHEN nee IS NOT NULL THEN ' (née Harlem)' "
        "WHEN known_as IN ('Bob', 'Ted') THEN ' (' || known_as || ')' ELSE '' END AS display_name, "
        "CASE WHEN named THEN upper(last_name) || ', ' || first_name ELSE '' END AS deposit_title FROM fields"
    )
)
def display_names(spark, sf_dir):
    first, last = F.col("first_name"), F.col("last_name")
    return synth.bios(spark, sf_dir).select(
        "doc_id",
        name_functions.entry_title(first, last).alias("title"),
        name_functions.display_name(first, last, F.col("known_as"), F.col("nee")).alias("display_name"),
        name_functions.deposit_title(first, last).alias("deposit_title"),
    )


QUERIES = ["the", "de la", "TION", "thon", "xq", "ou ier"]
_HITS = " UNION ALL ".join(
    f"SELECT '{q}' AS query, {rank_sql('title', q)} AS rank, page_id, title FROM titles" for q in QUERIES
)
_TITLE = "<title>([^<]*)</title>"


@query(
    f"WITH titles AS (SELECT page_id, regexp_extract(html, '{_TITLE}', 1) AS title FROM pages), hits AS ({_HITS}) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank DESC, page_id) AS place FROM hits WHERE rank > 0) WHERE place <= 10"
)
def title_search(spark, sf_dir):
    """Ten best page titles for each of a batch of queries (a top-k report)."""
    titles = synth.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", _TITLE, 1).alias("title"))
    return listing.batch_search(titles, "page_id", "title", QUERIES, 10)


@query(
    "SELECT lang, source, " + rank_sql("text", "license") + " AS rank, count(*) AS documents FROM documents GROUP BY ALL"
)
def document_ranks(spark, sf_dir):
    """How the whole texts of the corpus rank against a query, by language and source."""
    docs = synth.read(spark, sf_dir, "documents").select("lang", "source", "text").repartition(synth.tasks(spark))
    return docs.groupBy("lang", "source", search.rank(F.col("text"), "license").alias("rank")).agg(F.count("*").alias("documents"))
