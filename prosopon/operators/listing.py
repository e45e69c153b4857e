"""The person-by-role listing: search, sort and the two views.

A person's roles stay in the person's row until the last moment, so the grid view (first matching role per
person in the current order) needs no grouping at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.functions import names, roles, search
from prosopon.functions import text as t
from prosopon.operators import ordering, postings
from prosopon.operators.extract import unnest
from prosopon.session import cut_lineage

# Listing columns by the ids that a query string uses.
COLUMNS = {
    "slug": "slug", "fullName": "name", "role": "role", "organisation": "organisation",
    "year": "years", "nationality": "nationality",
}
VIEWS = ("list", "grid")


def person_rows(bios: DataFrame) -> DataFrame:
    """One row per person: slug, name, nationality label and the array of role rows (index -1 without roles)."""
    no_role = F.array(
        F.struct(
            F.lit(-1).alias("role_index"), F.lit("").alias("role"), F.lit("").alias("organisation"), F.lit("").alias("years")
        )
    )
    rows = F.transform(
        "roles",
        lambda r, i: F.struct(
            i.alias("role_index"),
            t.or_empty(r["title"]).alias("role"),
            roles.organisation_label(r).alias("organisation"),
            roles.years_label(r).alias("years"),
        ),
    )
    return bios.select(
        F.col("doc_id").alias("slug"),
        names.listing_name(F.col("first_name"), F.col("last_name"), F.col("known_as"), F.col("nee")).alias("name"),
        F.coalesce(t.empty_to_null(F.col("nationality")), F.lit("Unspecified")).alias("nationality"),
        t.bind(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(no_role)).alias("rows"),
    )


def listing(bios: DataFrame) -> DataFrame:
    """One row per person and role."""
    return (
        person_rows(bios)
        .select("slug", "name", "nationality", F.explode_outer("rows").alias("r"))
        .select("slug", "r.role_index", "name", "r.role", "r.organisation", "r.years", "nationality")
    )


def best_rank(query: str, *columns: Column) -> Column:
    """Best rank over the columns; 0 means that none passes."""
    return F.greatest(*[search.rank(c, query) for c in columns])


def fuzzy_filter(rows: DataFrame, query: str) -> DataFrame:
    """Rows of which any listing column ranks against the query."""
    if not query:
        return rows
    return rows.where(best_rank(query, *[F.col(c) for c in COLUMNS.values()]) > 0)


def column_filter(rows: DataFrame, column: str, query: str) -> DataFrame:
    return rows.where(search.contains_ignoring_case(F.col(_column(column)), query))


def _column(column_id: str) -> str:
    if column_id not in COLUMNS:
        raise ValueError(f"no listing column {column_id!r}; choose from {', '.join(COLUMNS)}")
    return COLUMNS[column_id]


def sort_order(column_id: str = "fullName", descending: bool = False) -> list[Column]:
    """Sort columns; ties keep slug and role order whichever way the sort goes."""
    name = _column(column_id)
    key = t.locale_key(F.col(name)) if name == "name" else F.lower(F.col(name))
    return [key.desc() if descending else key.asc(), F.col("slug").asc(), F.col("role_index").asc()]


def parse_sort(spec: str) -> tuple[str, bool]:
    """`id:dir` → (id, descending); anything but `desc` sorts upwards."""
    column, _, direction = spec.partition(":")
    _column(column)
    return column, direction == "desc"


def grid(bios: DataFrame, query: str = "", column_id: str = "fullName", descending: bool = False) -> DataFrame:
    """One row per person: the first of the person's matching rows in the current order."""
    name = _column(column_id)
    people = person_rows(bios)
    own = ("role", "organisation", "years")
    rows = F.col("rows")
    if query:
        # What belongs to the person is ranked once, not once per role.
        people = people.withColumn("by_person", best_rank(query, F.col("slug"), F.col("name"), F.col("nationality")) > 0)
        rows = F.filter("rows", lambda r: F.col("by_person") | (best_rank(query, *[r[c] for c in own]) > 0))
    sign = -1 if descending else 1

    def keyed(row: Column) -> Column:
        key = F.lower(row[name]) if name in own else F.lit("")
        return F.struct(key.alias("key"), (row["role_index"] * sign).alias("at"), row.alias("row"))

    first = F.array_max if descending else F.array_min
    picked = people.select("slug", "name", "nationality", first(F.transform(rows, keyed))["row"].alias("r"))
    present = picked.select("slug", "name", "nationality", F.filter(F.array("r"), lambda r: r.isNotNull()).alias("r"))
    return unnest(present, "r", "slug", "name", "nationality").select(
        "slug", "value.role_index", "name", "value.role", "value.organisation", "value.years", "nationality"
    )


def matching(bios: DataFrame, q: str, sort: str, view: str) -> tuple[DataFrame, list[Column]]:
    """The rows that a page shows, and their order."""
    if view not in VIEWS:
        raise ValueError(f"view must be one of {VIEWS}")
    column, descending = parse_sort(sort)
    rows = grid(bios, q, column, descending) if view == "grid" else fuzzy_filter(listing(bios), q)
    return rows, sort_order(column, descending)


def query_listing(bios: DataFrame, q: str = "", sort: str = "fullName:asc", view: str = "list") -> DataFrame:
    """The listing as a page shows it: filtered, sorted, as `list` or `grid`."""
    rows, order = matching(bios, q, sort, view)
    # A global sort samples its input first; on the written rows that costs a scan and not a second extraction.
    return cut_lineage(rows, "listing").orderBy(*order)


def query_positions(bios: DataFrame, q: str = "", sort: str = "fullName:asc", view: str = "list") -> DataFrame:
    """The same rows with their `position`, for tables that are stored or paged: the rows are written once and not sorted themselves."""
    rows, order = matching(bios, q, sort, view)
    return ordering.with_position(rows, order)


def first_rows(rows: DataFrame, column_id: str = "fullName", descending: bool = False) -> DataFrame:
    """The grid's choice for a flat listing table: one struct per person is carried through the aggregation."""
    name = _column(column_id)
    sign, pick = (-1, F.max_by) if descending else (1, F.min_by)
    order = F.struct(F.lower(F.col(name)), F.col("role_index") * sign)
    return rows.groupBy("slug").agg(pick(F.struct(*rows.columns), order).alias("r")).select("r.*")


def list_groups(rows: DataFrame, column_id: str = "fullName", descending: bool = False) -> DataFrame:
    """Position, run number and continuation flag of the list view, whose neighbours of one person belong together."""
    return ordering.with_runs(rows, sort_order(column_id, descending), "slug")


def batch_search(docs: DataFrame, id_column: str, text_column: str, queries: list[str] | DataFrame, k: int) -> DataFrame:
    """The k best matches of each query, a list or a table (query), over a corpus with unique ids: by a table of postings (see `postings`)."""
    asked = queries if isinstance(queries, DataFrame) else docs.sparkSession.createDataFrame([(q,) for q in dict.fromkeys(queries)], "query string")
    found = postings.find(postings.build(docs, id_column, text_column), asked, k)
    return found.select("query", "rank", F.col("id").alias(id_column), F.col("text").alias(text_column), "place")
