"""Deposit metadata of an entry; optional fields stay NULL, which `to_json` leaves out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions import citations, names
from prosopon.functions import text as t
from prosopon.profile import Profile


def entry_url(slug: Column, profile: Profile) -> Column:
    return F.concat(F.lit(profile.entry_base), slug)


def description(summary: Column, life: Column, profile: Profile) -> Column:
    return F.array_join(t.non_empty(summary, life, F.lit(profile.provenance)), " ")


def keywords(nationality: Column, roles: Column, profile: Profile) -> Column:
    """Nationality, titles, abbreviations, organisations and the constant ones: distinct, in that order."""
    words = F.concat(
        F.array(nationality),
        *[_field(roles, k) for k in ("title", "abbreviation", "organisation")],
        F.array(*map(F.lit, profile.constant_keywords)),
    )
    return F.array_distinct(F.filter(F.transform(words, lambda w: t.strip(t.or_empty(w))), lambda w: w != ""))


def _field(roles: Column, name: str) -> Column:
    return F.transform(roles, lambda r: r[name])


def notes(slug: Column, profile: Profile) -> Column:
    return F.array_join(
        t.non_empty(F.concat(F.lit("Canonical entry: "), entry_url(slug, profile)), F.lit(profile.rights_note)), "\n\n"
    )


def related_identifiers(slug: Column, profile: Profile) -> Column:
    def one(identifier: Column, relation: str) -> Column:
        return F.struct(identifier.alias("identifier"), F.lit(relation).alias("relation"), F.lit("url").alias("scheme"))

    return F.array(one(F.lit(profile.home_url), "isPartOf"), one(entry_url(slug, profile), "isVariantFormOf"))


def _optional(value: str) -> Column:
    return F.lit(value or None).cast("string")


def _editors(profile: Profile) -> Column:
    if not profile.editors:
        return F.lit(None).cast("array<struct<name:string,type:string,affiliation:string,orcid:string>>")
    return F.array(
        *[
            F.struct(
                F.lit(e.name).alias("name"), F.lit(e.type).alias("type"),
                _optional(e.affiliation).alias("affiliation"), _optional(e.orcid).alias("orcid"),
            )
            for e in profile.editors
        ]
    )


def deposit_metadata(profile: Profile, today: str) -> Column:
    """The metadata struct for a feed row (slug, first_name, last_name, summary, life, version, authors,
    nationality, roles). `today` (ISO) stands in when the version has no date."""
    c = F.col
    creators = F.transform(
        citations.author_list(c("authors"), profile.dictionary), lambda a: F.struct(a.alias("name"))
    )
    return F.struct(
        F.lit("publication").alias("upload_type"),
        F.lit(profile.publication_type).alias("publication_type"),
        names.deposit_title(c("first_name"), c("last_name")).alias("title"),
        creators.alias("creators"),
        _editors(profile).alias("contributors"),
        description(c("summary"), c("life"), profile).alias("description"),
        F.coalesce(citations.publication_date(c("version")), F.lit(today)).alias("publication_date"),
        t.empty_to_null(citations.version_label(c("version"))).alias("version"),
        F.lit("open").alias("access_right"),
        F.lit(profile.license).alias("license"),
        _optional(profile.full_title).alias("partof_title"),
        _optional(profile.publisher).alias("imprint_publisher"),
        _optional(profile.place).alias("imprint_place"),
        related_identifiers(c("slug"), profile).alias("related_identifiers"),
        keywords(c("nationality"), c("roles"), profile).alias("keywords"),
        notes(c("slug"), profile).alias("notes"),
        F.lit("eng").alias("language"),
    )


def artifact_name(slug: Column, profile: Profile) -> Column:
    return F.concat(slug, F.lit(f"{profile.deposit_suffix}.pdf"))


def record_id(url: Column) -> Column:
    """Trailing number of a `.../depositions/<id>` address, NULL when there is none."""
    return t.empty_to_null(F.regexp_extract(url, r"depositions/(\d+)", 1)).cast("long")
