"""Content signatures over canonical JSON (explicit field order, missing values as empty text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosopon.functions.text import or_empty


def sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def canonical_roles(roles: Column) -> Column:
    kept = F.transform(roles, lambda r: F.struct(*[or_empty(r[k]).alias(k) for k in ("title", "abbreviation", "organisation")]))
    return F.coalesce(kept, F.array().cast("array<struct<title:string,abbreviation:string,organisation:string>>"))


def content_json(html: Column, summary: Column, life: Column, version: Column, authors: Column, nationality: Column, roles: Column) -> Column:
    named = zip(("html", "summary", "life", "version", "authors", "nationality"), (html, summary, life, version, authors, nationality))
    return F.to_json(F.struct(*[or_empty(c).alias(k) for k, c in named], canonical_roles(roles).alias("roles")))


def content_hash(**fields: Column) -> Column:
    return sha(content_json(**fields))


def state_hash(content: Column, license: str, publication_type: str, render_version: str = "") -> Column:
    """Content signature plus the settings that change what is published.

    The render version takes part only when given: a permanent deposit must not change for a cosmetic reason.
    """
    knobs = [content.alias("content"), F.lit(license).alias("license"), F.lit(publication_type).alias("publication_type")]
    if render_version:
        knobs.append(F.lit(render_version).alias("render"))
    return sha(F.to_json(F.struct(*knobs)))


def ordered_set_fingerprint(files: Column) -> Column:
    """16 hex digits over `path NUL content NUL` in path order, for an array<struct<path,content>> in one row."""
    ordered = F.transform(F.array_sort(files), lambda f: F.concat(f["path"], F.lit("\0"), f["content"], F.lit("\0")))
    return F.substring(F.sha2(F.array_join(ordered, ""), 256), 1, 16)


def crop_signature(image: Column, subject: Column, cache_version: str) -> Column:
    """Digest of the active image, the subject override and the cache version."""
    return F.concat(F.sha2(image, 256), F.lit(":"), or_empty(subject.cast("string")), F.lit(f":v{cache_version}"))
