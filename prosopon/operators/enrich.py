"""Joins that enrich entries: identifiers, images, overrides, link checks, attributions, dictionary terms.

Most sides here have no fixed size (state, identifiers and images grow with the corpus), so their joins
carry no broadcast hint: Spark broadcasts by measured size and splits skewed partitions otherwise. Only what is bounded
of a dictionary's terms, their beginnings and bits, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prosopon.functions import citations
from prosopon.functions import text as t
from prosopon.functions.nationality import as_written, nationality
from prosopon.profile import Profile
from prosopon.session import cut_lineage

#: Letters of a term by which texts are searched for it first; pairs of beginning and length of a term up to which so many letters count.
HEAD, MOST_HEADS = 4, 1 << 18
#: Bits that tell strings which are no term: so many a term, and so many in all.
TERM_BITS, MOST_BITS = 16, 1 << 27
# Fixed value: prefix of test identifiers.
SANDBOX_PREFIX = "10.5072/"
# Order in which override images are looked for.
OVERRIDE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif")
# Image formats that are published as they are.
WEB_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "svg")


@F.pandas_udf(StringType())
def nfc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC; Spark has no built-in for it."""
    for series in values:
        yield series.str.normalize("NFC")


def is_sandbox(identifier: Column) -> Column:
    return F.coalesce(F.startswith(identifier, F.lit(SANDBOX_PREFIX)), F.lit(False))


def with_identifiers(entries: DataFrame, identifiers: DataFrame, sandbox: DataFrame, env: str, profile: Profile, key: str = "slug") -> DataFrame:
    """Adds version_doi, concept_doi, cite_url and cite_sandbox.

    `identifiers` (slug, version_doi, concept_doi, env) counts only for its own environment, and a test
    identifier never gets into production. The link prefers concept over version over the sandbox record.
    """
    if env not in ("production", "sandbox"):
        raise ValueError("env must be production or sandbox")
    fits = F.col("env").isNull() | (F.col("env") == "") | (F.col("env") == env)
    usable = identifiers.where(fits)
    if env == "production":
        usable = usable.where(~is_sandbox(F.col("version_doi")) & ~is_sandbox(F.col("concept_doi")))
    usable = usable.select(key, t.empty_to_null(F.col("version_doi")).alias("version_doi"), t.empty_to_null(F.col("concept_doi")).alias("concept_doi"))
    records = sandbox.select(key, F.coalesce("concept_rec_id", "record_id").cast("string").alias("_record"))
    permanent = F.coalesce(*[F.when(~is_sandbox(F.col(c)), F.col(c)) for c in ("concept_doi", "version_doi")])
    return (
        entries.join(usable, key, "left")
        .join(records, key, "left")
        .withColumn("_doi", permanent)
        .withColumn(
            "cite_url",
            F.when(F.col("_doi").isNotNull(), F.concat(F.lit("https://doi.org/"), "_doi")).when(
                F.col("_record").isNotNull(), F.concat(F.lit(profile.sandbox_record_base), "_record")
            ),
        )
        .withColumn("cite_sandbox", F.col("cite_url").isNotNull() & F.col("_doi").isNull())
        .drop("_doi", "_record")
    )


def _in_class(letters: list[str]) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in letters) + "]"


def _marks(c: Column, bits: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """(part, [(number, bit)] * 2): the two of `bits` bits that stand for a string. A part has 2^16 bits, 64 to a number, and both bits of a string."""
    h = F.xxhash64(c)
    at = [(F.shiftrightunsigned(h, n).bitwiseAND(1023).cast("int"), F.shiftrightunsigned(h, n + 10).bitwiseAND(63).cast("int")) for n in (0, 16)]
    return F.shiftrightunsigned(h, 32).bitwiseAND((bits >> 16) - 1), at


def _marked(words: DataFrame, bits: int) -> DataFrame:
    """(part, numbers): the bits of all terms, set."""
    part, at = _marks(F.col("term"), bits)
    mark = F.explode(F.array(*[F.struct(n.alias("n"), F.call_function("shiftleft", F.expr("1L"), b).alias("mark")) for n, b in at])).alias("m")
    every = words.sparkSession.range(bits >> 6).select(F.shiftright("id", 10).alias("part"), F.col("id").bitwiseAND(1023).cast("int").alias("n"), F.expr("0L").alias("mark"))
    numbers = words.select(part.alias("part"), mark).select("part", "m.n", "m.mark").unionByName(every).groupBy("part", "n").agg(F.bit_or("mark").alias("mark"))
    return numbers.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "mark"))), lambda x: x["mark"]).alias("numbers"))


def first_mentions(texts: DataFrame, id_column: str, text_column: str, terms: DataFrame) -> DataFrame:
    """(id, term, ordinal, value) of the texts in which a term occurs: earliest position, then longest, then dictionary order. Ids are unique.

    `terms` is (ordinal, term) or (ordinal, term, value), of any size. Its beginnings of up to HEAD letters are a table of their own, with the lengths
    that terms of that beginning have; of fewer letters, where that table would pass MOST_HEADS. A text gives its different stretches that start with a term's
    first letter, as long as the longest term, in order of appearance; those whose beginning the table knows are cut to its lengths. What none of
    the terms' bits stands for is no term; the rest is met with the terms on equal strings. Beginnings and bits are bounded (MOST_HEADS, MOST_BITS) and
    broadcast, so that stretches are not shuffled, whatever size Spark takes the tables for. The driver gets the first letters and a few numbers.
    A text's mentions are reduced to the best before they are shuffled by text.
    """
    valued = terms if "value" in terms.columns else terms.withColumn("value", F.lit(None).cast("string"))
    words = valued.where(t.or_empty(F.col("term")) != "").groupBy("term").agg(F.min_by(F.struct("ordinal", "value"), "ordinal").alias("v"))
    words = cut_lineage(words.select("term", "v.ordinal", "v.value"), "terms")
    length, letters = F.length("term"), range(1, HEAD + 1)
    heads_of = [F.approx_count_distinct(F.struct(F.substring("term", 1, n), length)).alias(f"heads_{n}") for n in letters]
    bounds = words.agg(F.count("*").alias("terms"), F.max(length).alias("longest"), F.collect_set(F.least(length, F.lit(HEAD))).alias("levels"), F.collect_set(F.substring("term", 1, 1)).alias("letters"), *heads_of).first()
    if not bounds.letters:
        return texts.select(F.col(id_column), F.lit("").alias("term"), F.lit(0).alias("ordinal"), F.lit("").alias("value")).limit(0)
    most = max(n for n in letters if n == 1 or bounds[f"heads_{n}"] <= MOST_HEADS)
    starts = rf"(?s)(?=({_in_class(sorted(bounds.letters))}.{{0,{bounds.longest - 1}}}))"
    stretches = F.array_distinct(F.regexp_extract_all(F.col(text_column), F.lit(starts), F.lit(1)))
    begun = texts.select(F.col(id_column).alias("id"), F.posexplode(stretches).alias("nth", "rest"))
    levels = F.explode(F.array_distinct(F.array(*[F.substring("rest", 1, n) for n in sorted({min(x, most) for x in bounds.levels})]))).alias("begin")
    heads = words.groupBy(F.substring("term", 1, most).alias("head")).agg(F.array_sort(F.collect_set(length)).alias("lengths"))
    met = begun.select("id", "nth", "rest", levels).join(F.broadcast(heads), F.col("begin") == F.col("head")).where(F.col("rest").isNotNull())
    cut = met.select("id", "nth", F.explode("lengths").alias("n"), "rest").where(F.length("rest") >= F.col("n"))
    bits = 1 << min(max(TERM_BITS * bounds.terms, 1 << 16) - 1, MOST_BITS - 1).bit_length()
    part, at = _marks(F.col("word"), bits)
    known = (F.col("part") == part) & reduce(and_, [F.getbit(F.get("numbers", n), b) == 1 for n, b in at])
    likely = cut.select("id", "nth", F.expr("substring(rest, 1, n)").alias("word")).join(F.broadcast(_marked(words, bits)), known).select("id", "nth", "word")
    hits = likely.join(words, F.col("word") == F.col("term"))
    best = hits.groupBy("id").agg(F.min_by(F.struct("term", "ordinal", "value"), F.struct("nth", -F.length("term"), "ordinal")).alias("m"))
    return best.select(F.col("id").alias(id_column), "m.term", "m.ordinal", "m.value")


def earliest_mention(texts: DataFrame, id_column: str, text_column: str, terms: DataFrame) -> DataFrame:
    """(id, term, at, ordinal) of the texts in which a term occurs; see `first_mentions`."""
    found = first_mentions(texts, id_column, text_column, terms).select(F.col(id_column).alias("_id"), "term", "ordinal")
    met = found.join(texts.select(id_column, text_column), F.col("_id") == F.col(id_column))
    return met.select(id_column, "term", F.instr(text_column, F.col("term")).alias("at"), "ordinal")


def demonym_terms(demonyms: DataFrame) -> DataFrame:
    """Terms (ordinal, term, value) out of a table of demonyms: UN members, feminine before masculine form."""
    members = demonyms.where(F.col("un_member"))
    return members.select((F.col("ordinal") * 2 + (F.col("form") == "m").cast("int")).alias("ordinal"), F.col("demonym").alias("term"), F.col("country").alias("value"))


def with_origin(table: DataFrame, id_column: str, text_column: str, demonyms: DataFrame) -> DataFrame:
    """`table` with `origin`, struct(nationality as written, country), by a dictionary table of any size; both NULL where no demonym occurs."""
    found = first_mentions(table, id_column, text_column, demonym_terms(demonyms)).select(F.col(id_column).alias("_id"), F.col("term").alias("_term"), F.col("value").alias("_value"))
    origin = F.struct(as_written(F.col(text_column), F.col("_term")).alias("nationality"), F.col("_value").alias("country"))
    return table.join(found, F.col(id_column) == F.col("_id"), "left").withColumn("origin", origin).drop("_id", "_term", "_value")


def nationalities(texts: DataFrame, id_column: str, text_column: str, forms: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, nationality, country) of each text, NULL where no demonym occurs, by a short list of (demonym, country): one alternation, no join."""
    origin = nationality(F.col(text_column), forms)
    return texts.select(id_column, origin.alias("o")).select(id_column, "o.nationality", "o.country")


def nationalities_by_join(texts: DataFrame, id_column: str, text_column: str, demonyms: DataFrame) -> DataFrame:
    """The same rows from a dictionary table of any size."""
    return with_origin(texts.select(id_column, text_column), id_column, text_column, demonyms).select(id_column, "origin.nationality", "origin.country")


def with_images(entries: DataFrame, images: DataFrame, key: str = "slug") -> DataFrame:
    """Image dimensions by NFC base name, the portrait crop before the original.

    `entries` has image_fn and image_portrait_fn; `images` is (path, width, height).
    """
    base = F.element_at(F.split(F.col("path"), "/"), -1)
    known = images.select(nfc(base).alias("_name"), "width", "height")
    wanted = F.coalesce(t.empty_to_null(F.col("image_portrait_fn")), t.empty_to_null(F.col("image_fn")))
    # Entries without an image get a key of their own, so that they do not all meet in one partition.
    own = F.concat(F.lit("\0"), F.col(key).cast("string"))
    return entries.withColumn("_name", F.coalesce(nfc(wanted), own)).join(known, "_name", "left").drop("_name")


def active_images(extracted: DataFrame, overrides: DataFrame, key: str = "slug") -> DataFrame:
    """One image per entry: the override with the first extension in the fixed order, else the extracted one.

    Both tables are (slug, extension). `converts` marks extracted formats that a browser cannot show.
    """
    rank = F.array_position(F.array(*map(F.lit, OVERRIDE_EXTENSIONS)), F.col("extension"))
    best = (
        overrides.where(rank > 0).groupBy(key).agg(F.min_by("extension", rank).alias("override_extension"))
    )
    joined = extracted.select(key, F.lower("extension").alias("extension")).join(best, key, "full")
    web = F.col("extension").isin(list(WEB_EXTENSIONS))
    return joined.select(
        key,
        F.coalesce("override_extension", F.when(web, F.col("extension")).otherwise(F.when(F.col("extension").isNotNull(), "png"))).alias("active_extension"),
        F.col("override_extension").isNotNull().alias("overridden"),
        (F.col("override_extension").isNull() & F.coalesce(~web, F.lit(False))).alias("converts"),
    )


def link_audit(links: DataFrame, probes: DataFrame) -> DataFrame:
    """Status of each link from probe results: HEAD first, GET when HEAD settles nothing.

    `links` is (entry, full_text, link); `probes` is (href, method, http_status, failed), latest result each.
    """
    answer = F.when(~F.col("failed"), citations.http_verdict(F.col("http_status")))
    verdicts = probes.groupBy(F.col("href").alias("_href")).agg(*[F.max(F.when(F.col("method") == m, answer)).alias(f"_{m.lower()}") for m in ("HEAD", "GET")])
    # Entries without a link get a key of their own, so that they do not all meet in one partition.
    own = F.concat(F.lit("\0"), F.col("entry"))
    audited = links.withColumn(
        "_href", F.when(t.or_empty(F.col("link")) == "", own).otherwise(t.decode_ampersand(F.col("link")))
    )
    audited = audited.join(verdicts, "_href", "left")
    status = F.when(t.or_empty(F.col("link")) == "", "no link").otherwise(F.coalesce("_head", "_get", F.lit("ERROR")))
    return audited.withColumn("status", status).drop("_href", "_head", "_get")


def surname_key(c: Column) -> Column:
    """Upper case without accents, brackets or punctuation, for matching credits to entries."""
    return F.upper(t.strip(t.squash(F.regexp_replace(t.fold_accents(c), r"[\p{P}]", " "))))


def attributions(lines: DataFrame) -> DataFrame:
    """(name, entry) pairs out of credit lines."""
    parsed = lines.select(citations.credit_line(F.col("line")).alias("c"))
    return parsed.select(F.col("c.name").alias("name"), F.explode_outer("c.entries").alias("entry")).where(
        F.col("entry").isNotNull()
    )


def attribution_audit(entries: DataFrame, credits: DataFrame) -> DataFrame:
    """Entries without credit and credits without entry; `entries` is (slug, last_name), `credits` (name, entry).

    Both sides are brought to one row per surname before they meet, so a surname that many share does not
    multiply.
    """
    held = entries.groupBy(surname_key(F.col("last_name")).alias("surname")).agg(
        F.count("*").alias("entries"), F.min("slug").alias("first_slug")
    )
    named = credits.groupBy(surname_key(F.col("entry")).alias("surname")).agg(
        F.count("*").alias("credits"), F.min("name").alias("first_name")
    )
    state = F.when(F.col("credits").isNull(), "uncredited").when(F.col("entries").isNull(), "unmatched").otherwise("credited")
    met = held.join(named, "surname", "full").withColumn("state", state)
    return met.na.fill(0, ["entries", "credits"])


def only(entries: DataFrame, wanted: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """(entries on the allow-list, list members without an entry)."""
    return entries.join(wanted, key, "left_semi"), wanted.join(entries, key, "left_anti")


def with_overrides(entries: DataFrame, overrides: DataFrame, key: str = "slug") -> DataFrame:
    """Numeric overrides (text on purpose): finite and at least 1, keys starting with `_` ignored."""
    number = F.expr("try_cast(subject_index AS double)")
    valid = overrides.where(~F.startswith(F.col(key), F.lit("_"))).withColumn("_n", number)
    valid = valid.where((F.col("_n") >= 1) & ~F.isnan("_n") & (F.col("_n") < float("inf")))
    return entries.join(valid.select(key, F.col("_n").alias("subject")), key, "left")
