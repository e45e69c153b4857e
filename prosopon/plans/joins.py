"""Queries over the enriching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosopon.functions import citations, nationality
from prosopon.operators import enrich, extract
from prosopon.plans import oracle, synth
from prosopon.plans.catalog import registrar
from prosopon.plans.synth import PROFILE
from prosopon.session import cut_lineage, new_folder
from prosopon.sinks import exports

CATALOG, query = registrar()


def _entries(spark, sf_dir):
    """slug, segment and balance of each entry, before any extraction."""
    return synth.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("entry-"), F.col("c_custkey").cast("string")).alias("slug"),
        F.col("c_custkey").cast("string").alias("k"), "c_mktsegment", "c_acctbal", "c_nationkey",
    )


def identifiers(spark, sf_dir):
    """Identifier table of the better-funded entries: plain, other environment, or a test identifier."""
    e = _entries(spark, sf_dir).where("c_acctbal > 4000")
    prefix = F.when(F.col("c_mktsegment") == "BUILDING", "10.5072/").otherwise("10.1234/")
    return e.select(
        "slug",
        F.concat(prefix, F.lit("v"), "k").alias("version_doi"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.concat(prefix, F.lit("c"), "k")).alias("concept_doi"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "sandbox").when(F.col("c_mktsegment") == "MACHINERY", "production").alias("env"),
    )


def sandbox_records(spark, sf_dir):
    e = _entries(spark, sf_dir).where("c_acctbal > 2000")
    number = F.col("k").cast("long")
    return e.select("slug", number.alias("record_id"), F.when(F.col("c_mktsegment") != "FURNITURE", number + 1000).alias("concept_rec_id"))


_CITE = (
    "cited AS (SELECT *, bal > 4000 AND seg NOT IN ('AUTOMOBILE', 'BUILDING') AS minted FROM fields), "
    "urls AS (SELECT *, CASE WHEN minted THEN '10.1234/v' || k END AS version_doi, CASE WHEN minted AND seg <> 'HOUSEHOLD' THEN '10.1234/c' || k END AS concept_doi, "
    "CASE WHEN minted THEN 'https://doi.org/10.1234/' || CASE seg WHEN 'HOUSEHOLD' THEN 'v' ELSE 'c' END || k "
    f"WHEN bal > 2000 THEN '{PROFILE.sandbox_record_base}' || CASE seg WHEN 'FURNITURE' THEN k ELSE (k::INT + 1000)::VARCHAR END END AS cite_url FROM cited)"
)


@query(oracle.people("SELECT doc_id AS slug, version_doi, concept_doi, cite_url, cite_url IS NOT NULL AND NOT minted AS cite_sandbox FROM urls", _CITE))
def identifier_links(spark, sf_dir):
    """Entries with their identifiers and the address to cite; test identifiers never reach production."""
    joined = enrich.with_identifiers(
        _entries(spark, sf_dir).select("slug"), identifiers(spark, sf_dir), sandbox_records(spark, sf_dir), "production", PROFILE
    )
    return joined.select("slug", "version_doi", "concept_doi", "cite_url", "cite_sandbox")


@query(
    oracle.people(
        "SELECT doc_id AS slug, CASE WHEN cite_url IS NOT NULL THEN coalesce(authors, '') || ', ''' || coalesce(last_name, '') || ', ' || coalesce(first_name, '') "
        f"|| ''' in {PROFILE.full_title}, edited by {PROFILE.edited_by}. ' || cite_url || CASE WHEN minted THEN '' ELSE ' (sandbox preview)' END END AS how_to_cite FROM urls",
        _CITE,
    )
)
def how_to_cite(spark, sf_dir):
    bios = synth.bios(spark, sf_dir).select(F.col("doc_id").alias("slug"), "authors", "last_name", "first_name")
    joined = enrich.with_identifiers(bios, identifiers(spark, sf_dir), sandbox_records(spark, sf_dir), "production", PROFILE)
    text = citations.how_to_cite(
        F.col("authors"), F.col("last_name"), F.col("first_name"), F.col("cite_url"), F.col("cite_sandbox"), PROFILE.full_title, PROFILE.edited_by
    )
    return joined.select("slug", text.alias("how_to_cite"))


@query(
    "SELECT seg AS segment, count(*) AS entries, count(*) FILTER (sandbox) AS sandboxed FROM (SELECT c_mktsegment AS seg, c_mktsegment = 'BUILDING' AS sandbox "
    "FROM customer WHERE c_acctbal > 4000) GROUP BY 1"
)
def sandbox_identifiers(spark, sf_dir):
    """How many identifiers carry the test prefix."""
    ids = identifiers(spark, sf_dir).join(_entries(spark, sf_dir), "slug")
    return ids.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("entries"), F.count_if(enrich.is_sandbox(F.col("version_doi"))).alias("sandboxed")
    )


_TERMS = ["tion", "Que", "the", "thet", "Le", "lent", "en", "Is"]
_SPOTS = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS ordinal, '{w}' AS term, instr(text, '{w}') AS spot FROM documents" for i, w in enumerate(_TERMS)
)


@query(
    f"SELECT doc_id, term, spot, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot, len(term) DESC, ordinal) AS n FROM ({_SPOTS}) WHERE spot > 0) WHERE n = 1"
)
def earliest_terms(spark, sf_dir):
    """First dictionary term in each whole document: earliest, then longest, by joins with a dictionary table."""
    terms = spark.createDataFrame([(i, w) for i, w in enumerate(_TERMS)], "ordinal int, term string")
    return enrich.earliest_mention(synth.read(spark, sf_dir, "documents"), "doc_id", "text", terms).select("doc_id", "term", F.col("at").alias("spot"), F.col("ordinal").cast("int").alias("ordinal"))


@query(
    "SELECT doc_id, term, spot FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot, len(term) DESC, ordinal) AS n "
    f"FROM ({_SPOTS}) WHERE spot > 0) WHERE n = 1"
)
def earliest_terms_in_one_pass(spark, sf_dir):
    """The same by one longest-first alternation, for dictionaries of bounded size: no join, no shuffle."""
    docs = synth.read(spark, sf_dir, "documents")
    found = docs.select("doc_id", "text", F.regexp_extract("text", nationality.alternation(_TERMS), 0).alias("term"))
    hit = found.where(F.col("term") != "")
    return hit.select("doc_id", "term", F.instr("text", F.col("term")).alias("spot"))


@query(
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 800 WHEN 'MACHINERY' THEN 1200 ELSE 0 END AS width, "
    "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1000 + c_nationkey ELSE 0 END AS height, nfc_normalize('é' || c_custkey || '.jpg') AS image FROM customer"
)
def portrait_lookup(spark, sf_dir):
    """Images found by normalised name: decomposed accents on one side, composed on the other."""
    c = synth.read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    crop, original = F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment") == "MACHINERY"
    entries = c.select(
        "c_custkey",
        F.concat(F.lit("é"), key, F.lit(".jpg")).alias("image_fn"),
        F.when(crop, F.concat(F.lit("é"), key, F.lit("-portrait.jpg"))).otherwise("").alias("image_portrait_fn"),
    )
    images = c.where(crop | original).select(
        F.concat(F.lit("assets/bios/é"), key, F.when(crop, "-portrait").otherwise(""), F.lit(".jpg")).alias("path"),
        F.when(crop, 800).otherwise(1200).alias("width"),
        (F.col("c_nationkey") + 1000).alias("height"),
    )
    joined = enrich.with_images(entries, images, "c_custkey")
    return joined.select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height")], enrich.nfc(F.col("image_fn")).alias("image"))


@query(
    oracle.people(
        "SELECT doc_id AS slug, CASE WHEN bal > 8000 THEN 'jpg' WHEN bal > 6000 THEN 'webp' WHEN has_photo THEN 'png' END AS active_extension, "
        "bal > 6000 AS overridden, bal <= 6000 AND has_photo AND seg = 'MACHINERY' AS converts FROM fields WHERE has_photo OR bal > 6000"
    )
)
def active_images(spark, sf_dir):
    """Override by extension order, else the extracted image."""
    shown = synth.bios(spark, sf_dir).select(F.col("doc_id").alias("slug"), F.col("image_attachment.extension").alias("extension"))
    e = _entries(spark, sf_dir)
    overrides = e.where("c_acctbal > 8000").select("slug", F.lit("jpg").alias("extension")).unionByName(
        e.where("c_acctbal > 6000").select("slug", F.lit("webp").alias("extension"))
    )
    return enrich.active_images(shown.where(F.col("extension").isNotNull()), overrides)


@query(oracle.people("SELECT doc_id, nationality, country FROM fields"))
def nationalities_by_join(spark, sf_dir):
    """Nationality of each summary by a dictionary table, joined."""
    summaries = synth.bios(spark, sf_dir).select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"))
    return enrich.nationalities_by_join(summaries, "doc_id", "summary", synth.demonyms(spark))


@query(oracle.people("SELECT doc_id, nationality, country FROM fields"))
def nationalities_by_dictionary(spark, sf_dir):
    """Nationality of each summary by a short list of forms."""
    summaries = synth.bios(spark, sf_dir).select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"))
    return enrich.nationalities(summaries, "doc_id", "summary", synth.FORMS)


@query(oracle.people("SELECT doc_id, last_name, nationality, country FROM fields"))
def biographies_by_dictionary(spark, sf_dir):
    """The whole extraction with a dictionary table in place of a list."""
    bios = extract.extract_all(synth.documents(spark, sf_dir), PROFILE, synth.demonyms(spark))
    return bios.select("doc_id", "last_name", "nationality", "country")


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, p_name || ' ' || p_partkey AS term FROM lineitem JOIN part ON l_partkey = p_partkey) "
    "SELECT l_orderkey, term FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, term || '-') AS n FROM t) WHERE n = 1"
)
def part_mentions(spark, sf_dir):
    """The first part that each order's text names, out of a dictionary of three terms per part, many of which begin alike."""
    part = synth.read(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    spelled = F.explode(F.array(name, F.upper(name), F.concat(F.lit("No. "), name))).alias("term")
    terms = part.select(F.col("p_partkey").alias("ordinal"), spelled)
    lines = synth.read(spark, sf_dir, "lineitem").join(part.select("p_partkey", name.alias("name")), F.col("l_partkey") == F.col("p_partkey"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("got "), "name", F.lit("-"), F.col("l_quantity").cast("string")).alias("said"))))
    texts = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["said"]), "; ").alias("text"))
    return enrich.first_mentions(texts, "l_orderkey", "text", terms).select("l_orderkey", "term")


def probes(spark, sf_dir):
    """Latest link probe results per image credit; what they answer depends on the segment."""
    segment = F.col("c_mktsegment")
    href = F.concat(F.lit("https://www.pics"), F.col("c_nationkey").cast("string"), F.lit(".example/p/"), "k", F.lit("?a=1&b=2"))
    answer = F.when(segment == "BUILDING", 200).when(segment == "FURNITURE", 404).when(segment == "HOUSEHOLD", 403)
    heads = _entries(spark, sf_dir).where(segment != "AUTOMOBILE").select(
        href.alias("href"), F.lit("HEAD").alias("method"), answer.alias("http_status"), (segment == "MACHINERY").alias("failed")
    )
    gets = _entries(spark, sf_dir).where(segment.isin("HOUSEHOLD", "MACHINERY")).select(
        href.alias("href"), F.lit("GET").alias("method"), F.when(segment == "HOUSEHOLD", 301).otherwise(404).alias("http_status"), F.lit(False).alias("failed")
    )
    return heads.unionByName(gets)


def _audited(spark, sf_dir):
    bios = synth.bios(spark, sf_dir).select(F.col("doc_id").alias("entry"), "image_source")
    links = bios.select(
        "entry", F.coalesce("image_source", F.lit("")).alias("full_text"),
        F.coalesce(F.replace(citations.image_credit(F.col("image_source"))["href"], F.lit("&"), F.lit("&amp;")), F.lit("")).alias("link"),
    )
    return enrich.link_audit(links, probes(spark, sf_dir))


_STATUS = "CASE WHEN NOT has_source THEN 'no link' WHEN seg IN ('BUILDING', 'HOUSEHOLD') THEN 'OK' WHEN seg IN ('FURNITURE', 'MACHINERY') THEN '404' ELSE 'ERROR' END"


@query(
    oracle.people(
        "SELECT doc_id AS entry, coalesce(image_source, '') AS full_text, CASE WHEN has_source THEN 'https://www.pics' || nk || '.example/p/' || k || '?a=1&amp;b=2' ELSE '' END AS link, "
        f"{_STATUS} AS status FROM fields"
    )
)
def link_statuses(spark, sf_dir):
    """Image links with their status: HEAD answer, GET as the fallback."""
    return _audited(spark, sf_dir)


@query(
    oracle.people(
        "SELECT count(*) FILTER (s = 'OK') AS ok, count(*) FILTER (s = '404') AS not_found, count(*) FILTER (s = 'ERROR') AS error, count(*) FILTER (s = 'no link') AS no_link "
        f"FROM (SELECT {_STATUS} AS s FROM fields)"
    )
)
def link_status_tally(spark, sf_dir):
    from prosopon.operators import audit

    return audit.link_tally(_audited(spark, sf_dir))


@query(
    oracle.people(f"SELECT doc_id AS entry, image_source AS full_text, {_STATUS} AS status FROM fields")
)
def link_audit_files(spark, sf_dir):
    """The audit written as quoted CSV and read again; empty cells come back as NULL."""
    folder = new_folder(spark, "audit")
    exports.write_csv_audit(cut_lineage(_audited(spark, sf_dir), "audited"), folder)
    back = spark.read.schema("entry string, full_text string, link string, status string").option("header", True)
    return back.option("escape", '"').option("lineSep", "\r\n").csv(folder).select("entry", "full_text", "status")


def credit_lines(spark, sf_dir):
    """A credit line per entry with orders of its own: who wrote it, and what else they are credited with."""
    p = synth.people(spark, sf_dir)
    entries = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("Lost, "), F.col("stem"))).otherwise(F.concat(F.col("upper_stem"), F.lit(", ")))
    line = F.concat(F.lit("  * Ada N"), F.col("c_nationkey").cast("string"), F.lit("  :muted[("), entries, F.lit(")] "))
    return p.select(F.when(F.col("c_acctbal") < 1000, F.concat(F.lit("See "), line)).otherwise(line).alias("line"))


_CREDITS = (
    "credits AS (SELECT 'Ada N' || nk AS name, unnest(CASE seg WHEN 'MACHINERY' THEN ['Lost', stem] ELSE [up] END) AS entry FROM fields WHERE bal >= 1000)"
)


@query(oracle.people("SELECT name, count(*) AS attributions, count(DISTINCT entry) AS entries FROM credits GROUP BY name", _CREDITS))
def contributor_productivity(spark, sf_dir):
    from prosopon.operators import audit

    return audit.contributor_productivity(enrich.attributions(credit_lines(spark, sf_dir)))


@query(oracle.people("SELECT entry, count(DISTINCT name) AS contributors FROM credits GROUP BY entry", _CREDITS))
def contributors_per_entry(spark, sf_dir):
    from prosopon.operators import audit

    return audit.contributors_per_entry(enrich.attributions(credit_lines(spark, sf_dir)))


@query(
    oracle.people(
        "SELECT surname, coalesce(e, 0) AS entries, first_slug, coalesce(c, 0) AS credits, first_name, CASE WHEN c IS NULL THEN 'uncredited' WHEN e IS NULL THEN 'unmatched' ELSE 'credited' END AS state "
        "FROM (SELECT coalesce(replace(replace(upper(strip_accents(last_name)), '’', ' '), '-', ' '), NULL) AS surname, count(*) AS e, min(doc_id) AS first_slug FROM fields WHERE named GROUP BY 1) "
        "FULL JOIN (SELECT upper(entry) AS surname, count(*) AS c, min(name) AS first_name FROM credits GROUP BY 1) USING (surname)",
        _CREDITS,
    )
)
def attribution_audit(spark, sf_dir):
    """Entries nobody is credited with, and credits that match no entry."""
    entries = synth.bios(spark, sf_dir).select(F.col("doc_id").alias("slug"), "last_name").where(F.col("last_name").isNotNull())
    return enrich.attribution_audit(entries, enrich.attributions(credit_lines(spark, sf_dir)))


@query(
    "SELECT 'found' AS state, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) "
    "UNION ALL SELECT 'absent', count(*) FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
)
def allow_list(spark, sf_dir):
    """Rows on an allow-list, and list members that have no row."""
    wanted = synth.read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("slug"))
    orders = synth.read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "slug")
    found, _ = enrich.only(orders, wanted)
    _, absent = enrich.only(orders.where("o_orderstatus = 'P'"), wanted)
    n = F.count("*").alias("n")
    return found.agg(n).select(F.lit("found").alias("state"), "n").unionByName(absent.agg(n).select(F.lit("absent").alias("state"), "n"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE substr(o_orderpriority, 1, 1)::DOUBLE END AS subject FROM orders"
)
def subject_overrides(spark, sf_dir):
    """Numbers kept as text, checked on the way in: at least 1, finite, no comment keys."""
    orders = synth.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("slug"), "o_orderkey", "o_orderpriority")
    number = F.substring("o_orderpriority", 1, 1)
    urgent = F.col("o_orderpriority").startswith("5")
    overrides = orders.select("slug", F.when(urgent, "0.5 and more").otherwise(F.concat(F.lit(" "), number)).alias("subject_index"))
    noise = orders.select(F.concat(F.lit("_"), "slug").alias("slug"), F.lit("3").alias("subject_index"))
    return enrich.with_overrides(orders, overrides.unionByName(noise)).select("o_orderkey", "subject")
