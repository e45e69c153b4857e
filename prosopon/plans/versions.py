"""Queries over fingerprints, plans, state, synchronisation and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosopon.functions import citations, fingerprints, metadata
from prosopon.operators import ordering, versioning
from prosopon.plans import oracle, synth
from prosopon.plans.catalog import registrar
from prosopon.plans.synth import PROFILE
from prosopon.session import new_folder
from prosopon.sinks import exports
from prosopon.sources import keyvalue

CATALOG, query = registrar()

TODAY = "2024-01-01"
_FEED_CTES = (oracle.roles_json(), oracle.content_hash_cte())
_STATE = f"'sha256:' || sha256('{{\"content\":\"' || content_hash || '\",\"license\":\"{PROFILE.license}\",\"publication_type\":\"section\"}}')"


def feed(spark, sf_dir):
    return versioning.entry_feed(synth.bios(spark, sf_dir))


# --- feed and metadata ----------------------------------------------------------------------------------


@query(
    oracle.people(
        "SELECT doc_id AS slug, coalesce(first_name, '') AS first_name, coalesce(last_name, '') AS last_name, coalesce(summary, '') AS summary, coalesce(life, '') AS life, "
        "coalesce(version, '') AS version, coalesce(authors, '') AS authors, coalesce(nationality, '') AS nationality, coalesce(roles_text, '[]') AS roles, content_hash FROM hashed",
        *_FEED_CTES,
    )
)
def entry_feed(spark, sf_dir):
    """The metadata feed with content hashes; roles as canonical JSON."""
    return feed(spark, sf_dir).withColumn("roles", F.to_json("roles"))


@query(oracle.people(f"SELECT doc_id AS slug, content_hash, {_STATE} AS state_hash FROM hashed", *_FEED_CTES))
def content_hashes(spark, sf_dir):
    state = fingerprints.state_hash(F.col("content_hash"), PROFILE.license, PROFILE.publication_type)
    return feed(spark, sf_dir).select("slug", "content_hash", state.alias("state_hash"))


_KEYWORDS = (
    "kw AS (SELECT f.doc_id, list_filter(list_concat([coalesce(nationality, '')], CASE WHEN has_roles THEN list_concat("
    "list_filter([CASE WHEN F_n > 0 THEN 'Secretary-General' END, CASE WHEN O_n > 0 THEN 'Director' END, CASE WHEN P_n > 0 THEN 'United Nations High Commissioner for Refugees' END], lambda x: x IS NOT NULL), "
    "list_filter([CASE WHEN F_n > 0 THEN 'OAS' END, CASE WHEN O_n > 0 THEN 'UN EC' END, CASE WHEN P_n > 0 THEN 'UNHCR' END], lambda x: x IS NOT NULL), "
    "list_filter([CASE WHEN F_n > 0 THEN 'Organisation of ' || region || ' States' END, CASE WHEN O_n > 0 THEN region || ' Commission Secretariat' END, "
    "CASE WHEN P_n > 0 THEN 'Office of the United Nations High Commissioner for Refugees' END], lambda x: x IS NOT NULL)) ELSE [] END, "
    "CASE WHEN has_roles AND F_n > 0 THEN ['biography', 'international organization'] ELSE ['biography', 'Secretary-General', 'international organization'] END), lambda x: x <> '') AS words FROM fields f)"
)


@query(
    oracle.people(
        "SELECT f.doc_id AS slug, CASE WHEN named THEN upper(last_name) || ', ' || first_name ELSE '' END AS title, "
        f"concat_ws(' ', summary, life, '{PROFILE.provenance}') AS description, array_to_string(words, '|') AS keywords, "
        f"'Canonical entry: {PROFILE.entry_base}' || f.doc_id || chr(10) || chr(10) || '{PROFILE.rights_note}' AS notes, "
        f"CASE WHEN NOT has_version THEN '{TODAY}' WHEN seg = 'MACHINERY' THEN year(last_order) || '-01-01' WHEN seg = 'HOUSEHOLD' THEN '2019-02-31' ELSE strftime(last_order, '%Y-%m-%d') END AS publication_date, "
        "CASE WHEN has_version THEN substr(version, 9) END AS version, "
        f"'[{{\"identifier\":\"{PROFILE.home_url}\",\"relation\":\"isPartOf\",\"scheme\":\"url\"}},{{\"identifier\":\"{PROFILE.entry_base}' || f.doc_id || '\",\"relation\":\"isVariantFormOf\",\"scheme\":\"url\"}}]' AS related, "
        f"f.doc_id || '{PROFILE.deposit_suffix}.pdf' AS artifact FROM fields f JOIN kw ON f.doc_id = kw.doc_id",
        _KEYWORDS,
    )
)
def deposit_metadata(spark, sf_dir):
    m = F.col("m")
    built = feed(spark, sf_dir).select("slug", metadata.deposit_metadata(PROFILE, TODAY).alias("m"))
    return built.select(
        "slug", m["title"].alias("title"), m["description"].alias("description"), F.array_join(m["keywords"], "|").alias("keywords"),
        m["notes"].alias("notes"), m["publication_date"].alias("publication_date"), m["version"].alias("version"),
        F.to_json(m["related_identifiers"]).alias("related"), metadata.artifact_name(F.col("slug"), PROFILE).alias("artifact"),
    )


@query(
    oracle.people(
        f"SELECT doc_id AS slug, has_version AS names_version, named AS has_title, '{PROFILE.license}' AS license, "
        "CASE WHEN NOT has_citation THEN 1 WHEN seg = 'BUILDING' THEN 2 WHEN seg = 'FURNITURE' THEN 3 ELSE 1 END AS creators FROM fields"
    )
)
def deposit_json(spark, sf_dir):
    """The metadata as JSON lines: optional fields are left out when they are empty."""
    text = feed(spark, sf_dir).select("slug", F.to_json(metadata.deposit_metadata(PROFILE, TODAY)).alias("j"))
    return text.select(
        "slug", F.get_json_object("j", "$.version").isNotNull().alias("names_version"),
        (F.get_json_object("j", "$.title") != "").alias("has_title"), F.get_json_object("j", "$.license").alias("license"),
        F.json_array_length(F.get_json_object("j", "$.creators")).alias("creators"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey ELSE -1 END AS record_id FROM orders")
def record_ids(spark, sf_dir):
    """Record numbers out of deposit addresses."""
    tail = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("depositions/"), F.col("o_custkey").cast("string"))).otherwise("records")
    url = F.concat(F.lit("https://deposit.example/api/deposit/"), tail)
    return synth.read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(metadata.record_id(url), F.lit(-1)).alias("record_id"))


@query(
    oracle.people(
        "SELECT doc_id AS slug, coalesce(last_name, '') AS last_name, coalesce(roles_text, '[]') AS roles, content_hash FROM hashed", *_FEED_CTES
    )
)
def feed_files(spark, sf_dir):
    """The feed written as sorted JSON lines and read again."""
    folder = new_folder(spark, "feed")
    exports.write_feed(feed(spark, sf_dir), folder)
    return keyvalue.read_feed(spark, folder).select("slug", "last_name", F.to_json("roles").alias("roles"), "content_hash")


@query(oracle.people("SELECT doc_id AS id, summary, sha256(html) AS digest FROM pages_of"))
def stored_entries(spark, sf_dir):
    """The keyed entry table written and read again."""
    folder = new_folder(spark, "entries")
    bios = synth.bios(spark, sf_dir).withColumnRenamed("doc_id", "id").withColumn("digest", F.sha2("html", 256))
    exports.write_store(bios, folder)
    return spark.read.schema("id string, summary string, digest string").parquet(folder)


# --- plans over the document table: labelled documents are the ones already published --------------------


def document_feed(spark, sf_dir):
    d = synth.read(spark, sf_dir, "documents")
    signature = fingerprints.sha(F.to_json(F.struct("text", "lang", "source")))
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), "doc_id", "lang", "source", signature.alias("content_hash"))


def document_state(spark, sf_dir):
    """State rows of the labelled documents; a low-quality label means that the text has changed since."""
    entries = document_feed(spark, sf_dir).join(synth.read(spark, sf_dir, "labels"), "doc_id")
    current = fingerprints.state_hash(F.col("content_hash"), PROFILE.license, PROFILE.publication_type)
    return entries.select(
        "slug", F.col("doc_id").alias("record_id"), F.col("doc_id").alias("concept_rec_id"),
        F.concat(F.lit("10.1234/c"), F.col("doc_id").cast("string")).alias("concept_doi"),
        F.concat(F.lit("10.1234/v"), F.col("doc_id").cast("string")).alias("version_doi"),
        F.when(F.col("quality") == 1, current).otherwise("sha256:earlier").alias("content_hash"),
        F.lit("published").alias("status"), F.lit("1").alias("version"),
        F.lit("2020-01-01 00:00:00").cast("timestamp").alias("minted_at"), F.lit("sandbox").alias("env"), "quality", "toxic",
    )


_DOC_HASH = "'sha256:' || sha256(to_json({'text': text, 'lang': lang, 'source': source}))"
_DOC_STATE = f"'sha256:' || sha256('{{\"content\":\"' || {_DOC_HASH} || '\",\"license\":\"{PROFILE.license}\",\"publication_type\":\"section\"}}')"
_ACTION = "CASE WHEN l.doc_id IS NULL THEN 'create' WHEN quality = 0 THEN 'newversion' ELSE 'skip' END"
_DOCS = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(
    f"SELECT 'doc-' || d.doc_id AS slug, {_ACTION} AS action FROM {_DOCS} WHERE d.lang = 'en' "
    "UNION ALL SELECT 'lost-' || doc_id, 'not found' FROM labels WHERE toxic = 1"
)
def chosen_plan(spark, sf_dir):
    """A plan for entries chosen by a table, with the chosen ones that do not exist."""
    feed, lost = document_feed(spark, sf_dir), synth.read(spark, sf_dir, "labels").where("toxic = 1")
    only = feed.where("lang = 'en'").select("slug").union(lost.select(F.concat(F.lit("lost-"), F.col("doc_id").cast("string"))))
    plan = versioning.version_plan(feed, document_state(spark, sf_dir), PROFILE, only=only).select("slug", "action")
    return plan.union(versioning.not_found(feed, only).select("slug", F.lit("not found")))


_FIRST = 25


@query(f"SELECT 'doc-' || d.doc_id AS slug, {_ACTION} AS action FROM {_DOCS} ORDER BY 'doc-' || d.doc_id LIMIT {_FIRST}")
def limited_plan(spark, sf_dir):
    """A plan for the first entries of the feed only (the limit is the feature)."""
    plan = versioning.version_plan(document_feed(spark, sf_dir), document_state(spark, sf_dir), PROFILE, limit=_FIRST)
    return plan.select("slug", "action")


@query(f"SELECT 'doc-' || d.doc_id AS slug, {_DOC_STATE} AS state_hash, {_ACTION} AS action FROM {_DOCS}")
def version_plan(spark, sf_dir):
    plan = versioning.version_plan(document_feed(spark, sf_dir), document_state(spark, sf_dir), PROFILE)
    return plan.select("slug", "state_hash", "action")


@query(
    f"SELECT lang, count(*) FILTER (a = 'create') AS \"create\", count(*) FILTER (a = 'newversion') AS newversion, count(*) FILTER (a = 'skip') AS skip FROM (SELECT lang, {_ACTION} AS a FROM {_DOCS}) GROUP BY lang"
)
def plan_tally_by_language(spark, sf_dir):
    plan = versioning.version_plan(document_feed(spark, sf_dir), document_state(spark, sf_dir), PROFILE)
    return plan.groupBy("lang").pivot("action", list(versioning.ACTIONS)).count().na.fill(0)


@query(f"SELECT count(*) FILTER (a = 'create') AS \"create\", count(*) FILTER (a = 'newversion') AS newversion, count(*) FILTER (a = 'skip') AS skip FROM (SELECT {_ACTION} AS a FROM {_DOCS})")
def plan_tally(spark, sf_dir):
    return versioning.tally(versioning.version_plan(document_feed(spark, sf_dir), document_state(spark, sf_dir), PROFILE))


@query(f"SELECT 'doc-' || d.doc_id AS slug, CASE WHEN l.doc_id IS NULL THEN 'create' ELSE 'newversion' END AS action FROM {_DOCS}")
def forced_plan(spark, sf_dir):
    """Everything known gets a new version, whatever its hash says."""
    plan = versioning.version_plan(document_feed(spark, sf_dir), document_state(spark, sf_dir), PROFILE, force=True)
    return plan.select("slug", "action")


@query(
    oracle.people(
        "SELECT f.doc_id AS slug, CASE WHEN bal < 5000 THEN 'create' ELSE 'newversion' END AS action, CASE WHEN named THEN upper(last_name) || ', ' || first_name ELSE '' END AS title, "
        "CASE WHEN NOT has_citation THEN 'Lives Register' WHEN seg = 'BUILDING' THEN 'Ada N' || nk || ', Jr.; Bo Ray' WHEN seg = 'FURNITURE' THEN 'Ada N' || nk || '; Cy Orr; Bo Ray' ELSE 'Ada N' || nk END AS authors, "
        f"CASE WHEN NOT has_version THEN '{TODAY}' WHEN seg = 'MACHINERY' THEN year(last_order) || '-01-01' WHEN seg = 'HOUSEHOLD' THEN '2019-02-31' ELSE strftime(last_order, '%Y-%m-%d') END AS date, "
        "NOT has_version AS defaulted FROM fields f WHERE NOT (bal >= 5000 AND seg = 'BUILDING')"
    )
)
def dry_run_report(spark, sf_dir):
    """Report rows of the entries that a run would touch."""
    entries = feed(spark, sf_dir)
    known = synth.read(spark, sf_dir, "customer").where("c_acctbal >= 5000").select(
        F.concat(F.lit("entry-"), F.col("c_custkey").cast("string")).alias("slug"), "c_mktsegment"
    )
    hashes = entries.select("slug", fingerprints.state_hash(F.col("content_hash"), PROFILE.license, PROFILE.publication_type).alias("h"))
    state = known.join(hashes, "slug").select("slug", F.when(F.col("c_mktsegment") == "BUILDING", F.col("h")).otherwise("sha256:old").alias("content_hash"))
    report = versioning.dry_run(versioning.version_plan(entries, state, PROFILE), PROFILE, TODAY)
    return report.select("slug", "action", "title", "authors", "date", (F.size("diagnostics") > 0).alias("defaulted"))


def _outcomes(spark, sf_dir):
    """Results of a run: French documents fail, the others get a new record."""
    plan = versioning.version_plan(document_feed(spark, sf_dir), document_state(spark, sf_dir), PROFILE).where("action <> 'skip'")
    ok = F.col("lang") != "fr"
    return plan.select(
        "slug", ok.alias("ok"), (F.col("doc_id") + 500000).alias("record_id"), F.col("doc_id").alias("concept_rec_id"),
        F.when(F.col("action") == "create", F.concat(F.lit("10.1234/n"), F.col("doc_id").cast("string"))).alias("concept_doi"),
        F.concat(F.lit("10.1234/w"), F.col("doc_id").cast("string")).alias("version_doi"), F.col("state_hash").alias("content_hash"),
        F.lit("2").alias("version"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("minted_at"), F.when(~ok, "refused").alias("error"),
    )


_NEW = "lang <> 'fr' AND (l.doc_id IS NULL OR quality = 0)"


@query(
    f"SELECT 'doc-' || d.doc_id AS slug, CASE WHEN {_NEW} THEN d.doc_id + 500000 ELSE d.doc_id END AS record_id, "
    f"CASE WHEN {_NEW} AND l.doc_id IS NULL THEN '10.1234/n' ELSE '10.1234/c' END || d.doc_id AS concept_doi, CASE WHEN {_NEW} THEN '10.1234/w' ELSE '10.1234/v' END || d.doc_id AS version_doi, "
    f"CASE WHEN {_NEW} OR quality = 1 THEN {_DOC_STATE} ELSE 'sha256:earlier' END AS content_hash, CASE WHEN {_NEW} THEN '2' ELSE '1' END AS version FROM {_DOCS} "
    "WHERE l.doc_id IS NOT NULL OR lang <> 'fr'"
)
def merged_state(spark, sf_dir):
    """State after a run; failed entries keep their old row, or none."""
    merged = versioning.merge_outcomes(document_state(spark, sf_dir).drop("quality", "toxic"), _outcomes(spark, sf_dir), "sandbox")
    return merged.select("slug", "record_id", "concept_doi", "version_doi", "content_hash", "version")


@query(
    f"SELECT 'doc-' || d.doc_id AS slug, CASE WHEN {_NEW} THEN d.doc_id + 500000 ELSE d.doc_id END AS record_id FROM {_DOCS} WHERE l.doc_id IS NOT NULL OR lang <> 'fr'"
)
def state_files(spark, sf_dir):
    """State published before and after a run; readers get the newest complete version."""
    folder = new_folder(spark, "state")
    before = document_state(spark, sf_dir).drop("quality", "toxic")
    exports.publish_state(before, folder, 1)
    known = keyvalue.read_state(spark, exports.current_state_folder(spark, folder))
    exports.publish_state(versioning.merge_outcomes(known, _outcomes(spark, sf_dir), "sandbox"), folder, 2)
    return keyvalue.read_state(spark, exports.current_state_folder(spark, folder)).select("slug", "record_id")


def keyed_state(spark, sf_dir, folder):
    """The published state as a bucketed table."""
    exports.publish_keyed(document_state(spark, sf_dir).drop("quality", "toxic"), folder, 1)
    return keyvalue.read_keyed(spark, exports.current_state_folder(spark, folder))


@query(f"SELECT 'doc-' || d.doc_id AS slug, {_DOC_STATE} AS state_hash, {_ACTION} AS action FROM {_DOCS}")
def keyed_plan(spark, sf_dir):
    """The version plan against a bucketed state table, which is not shuffled."""
    state = keyed_state(spark, sf_dir, new_folder(spark, "keyed"))
    return versioning.version_plan(document_feed(spark, sf_dir), state, PROFILE).select("slug", "state_hash", "action")


@query(
    f"SELECT 'doc-' || d.doc_id AS slug, CASE WHEN {_NEW} THEN d.doc_id + 500000 ELSE d.doc_id END AS record_id FROM {_DOCS} WHERE l.doc_id IS NOT NULL OR lang <> 'fr'"
)
def keyed_merge(spark, sf_dir):
    """State merged into the next version of a bucketed table."""
    folder = new_folder(spark, "keyed")
    merged = versioning.merge_outcomes(keyed_state(spark, sf_dir, folder), _outcomes(spark, sf_dir), "sandbox")
    exports.publish_keyed(merged, folder, 2)
    return keyvalue.read_keyed(spark, exports.current_state_folder(spark, folder)).select("slug", "record_id")


@query(f"SELECT 'doc-' || d.doc_id AS slug, {_DOC_HASH} AS digest FROM {_DOCS}")
def manifest_files(spark, sf_dir):
    """The render manifest written and read again."""
    folder = new_folder(spark, "manifest")
    current = document_feed(spark, sf_dir).select("slug", F.col("content_hash").alias("digest"))
    written = exports.write_manifest(current, folder, 1)
    return spark.read.schema("slug string, digest string").json(written)


@query(
    f"SELECT count(*) FILTER (lang <> 'fr') AS succeeded, count(*) FILTER (lang = 'fr') AS failed, max((lang = 'fr')::INT) AS exit_status FROM {_DOCS} WHERE l.doc_id IS NULL OR quality = 0"
)
def outcome_totals(spark, sf_dir):
    return versioning.outcome_totals(_outcomes(spark, sf_dir))


@query(
    oracle.people(
        "SELECT doc_id AS slug, array_to_string(list_filter([CASE WHEN NOT has_photo THEN 'artifact_missing' END, CASE WHEN NOT named THEN 'title_empty' END], lambda x: x IS NOT NULL), ',') AS reasons FROM fields"
    )
)
def quarantined_entries(spark, sf_dir):
    """Reasons to keep an entry back; empty when it may go on."""
    bios = synth.bios(spark, sf_dir)
    rendered = synth.people(spark, sf_dir).where("F_n > 1").select(F.concat(F.lit("entry-"), F.col("c_custkey").cast("string")).alias("slug"))
    checked = versioning.quarantine(bios.select(F.col("doc_id").alias("slug"), "first_name", "last_name"), rendered)
    return checked.select("slug", F.array_join("reasons", ",").alias("reasons"))


@query(
    "SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS reused, count(*) FILTER (NOT coalesce(quality = 1 AND toxic = 0, false)) AS to_render "
    f"FROM {_DOCS} GROUP BY source"
)
def render_plan(spark, sf_dir):
    """Reuse a rendering only when its hash is current and the file is still there."""
    current = document_feed(spark, sf_dir).select("slug", "source", F.col("content_hash").alias("digest"))
    labels = document_feed(spark, sf_dir).join(synth.read(spark, sf_dir, "labels"), "doc_id")
    manifest = labels.select("slug", F.when(F.col("quality") == 1, F.col("content_hash")).otherwise("old").alias("digest"))
    files = labels.where("toxic = 0").select("slug")
    plan = versioning.cache_plan(current, manifest, files)
    return plan.groupBy("source").agg(F.count_if(F.col("action") == "reuse").alias("reused"), F.count_if(F.col("action") == "render").alias("to_render"))


@query(
    oracle.people(
        "SELECT doc_id AS slug, sha256('bytes' || k) || ':' || CASE seg WHEN 'HOUSEHOLD' THEN '2' ELSE '' END || ':v2' AS digest, "
        "CASE WHEN seg IN ('HOUSEHOLD', 'MACHINERY') THEN 'render' ELSE 'reuse' END AS action FROM fields WHERE has_photo"
    )
)
def crop_plan(spark, sf_dir):
    """Crops are redone when the image, the subject override or the crop version changes, or the crop is gone."""
    shown = synth.documents(spark, sf_dir).join(
        synth.read(spark, sf_dir, "customer").select(F.concat(F.lit("entry-"), F.col("c_custkey").cast("string")).alias("doc_id"), "c_mktsegment"), "doc_id"
    )
    from prosopon.operators import segments

    subject = F.when(F.col("c_mktsegment") == "HOUSEHOLD", 2)
    images = shown.select(F.col("doc_id").alias("slug"), "c_mktsegment", segments.first_attachment(F.col("attachments"))["data"].alias("data"), subject.alias("subject"))
    images = images.where(F.col("data").isNotNull())
    current = images.select("slug", fingerprints.crop_signature(F.col("data"), F.col("subject"), "2").alias("digest"))
    recorded = images.select("slug", fingerprints.crop_signature(F.col("data"), F.lit(None), "2").alias("digest"))
    return versioning.cache_plan(current, recorded, images.where("c_mktsegment <> 'MACHINERY'").select("slug"))


_SYNC = "CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN toxic = 1 THEN 'delete' WHEN quality = 1 THEN 'unchanged' ELSE 'update' END"


@query(f"SELECT 'doc-' || d.doc_id AS id, {_SYNC} AS action FROM {_DOCS}")
def store_sync(spark, sf_dir):
    """Current corpus against the stored one; toxic documents have left the corpus."""
    entries = document_feed(spark, sf_dir).select("doc_id", F.col("slug").alias("id"), F.col("content_hash").alias("digest"))
    labels = synth.read(spark, sf_dir, "labels")
    current = entries.join(labels.where("toxic = 1"), "doc_id", "left_anti")
    stored = entries.join(labels, "doc_id").select("id", F.when(F.col("quality") == 1, F.col("digest")).otherwise("old").alias("digest"))
    return versioning.sync(current, stored)


@query(f"SELECT action, count(*) AS n FROM (SELECT {_SYNC} AS action FROM {_DOCS}) GROUP BY action")
def sync_tally(spark, sf_dir):
    return store_sync(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query(f"SELECT 'doc-' || d.doc_id AS id FROM {_DOCS} WHERE quality = 1 AND toxic = 0")
def unchanged_entries(spark, sf_dir):
    """Intersection of two snapshots on id and digest."""
    entries = document_feed(spark, sf_dir).select("doc_id", F.col("slug").alias("id"), F.col("content_hash").alias("digest"))
    labels = synth.read(spark, sf_dir, "labels")
    stored = entries.join(labels.where("toxic = 0"), "doc_id").select("id", F.when(F.col("quality") == 1, F.col("digest")).otherwise("old").alias("digest"))
    return entries.join(stored, ["id", "digest"], "left_semi").select("id")


@query(
    "SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM ("
    "SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders) WHERE previous IS NULL OR previous <> o_orderstatus"
)
def version_history(spark, sf_dir):
    """A version per change of status along each customer's orders."""
    orders = synth.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    history = versioning.version_history(orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return history.select("o_custkey", "o_orderkey", "o_orderstatus", "version_number")


@query(
    "SELECT id, doc_id, n_chars, copies FROM (SELECT lower(lang || '-' || source) AS id, doc_id, n_chars, count(*) OVER (PARTITION BY lang, source) AS copies, "
    "row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1"
)
def duplicate_ids(spark, sf_dir):
    """Documents with the same id: the last one stays, with the number there were."""
    from prosopon.functions import text as t

    docs = synth.read(spark, sf_dir, "documents")
    named = docs.select(t.slugify(F.concat_ws(" ", "lang", "source")).alias("id"), "doc_id", "n_chars")
    return ordering.keep_last(named, "id", "doc_id").select("id", "doc_id", "n_chars", "copies")


def _lanes(i: int) -> str:
    return f"sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT)::VARCHAR"


@query(
    "SELECT lang, source, n AS files, substr(sha256(n || ':' || " + " || ':' || ".join(f"l{i}" for i in range(3)) + "), 1, 16) AS fingerprint FROM ("
    "SELECT lang, source, count(*) AS n, " + ", ".join(f"{_lanes(i)} AS l{i}" for i in range(3))
    + " FROM (SELECT lang, source, sha256('doc/' || doc_id || chr(0) || text || chr(0)) AS h FROM documents) GROUP BY lang, source)"
)
def corpus_fingerprints(spark, sf_dir):
    """One fingerprint per language and source over whole texts, whatever the number of files."""
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    return versioning.set_fingerprint(synth.read(spark, sf_dir, "documents"), ["lang", "source"], path, F.col("text"))


def _level(number: int) -> str:
    below, node = ("leaves", "spot") if number == 1 else (f"l{number - 1}", "node")
    return f"l{number} AS (SELECT lang, {node} // 64 AS node, sha256(string_agg(digest, '' ORDER BY {node})) AS digest FROM {below} GROUP BY ALL)"


_TREE = (
    "leaves AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY 'doc/' || doc_id) - 1 AS spot, sha256('doc/' || doc_id || chr(0) || {text} || chr(0)) AS digest "
    "FROM documents LEFT JOIN labels USING (doc_id)), " + ", ".join(map(_level, range(1, 6))) + ", sizes AS (SELECT lang, count(*) AS files FROM leaves GROUP BY lang), "
    "nodes AS (" + " UNION ALL ".join(["SELECT lang, 0 AS level, spot AS node, digest FROM leaves"] + [
        f"SELECT lang, {n}, l{n}.node, digest FROM l{n} JOIN sizes USING (lang)" + (f" WHERE files > {64 ** (n - 1)}" if n > 1 else "") for n in range(1, 6)
    ]) + ")"
)
_PLAIN_TREE = _TREE.format(text="text")


def document_tree(spark, sf_dir, revised=False):
    docs = synth.read(spark, sf_dir, "documents")
    text = F.col("text")
    if revised:
        docs = docs.join(synth.read(spark, sf_dir, "labels"), "doc_id", "left")
        text = F.when(F.col("toxic") == 1, F.concat(text, F.lit("!"))).otherwise(text)
    return versioning.fingerprint_tree(docs, ["lang"], F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), text)


@query(f"WITH {_PLAIN_TREE} SELECT lang, files, substr(max_by(digest, level), 1, 16) AS fingerprint FROM nodes JOIN sizes USING (lang) GROUP BY lang, files")
def ordered_fingerprints(spark, sf_dir):
    """One fingerprint per language over whole texts in the order of their paths."""
    return versioning.ordered_fingerprint(document_tree(spark, sf_dir), ["lang"])


@query(
    "WITH leaves AS (SELECT lang, coalesce(toxic, 0) = 1 AS edited, row_number() OVER (PARTITION BY lang ORDER BY 'doc/' || doc_id) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS files "
    "FROM documents LEFT JOIN labels USING (doc_id)), levels AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS level FROM leaves WHERE edited) "
    "SELECT lang, level, count(DISTINCT spot // (64 ** level)::BIGINT) AS nodes FROM levels WHERE level < 2 OR files > 64 ** (level - 1) GROUP BY lang, level"
)
def changed_fingerprints(spark, sf_dir):
    """Nodes of each language's tree that are new once the toxic texts are edited: one per level above each of them."""
    changed = versioning.changed_nodes(document_tree(spark, sf_dir), document_tree(spark, sf_dir, revised=True), ["lang"])
    return changed.groupBy("lang", "level").agg(F.count("*").alias("nodes"))


@query(
    "SELECT doc_id, substr(sha256('lang' || chr(0) || lang || chr(0) || 'source' || chr(0) || source || chr(0) || 'text' || chr(0) || text || chr(0)), 1, 16) AS fingerprint FROM documents"
)
def document_fingerprints(spark, sf_dir):
    """Path-ordered fingerprint over the parts of each document."""
    files = F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).alias("content")) for c in ("text", "source", "lang")])
    return synth.read(spark, sf_dir, "documents").select("doc_id", fingerprints.ordered_set_fingerprint(files).alias("fingerprint"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS published, strftime(o_orderdate, '%Y') || '-01-01' AS by_year FROM orders")
def order_dates(spark, sf_dir):
    """Dates written out in words and read back."""
    words = F.date_format("o_orderdate", "d MMMM yyyy")
    year = F.date_format("o_orderdate", "yyyy")
    return synth.read(spark, sf_dir, "orders").select(
        "o_orderkey", citations.publication_date(F.concat(F.lit("version  "), words)).alias("published"),
        citations.publication_date(F.concat(F.lit("Spring of "), year)).alias("by_year"),
    )
