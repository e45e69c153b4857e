"""Queries over sources, markup, audits and portrait geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosopon.functions import citations, diagnostics, markup
from prosopon.functions import text as t
from prosopon.operators import audit, extract, portraits, segments
from prosopon.operators.enrich import nfc
from prosopon.plans import oracle, synth
from prosopon.plans.catalog import registrar
from prosopon.session import new_folder
from prosopon.sinks import exports
from prosopon.sources import corpus, docx, keyvalue
from prosopon.sources.docx import write_docx
from prosopon.streaming import ingest, store

CATALOG, query = registrar()

# --- sources --------------------------------------------------------------------------------------------


@query(
    "SELECT doc_id::VARCHAR AS doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS idx FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"
)
def text_blocks(spark, sf_dir):
    """Plain texts as paragraph blocks."""
    docs = corpus.from_text(synth.read(spark, sf_dir, "documents"), "doc_id", "text")
    return corpus.blocks_table(docs).select("doc_id", "idx", "text")


_CLEAN = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g')"
_PIECES = (
    f"pieces AS (SELECT page_id, list_filter(string_split(regexp_replace({_CLEAN}, '(?i)<(/?)({markup.BLOCK_TAGS})([\\s>/])', chr(1) || '<\\1\\2\\3', 'g'), chr(1)), "
    "lambda p: regexp_matches(p, '(?i)^<(?:p|h[1-6]|li)[\\s>/]')) AS ps FROM pages), "
    "rows_of AS (SELECT page_id::VARCHAR AS doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS idx FROM pieces), "
    "read AS (SELECT doc_id, idx, lower(regexp_extract(piece, '^<([A-Za-z0-9]+)', 1)) AS tag, trim(regexp_replace(replace(replace(replace(replace(replace("
    "regexp_replace(piece, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM rows_of)"
)


@query(f"WITH {_PIECES} SELECT doc_id, idx, CASE tag WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list' ELSE 'heading' END AS kind, text FROM read")
def html_blocks(spark, sf_dir):
    """Web pages as paragraph, heading and list blocks."""
    docs = corpus.from_html(synth.read(spark, sf_dir, "pages"), "page_id", "html", synth.tasks(spark))
    return corpus.blocks_table(docs).select("doc_id", "idx", "kind", "text")


def _as_docx(batches):
    import pandas as pd

    for batch in batches:
        files = [write_docx(text.split("\n")) for text in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "content": files})


@query(
    "SELECT doc_id::VARCHAR AS doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS idx, 'paragraph' AS kind FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"
)
def word_file_blocks(spark, sf_dir):
    """Every document written as a Word file and read back through the decoder."""
    files = synth.read(spark, sf_dir, "documents").select("doc_id", "text").repartition(synth.tasks(spark)).mapInPandas(_as_docx, "doc_id string, content binary")
    return corpus.blocks_table(docx.decode(files)).select("doc_id", "idx", "kind", "text")


@query("SELECT event_id, (props ->> 'k')::DOUBLE AS number FROM events WHERE (props ->> 'k')::DOUBLE >= 1")
def property_numbers(spark, sf_dir):
    """JSON objects to checked numbers; comment keys and other values fall out."""
    events = synth.read(spark, sf_dir, "events")
    commented = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "_note": "7", "low": "0", "text": "x", "inf": "Infinity"}'))
    return events.select("event_id", F.explode_outer(keyvalue.numbers(commented)).alias("key", "number")).where(F.col("key").isNotNull()).select("event_id", "number")


@query(
    "SELECT p_partkey, p_name AS title, 'in-box/' || lower(replace(p_brand, '#', '')) || '/' || replace(lower(p_name), ' ', '-') AS id, replace(lower(p_name), ' ', '-') AS image_key, "
    "replace(lower(p_brand), ' ', '-') AS folder_key FROM part"
)
def path_ids(spark, sf_dir):
    """Titles, ids and image keys from file paths."""
    path = F.concat(F.lit("In Box/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.when(F.col("p_size") > 25, F.lit("/index")).otherwise(""), F.lit(".docx"))
    stem = t.path_stem(F.regexp_replace(path, "/index", ""))
    return synth.read(spark, sf_dir, "part").select(
        "p_partkey", stem.alias("title"), t.path_id(path).alias("id"), t.image_key(stem).alias("image_key"), t.image_key(F.col("p_brand")).alias("folder_key")
    )


@query("SELECT p_type, count(*) AS files FROM part WHERE p_size <= 40 AND p_type IN ('ECONOMY', 'SMALL') GROUP BY p_type")
def document_files(spark, sf_dir):
    """Word files in any letter case, lock files left out."""
    ending = F.when(F.col("p_type") == "ECONOMY", ".docx").when(F.col("p_type") == "SMALL", ".DOCX").otherwise(".pdf")
    name = F.concat(F.when(F.col("p_size") > 40, "~$").otherwise(""), F.col("p_name"), ending)
    return audit.document_files(synth.read(spark, sf_dir, "part"), name).groupBy("p_type").agg(F.count("*").alias("files"))


@query("SELECT s_suppkey, nfc_normalize('Gémöñ-' || s_name) AS name, length(nfc_normalize('Gémöñ-' || s_name)) AS letters FROM supplier")
def composed_names(spark, sf_dir):
    """Decomposed names to their composed form."""
    decomposed = F.concat(F.lit("Gémöñ-"), F.col("s_name"))
    named = synth.read(spark, sf_dir, "supplier").select("s_suppkey", nfc(decomposed).alias("name"))
    return named.withColumn("letters", F.length("name"))


@query(
    oracle.people(
        "SELECT doc_id AS slug, doc_id || CASE seg WHEN 'MACHINERY' THEN '.png' ELSE '.png' END AS file_name, seg = 'MACHINERY' AS converts, sha256('bytes' || k) AS digest FROM fields WHERE has_photo"
    )
)
def image_files(spark, sf_dir):
    """The images to publish."""
    return exports.image_export(synth.bios(spark, sf_dir)).select("slug", "file_name", "converts", F.sha2("data", 256).alias("digest"))


# --- segmentation over the shared texts ------------------------------------------------------------------


@query(
    "WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS idx FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) "
    "SELECT doc_id::VARCHAR AS doc_id, coalesce(min(idx) FILTER (starts_with(line, 'The')), -1) AS starting, coalesce(min(idx) FILTER (contains(lower(line), 'license')), -1) AS licensed FROM l GROUP BY 1"
)
def labelled_lines(spark, sf_dir):
    """First line of each whole document that starts with or contains a label."""
    docs = corpus.from_text(synth.read(spark, sf_dir, "documents"), "doc_id", "text")
    blocks = F.col("blocks")
    return docs.select(
        "doc_id", segments.first_index(blocks, segments.starts_with("The")).alias("starting"),
        segments.first_index(blocks, segments.contains_ignoring_case(F.lit("license"))).alias("licensed"),
    )


@query(
    "SELECT doc_id::VARCHAR AS doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s: '<p>' || replace(replace(s, '&', '&#x26;'), '<', '&#x3C;') || '</p>'), '') AS html FROM documents"
)
def text_as_html(spark, sf_dir):
    """Whole documents rendered block by block."""
    docs = corpus.from_text(synth.read(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.select("doc_id", markup.render_blocks(F.col("blocks")).alias("html"))


# --- markup ---------------------------------------------------------------------------------------------


@query(
    "SELECT page_id, replace(replace(html, ' href=\"/', ' href=\"/base/'), ' href=\"/base//', ' href=\"//') AS html FROM pages"
)
def prefixed_links(spark, sf_dir):
    """Root-absolute links moved below a base path."""
    return synth.read(spark, sf_dir, "pages").select("page_id", markup.prefix_links(F.col("html"), "/base/").alias("html"))


def _demoted(level: int) -> str:
    return "html" if level == 6 else f"regexp_replace({_demoted(level + 1)}, '(?i)(</?h){level}([\\s>/])', '\\1{level + 1}\\2', 'g')"


@query(f"SELECT page_id, {_demoted(1)} AS html FROM pages")
def demoted_headings(spark, sf_dir):
    return synth.read(spark, sf_dir, "pages").select("page_id", markup.demote_headings(F.col("html")).alias("html"))


@query(
    f"SELECT page_id, unnest(found) AS href, generate_subscripts(found, 1) - 1 AS position, replace(unnest(found), '&amp;', '&') AS target FROM "
    f"(SELECT page_id, regexp_extract_all({_CLEAN}, '(?i)\\shref=[\"'']([^\"'']*)[\"'']', 1) AS found FROM pages)"
)
def page_links(spark, sf_dir):
    found = synth.read(spark, sf_dir, "pages").select("page_id", markup.links(F.col("html")).alias("found"))
    rows = extract.unnest(found, "found", "page_id", index="position", value="href")
    return rows.withColumn("target", t.decode_ampersand(F.col("href")))


@query(
    "SELECT p_partkey, p_name AS text, '/files/' || replace(p_brand, '#', '-') || CASE WHEN p_type = 'SMALL' THEN '.DOCX' ELSE '.pdf' END AS file FROM part WHERE p_type <> 'LARGE'"
)
def file_links(spark, sf_dir):
    """Download links in Markdown, other links left out."""
    ending = F.when(F.col("p_type") == "SMALL", ".DOCX").when(F.col("p_type") == "LARGE", ".html").otherwise(".pdf")
    line = F.concat(
        F.lit("See [page](/about.html) and ["), F.col("p_name"), F.lit("](/files/"), F.replace("p_brand", F.lit("#"), F.lit("-")), ending, F.lit(") for more")
    )
    found = synth.read(spark, sf_dir, "part").select("p_partkey", citations.file_links(line).alias("l"))
    return extract.unnest(found, "l", "p_partkey").select("p_partkey", "value.text", "value.file")


_ANCHOR = "replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N} _-]', '', 'g'), ' ', '-')"


@query(
    f"WITH {_PIECES}, named AS (SELECT doc_id, idx, text, {_ANCHOR} AS slug FROM read WHERE tag <> 'p') "
    "SELECT doc_id, idx, text, slug || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY idx) AS n FROM named)"
)
def heading_anchors(spark, sf_dir):
    """Unique anchors for the headings and list entries of each page."""
    docs = corpus.from_html(synth.read(spark, sf_dir, "pages"), "page_id", "html", synth.tasks(spark))
    return corpus.heading_anchors(docs, ("heading", "list"))


# --- audits ---------------------------------------------------------------------------------------------


@query(
    oracle.people(
        f"SELECT severity, doc_id, count(*) AS n FROM (SELECT doc_id, {oracle.SEVERITY} AS severity FROM flags) GROUP BY ROLLUP (severity, doc_id) HAVING severity IS NOT NULL"
    )
)
def severity_totals(spark, sf_dir):
    return audit.severity_totals(extract.diagnostics_table(synth.bios(spark, sf_dir)))


@query(oracle.people(f"SELECT code, {oracle.SEVERITY} AS severity, count(*) AS n FROM flags GROUP BY ALL"))
def warning_tally(spark, sf_dir):
    return audit.warning_tally(extract.diagnostics_table(synth.bios(spark, sf_dir))).select("code", "severity", "n")


@query(oracle.people(f"SELECT code, {oracle.SEVERITY} AS severity, count(*) AS n FROM flags GROUP BY ALL"))
def observed_tally(spark, sf_dir):
    """The same tally, counted in the pass that writes the entry table."""
    watched, tally = audit.observed(synth.bios(spark, sf_dir))
    exports.write_store(watched, new_folder(spark, "observed"))
    return tally().select("code", "severity", "n")


#: Folders that the documents' files are dealt into.
_FOLDERS = 256


def _by_folder(spark, docs):
    """Rows with the folder and the name of their document's files; a folder's rows are together in one task, in order of the names."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = docs.withColumns({"folder": F.pmod(F.xxhash64("doc_id"), F.lit(_FOLDERS)).cast("string"), "name": F.concat(F.lit("doc_id="), key)})
    return placed.repartition(synth.tasks(spark), "folder").sortWithinPartitions("folder", "name")


def _as_files(spark, docs, base):
    """Each text a file of its own below `base`; files that its document had before are replaced.

    Tasks write the files under their names. Spark's own writer names files itself, so it would need a folder per document, which its driver moves one by one.
    """

    def write(rows):
        from itertools import groupby

        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(base)
        for folder, of_folder in groupby(rows, lambda row: row.folder):
            files.create_dir(f"{top}/{folder}")
            before = {}
            for file in files.get_file_info(fs.FileSelector(f"{top}/{folder}")):
                before.setdefault(file.base_name.rpartition("_")[0], set()).add(file.base_name)
            for name, of_document in groupby(of_folder, lambda row: row.name):
                left = before.get(name, set())
                for n, row in enumerate(of_document, 1):
                    left.discard(f"{name}_{n}.txt")
                    with files.open_output_stream(f"{top}/{folder}/{name}_{n}.txt") as out:
                        out.write(("" if row.text is None else row.text).encode() + b"\n")
                for old in left:
                    files.delete_file(f"{top}/{folder}/{old}")

    _by_folder(spark, docs.select("doc_id", "text")).foreachPartition(write)


def _delete_files(spark, docs, base):
    """The files of these documents deleted, each task in folders of its own."""

    def delete(rows):
        from itertools import groupby

        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(base)
        for folder, of_folder in groupby(rows, lambda row: row.folder):
            names = {row.name for row in of_folder}
            for file in files.get_file_info(fs.FileSelector(f"{top}/{folder}", allow_not_found=True)):
                if file.base_name.rpartition("_")[0] in names:
                    files.delete_file(file.path)

    _by_folder(spark, docs.select("doc_id")).foreachPartition(delete)


def _file_id(path):
    return F.regexp_extract(path, r"doc_id=(-?\d*)_", 1).try_cast("long")


@query("SELECT doc_id, octet_length(encode(text)) + 1 AS length, sha256(text || chr(10)) AS digest FROM documents")
def scanned_files(spark, sf_dir):
    """Every document written as a file of its own, found by the corpus scan."""
    base = new_folder(spark, "files")
    _as_files(spark, synth.read(spark, sf_dir, "documents"), base)
    files, warnings = corpus.scan_or_empty(spark, base, "*.txt")
    if warnings:
        raise ValueError(warnings)
    return files.select(_file_id("relative_path").alias("doc_id"), "length", "digest")


@query(
    "SELECT d.doc_id, sha256(text || CASE WHEN quality = 0 THEN '!' ELSE '' END || chr(10)) AS digest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(toxic, 0) = 0"
)
def refreshed_files(spark, sf_dir):
    """A folder of documents followed by snapshots while some of its files are edited and others deleted."""
    base, place = new_folder(spark, "followed"), new_folder(spark, "followed-store")
    docs, labels = (synth.read(spark, sf_dir, name) for name in ("documents", "labels"))
    schema = store.with_payload(ingest.FILE_FACTS)
    _as_files(spark, docs, base)
    ingest.refresh(spark, base, place, schema, "2024-01-01", 0, pattern="*.txt")
    edited = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    _as_files(spark, edited.withColumn("text", F.concat("text", F.lit("!"))), base)
    _delete_files(spark, labels.where("toxic = 1"), base)
    ingest.refresh(spark, base, place, schema, "2024-01-02", 1, pattern="*.txt")
    return store.current(spark, place, schema).select(_file_id("path").alias("doc_id"), "digest")


@query(
    oracle.people(
        "SELECT f.doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'info') AS notes FROM fields f "
        f"LEFT JOIN (SELECT doc_id, {oracle.SEVERITY} AS severity FROM flags) x ON f.doc_id = x.doc_id GROUP BY f.doc_id"
    )
)
def severity_buckets(spark, sf_dir):
    """Diagnostics of each document by severity, counted inside the row."""
    b = F.col("b")
    counted = synth.bios(spark, sf_dir).select("doc_id", diagnostics.buckets(F.col("diagnostics")).alias("b"))
    return counted.select("doc_id", b["error"].alias("errors"), b["warn"].alias("warnings"), b["info"].alias("notes"))


@query(oracle.people(f"SELECT doc_id, code FROM flags WHERE {oracle.SEVERITY} = 'error'"))
def document_errors(spark, sf_dir):
    bad = synth.bios(spark, sf_dir).select("doc_id", diagnostics.errors(F.col("diagnostics")).alias("e"))
    return extract.unnest(bad, "e", "doc_id").select("doc_id", "value.code")


@query(
    "SELECT doc_id::VARCHAR AS doc_id, 'literature' AS section, count(*) AS items, avg(length(item)) AS mean_length FROM ("
    "SELECT doc_id, unnest(list_filter(list_transform(string_split(replace(text, '. ', '; '), '; '), lambda s: rtrim(s, '.,;')), lambda s: s <> '')) AS item "
    "FROM (SELECT doc_id, replace(replace(text, ';', ','), chr(10), ' ') AS text FROM documents)) GROUP BY doc_id HAVING count(*) >= 2 AND avg(length(item)) > 150"
)
def prose_lists(spark, sf_dir):
    """Whole documents read as citation lists, one per sentence: which look like prose?"""
    plain = F.replace(F.replace(F.col("text"), F.lit(";"), F.lit(",")), F.lit("\n"), F.lit(" "))
    listed = synth.read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), citations.citation_items(F.replace(plain, F.lit(". "), F.lit("; "))).alias("i")
    )
    rows = extract.unnest(listed, "i", "doc_id", value="raw").withColumn("section", F.lit("literature"))
    return audit.prose_lists(rows)


# --- portrait geometry -----------------------------------------------------------------------------------


def boxes(spark, sf_dir):
    """A box per order line; the order is the image."""
    return synth.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("pos"),
        (F.col("l_quantity") * 20).alias("x"), F.floor(F.col("l_tax") * 1000).cast("double").alias("y"),
        (F.floor(F.col("l_discount") * 1000) + 40).cast("double").alias("width"), (F.col("l_linenumber") * 30).cast("double").alias("height"),
    )


def subjects(spark, sf_dir):
    """An override for every urgent order: the second face, or one that is out of range."""
    urgent = synth.read(spark, sf_dir, "orders").where(F.startswith("o_orderpriority", F.lit("1")))
    return urgent.select(F.col("o_orderkey").alias("image_id"), F.when(F.col("o_orderstatus") == "P", 99).otherwise(2).alias("subject"))


_BOXES = (
    "b AS (SELECT l_orderkey AS image_id, l_partkey * 100 + l_linenumber AS pos, l_quantity * 20 AS x, floor(l_tax * 1000)::DOUBLE AS y, floor(l_discount * 1000)::DOUBLE + 40 AS width, "
    "(l_linenumber * 30)::DOUBLE AS height FROM lineitem), "
    "ranked AS (SELECT b.*, CASE WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_orderstatus = 'P' THEN 99 ELSE 2 END END AS subject, "
    "row_number() OVER (PARTITION BY image_id ORDER BY x + width / 2, pos) AS place, row_number() OVER (PARTITION BY image_id ORDER BY width * height DESC, pos) AS size_place FROM b LEFT JOIN orders ON image_id = o_orderkey), "
    "face AS (SELECT *, place = subject AS by_override FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN place = subject THEN 0 ELSE 1 END, size_place) AS pick FROM ranked) WHERE pick = 1)"
)


@query(f"WITH {_BOXES} SELECT image_id, pos, x, y, width, height, coalesce(by_override, false) AS by_override FROM face")
def subject_faces(spark, sf_dir):
    """The subject's box per image."""
    return portraits.subject_faces(boxes(spark, sf_dir), subjects(spark, sf_dir))


_CROP = (
    f"WITH {_BOXES}, src AS (SELECT image_id, x, y, width, height, 1000 + (floor(o_totalprice)::BIGINT % 2000) AS src_w, 900 + o_custkey % 1200 AS src_h FROM face JOIN orders ON image_id = o_orderkey), "
    "scaled AS (SELECT *, least(1.0::DOUBLE, 1200.0::DOUBLE / greatest(src_w, src_h)) AS s FROM src), "
    "head AS (SELECT *, width / s * 1.5::DOUBLE / 0.7::DOUBLE AS want, ((x / s - width / s * 0.25) + (x / s + width / s + width / s * 0.25)) / 2 AS cx, y / s - height / s * 0.4::DOUBLE AS ht FROM scaled), "
    "fit AS (SELECT *, least(want, src_w) AS w1 FROM head), "
    "fit2 AS (SELECT *, CASE WHEN w1 / 0.8::DOUBLE > src_h THEN src_h ELSE w1 / 0.8::DOUBLE END AS h2, CASE WHEN w1 / 0.8::DOUBLE > src_h THEN src_h * 0.8::DOUBLE ELSE w1 END AS w2 FROM fit), "
    "fit3 AS (SELECT *, floor(w2)::BIGINT AS crop_w, floor(h2)::BIGINT AS crop_h FROM fit2) "
    "SELECT image_id, src_w, src_h, crop_w, crop_h, greatest(0, least(src_w - crop_w, floor(cx - crop_w / 2 + 0.5)::BIGINT)) AS crop_left, "
    "greatest(0, least(src_h - crop_h, floor(ht - crop_h * 0.08::DOUBLE + 0.5)::BIGINT)) AS crop_top, least(800, crop_w) AS out_w, floor(least(800, crop_w) / 0.8::DOUBLE + 0.5)::BIGINT AS out_h, "
    "floor(src_w * s + 0.5)::BIGINT AS detect_w, floor(src_h * s + 0.5)::BIGINT AS detect_h FROM fit3"
)


@query(_CROP)
def crop_rectangles(spark, sf_dir):
    """Crop and output size around each subject."""
    faces = portraits.subject_faces(boxes(spark, sf_dir), subjects(spark, sf_dir))
    sources = synth.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"), (1000 + F.floor("o_totalprice") % 2000).alias("src_w"), (900 + F.col("o_custkey") % 1200).alias("src_h")
    )
    cropped = portraits.crop_rectangles(faces.join(sources, "image_id"))
    size = portraits.detection_size(F.col("src_w"), F.col("src_h"))
    return cropped.select(
        "image_id", "src_w", "src_h", "crop_w", "crop_h", "crop_left", "crop_top", "out_w", "out_h",
        size["width"].alias("detect_w"), size["height"].alias("detect_h"),
    )
