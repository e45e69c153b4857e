"""Streaming queries: the shared tables are read as file streams and worked off completely."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosopon.functions import fingerprints
from prosopon.operators.extract import extract_all
from prosopon.plans import oracle, synth, versions
from prosopon.plans.catalog import registrar
from prosopon.session import cut_lineage, new_folder
from prosopon.streaming import decide, ingest, store

CATALOG, query = registrar()


def table_stream(spark, sf_dir, table):
    schema = synth.read(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}*.parquet")


_SESSIONS = (
    "marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events), "
    "numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM marked), "
    "sessions AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM numbered GROUP BY user_id, n)"
)
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


_BURSTS = f"WITH {_SESSIONS} SELECT user_id, {_STAMP.format('started')} AS started, {_STAMP.format('ended')} AS ended, events FROM sessions"


@query(_BURSTS)
def event_bursts(spark, sf_dir):
    """Bursts of each user's events, those included that are open when the events end."""
    events = table_stream(spark, sf_dir, "events")
    places = new_folder(spark, "bursts"), new_folder(spark, "bursts-checkpoint")
    return _stamped(ingest.finished_bursts(events, "ts", "30 minutes", "user_id", watermark="1 hour", target=places[0], checkpoint=places[1]))


@query(f"{_BURSTS} WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def closed_bursts(spark, sf_dir):
    """Bursts that the watermark has passed while the stream goes on."""
    target = new_folder(spark, "bursts")
    stream = ingest.bursts(table_stream(spark, sf_dir, "events"), "ts", "30 minutes", "user_id", watermark="1 hour")
    ingest.write_available(stream, target, new_folder(spark, "bursts-checkpoint"))
    return _stamped(spark.read.schema(stream.schema).parquet(target))


@query(_BURSTS)
def event_bursts_in_batch(spark, sf_dir):
    """The same definition over the finished table: every burst, none still open."""
    return _stamped(ingest.bursts(synth.read(spark, sf_dir, "events"), "ts", "30 minutes", "user_id", watermark="1 hour"))


def _stamped(sessions):
    pattern = "yyyy-MM-dd HH:mm:ss"
    return sessions.select("user_id", *[F.date_format(c, pattern).alias(c) for c in ("started", "ended")], "events")


@query("SELECT event_id, user_id, event_type FROM events")
def first_deliveries(spark, sf_dir):
    """Every event delivered twice, kept once."""
    target = new_folder(spark, "deliveries")
    columns = ["event_id", "ts", "user_id", "event_type"]
    twice = table_stream(spark, sf_dir, "events").select(*columns).unionByName(table_stream(spark, sf_dir, "events").select(*columns))
    kept = ingest.first_deliveries(twice, "ts", "event_id", watermark="1 hour").select("event_id", "user_id", "event_type")
    ingest.write_available(kept, target, new_folder(spark, "deliveries-checkpoint"))
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(target)


_DIGEST = "sha256(d.text || CASE WHEN quality = 0 THEN ' revised' ELSE '' END)"


@query(
    f"SELECT 'doc-' || d.doc_id AS id, {_DIGEST} AS digest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(toxic, 0) = 0"
)
def document_store(spark, sf_dir):
    """Documents ingested, then revised and deleted by a second stream; the table that is left."""
    place = new_folder(spark, "store")
    docs = table_stream(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")

    def rows(text, deleted, at):
        return [F.concat(F.lit("doc-"), key).alias("id"), F.concat(key, F.lit(".txt")).alias("path"), F.sha2(text, 256).alias("digest"), deleted.alias("deleted"), F.lit(at).cast("timestamp").alias("at")]

    arrivals = docs.select(*rows(F.col("text"), F.lit(False), "2024-01-01"))
    labels = synth.read(spark, sf_dir, "labels")
    revised = F.when(F.col("quality") == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))
    later = docs.join(labels, "doc_id").select(*rows(revised, F.col("toxic") == 1, "2024-01-02"))
    store.run_available(arrivals, store.upsert(place), new_folder(spark, "store-checkpoint"))
    store.run_available(later, store.upsert(place, stream="later"), new_folder(spark, "store-checkpoint"))
    return store.current(spark, place).select("id", "digest")


@query(
    f"SELECT 'doc-' || d.doc_id AS id, {_DIGEST} AS digest FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(toxic, 0) = 0"
)
def folded_store(spark, sf_dir):
    """The same store in eight batches, folded after every third of them; each document arrives in one of four and is revised or deleted in another four."""
    place = new_folder(spark, "folded")
    docs = synth.read(spark, sf_dir, "documents").join(synth.read(spark, sf_dir, "labels"), "doc_id", "left")
    key = F.col("doc_id").cast("string")
    revised = F.when(F.col("quality") == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))
    arrives, changes = F.pmod(F.xxhash64("doc_id"), F.lit(4)), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) + 4
    whole = docs.select(
        F.concat(F.lit("doc-"), key).alias("id"), F.concat(key, F.lit(".txt")).alias("path"),
        F.explode(F.array(F.struct(arrives.alias("number"), F.sha2("text", 256).alias("digest"), F.lit(False).alias("deleted")),
                          F.struct(changes.alias("number"), F.sha2(revised, 256).alias("digest"), (F.coalesce("toxic", F.lit(0)) == 1).alias("deleted")))).alias("c"),
    ).select("id", "path", "c.*")
    rows = cut_lineage(whole.withColumn("at", F.timestamp_seconds("number")), "changes")
    write = store.upsert(place)
    for number in range(8):
        write(rows.where(F.col("number") == number).drop("number"), number)
        if number % 3 == 2:
            store.fold(spark, place)
    return store.current(spark, place).select("id", "digest")


@query(oracle.people("SELECT doc_id AS id, last_name, summary, nationality, len(archive_items) AS n_archives FROM fields WHERE seg <> 'FURNITURE'"))
def streamed_biographies(spark, sf_dir):
    """Documents extracted as they arrive; a later stream takes some of them out again."""
    place = new_folder(spark, "biographies")
    carried = ("path", "digest", "deleted", "at")
    schema = store.with_payload("last_name string, summary string, nationality string, n_archives int")
    arrivals = synth.written(synth.people(spark, sf_dir, table_stream(spark, sf_dir, "customer"))).select(
        F.col("doc_id").alias("id"), F.concat("doc_id", F.lit(".docx")).alias("path"), F.sha2(F.to_json("blocks"), 256).alias("digest"),
        F.lit(False).alias("deleted"), F.lit("2024-01-01").cast("timestamp").alias("at"), "blocks", "attachments",
    )

    def fill(changed):
        bios = extract_all(changed.withColumnRenamed("id", "doc_id"), synth.PROFILE, synth.FORMS, carried)
        return bios.select(F.col("doc_id").alias("id"), *carried, "last_name", "summary", "nationality", F.size("archives.items").alias("n_archives"))

    store.run_available(arrivals, store.upsert(place, schema, fill=fill), new_folder(spark, "biographies-checkpoint"))
    gone = table_stream(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(
        F.concat(F.lit("entry-"), F.col("c_custkey").cast("string"), F.lit(".docx")).alias("path"), F.lit("2024-01-02").cast("timestamp").alias("at")
    )
    store.run_available(ingest.tombstones(gone), store.upsert(place, schema, stream="deletions"), new_folder(spark, "biographies-checkpoint"))
    return store.current(spark, place, schema).select("id", "last_name", "summary", "nationality", "n_archives")


@query(
    "SELECT 'doc-' || d.doc_id AS slug, CASE WHEN l.doc_id IS NULL THEN 'create' WHEN quality = 0 THEN 'newversion' ELSE 'skip' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
)
def streamed_decisions(spark, sf_dir):
    """Each arriving document decided against the published state; a second delivery decides nothing."""
    arrivals = _versions(table_stream(spark, sf_dir, "documents"), F.lit(""), 1)
    found = decide.decisions(arrivals.unionByName(arrivals), versions.document_state(spark, sf_dir), synth.PROFILE)
    place = new_folder(spark, "decisions")
    decide.write_available(spark, found, place, new_folder(spark, "decisions-checkpoint"))
    return decide.decided(spark, place).select("slug", "action")


def _versions(docs, suffix, second):
    """(slug, content_hash, at) of texts with a suffix, seen in a given second."""
    signature = fingerprints.sha(F.to_json(F.struct(F.concat("text", suffix).alias("text"), "lang", "source")))
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), signature.alias("content_hash"), F.timestamp_seconds(F.lit(second)).alias("at"))


@query(
    "WITH d AS (SELECT 'doc-' || d.doc_id AS slug, toxic, CASE WHEN l.doc_id IS NULL THEN 'create' WHEN quality = 0 THEN 'newversion' ELSE 'skip' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) "
    "SELECT slug, 1 AS second, action FROM d UNION ALL SELECT slug, unnest([3, 4]), 'newversion' FROM d WHERE toxic = 1"
)
def returning_decisions(spark, sf_dir):
    """Texts that are edited and edited back are decided each time; redeliveries and versions that come too late are not. The query is stopped and goes on in between."""
    docs, labels = (synth.read(spark, sf_dir, name) for name in ("documents", "labels"))
    inbox, place, checkpoint = (new_folder(spark, name) for name in ("versions", "decisions", "decisions-checkpoint"))
    toxic, poor = (docs.join(labels.where(f"{c} = {v}").select("doc_id"), "doc_id", "left_semi") for c, v in (("toxic", 1), ("quality", 0)))
    first = _versions(docs, F.lit(""), 1)
    later = _versions(toxic, F.lit("!"), 3).unionByName(_versions(toxic, F.lit(""), 4)).unionByName(_versions(poor, F.lit("?"), 0)).unionByName(first)
    for delivery in (first, later):
        delivery.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(first.schema).parquet(inbox)
        decide.write_available(spark, decide.decisions(stream, versions.document_state(spark, sf_dir), synth.PROFILE), place, checkpoint)
    return decide.decided(spark, place).select("slug", F.unix_seconds("at").cast("int").alias("second"), "action")
