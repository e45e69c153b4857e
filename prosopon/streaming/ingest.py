"""Streams of documents and events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopon.operators.extract import extract_all
from prosopon.profile import Profile
from prosopon.session import cut_lineage, new_folder
from prosopon.sources import corpus, docx
from prosopon.streaming import store

#: Columns of a store that is kept by comparing snapshots of a folder.
FILE_FACTS = "modified timestamp, length bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, base: str, pattern: str = "*.docx") -> DataFrame:
    """New files below a folder as they appear. Spark remembers paths: a file that changes under its path is seen by `refresh` only."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(corpus.BINARY_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(base)
    )
    return corpus.with_identity(files, base)


def file_changes(files: DataFrame) -> DataFrame:
    """Change rows (see `store.changes`) of a file stream."""
    return files.select(
        F.col("doc_id").alias("id"), F.col("relative_path").alias("path"), "digest", F.lit(False).alias("deleted"),
        F.col("modificationTime").alias("at"),
    )


def files_with_content(files: DataFrame) -> DataFrame:
    """Change rows that still carry the file, for `store.upsert(..., fill=...)`."""
    return files.select(
        F.col("doc_id").alias("id"), F.col("relative_path").alias("path"), "digest", F.lit(False).alias("deleted"),
        F.col("modificationTime").alias("at"), "content",
    )


def snapshot_changes(spark: SparkSession, base: str, known: DataFrame, taken: str, pattern: str = "*.docx") -> DataFrame:
    """Change rows with content between a store and the folder as it is now: new, edited and deleted files.

    Names, times and lengths are compared with those in the store (`known`, with the columns of FILE_FACTS); only files that differ
    are opened (see `corpus.scan`). `taken` is the time of the comparison and of its changes, so a file that returns with an old date counts as new.
    """
    listed = corpus.listing(spark, base, pattern)
    held = known.select("path", F.col("modified").alias("known_modified"), F.col("length").alias("known_length"))
    same = F.col("modified").eqNullSafe(F.col("known_modified")) & F.col("length").eqNullSafe(F.col("known_length"))
    differs = cut_lineage(listed.join(held, "path", "left").where(~same).select("path", "modified"), "differing")
    at = F.lit(taken).cast("timestamp").alias("at")
    gone = known.join(listed, "path", "left_anti").select("path", at)
    files = corpus.scan(spark, base, pattern, among=differs)
    facts = (F.col("relative_path").alias("path"), F.col("doc_id").alias("id"), "digest", F.lit(False).alias("deleted"), at)
    found = files.select(*facts, F.col("modificationTime").alias("modified"), "length", "content")
    return found.unionByName(tombstones(gone), allowMissingColumns=True)


def refresh(spark: SparkSession, base: str, place: str, schema: str, taken: str, number: int, fill: Callable[[DataFrame], DataFrame] | None = None, pattern: str = "*.docx", stream: str = "snapshots") -> None:
    """Bring the store `place` up to the folder as it is now, as batch `number` of `stream`; a repeat of a batch replaces it.

    `schema` has the columns of FILE_FACTS. An edit that leaves the content as it was is no change; its file is looked at again next time.
    """
    known = store.current(spark, place, schema, before=(stream, number))
    changed = cut_lineage(snapshot_changes(spark, base, known, taken, pattern), "snapshot")
    store.upsert(place, schema, stream, fill or (lambda fresh: fresh))(changed, number)


def extraction(profile: Profile, forms: Sequence[tuple[str, str]], facts: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """`fill` function that decodes and extracts the files a batch really changes; columns `facts` are carried along."""
    carried = ("path", "digest", "deleted", "at", *facts)

    def fill(changed: DataFrame) -> DataFrame:
        documents = docx.decode(changed.withColumnRenamed("id", "doc_id"), carried)
        return extract_all(documents, profile, forms, carried).withColumnRenamed("doc_id", "id")

    return fill


def tombstones(deletions: DataFrame) -> DataFrame:
    """Change rows for deleted paths, which a file stream never reports; `deletions` is (path, at)."""
    return deletions.select(
        F.lit(None).cast("string").alias("id"), "path", F.lit(None).cast("string").alias("digest"), F.lit(True).alias("deleted"), "at"
    )


def bursts(events: DataFrame, time: str, gap: str, *keys: str, watermark: str) -> DataFrame:
    """One row per burst of events: it ends once nothing has come for `gap`. Events later than `watermark` are dropped."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", watermark)
    grouped = timed.groupBy(F.session_window("_time", gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return grouped.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def first_deliveries(events: DataFrame, time: str, *keys: str, watermark: str) -> DataFrame:
    """Repeated deliveries of the same keys dropped; the watermark bounds the state."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", watermark)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("_time")


#: Time of the row that ends an input: later than any event.
END = "9999-01-01 00:00:00"


def finished_bursts(events: DataFrame, time: str, gap: str, *keys: str, watermark: str, target: str, checkpoint: str) -> DataFrame:
    """All bursts of a stream that ends, the ones still open at its end included, as a written table; see `bursts`.

    Everything that is there now is worked off; then one row of a second source tells that nothing will follow, which moves the watermark
    past every burst. The query stays restartable up to that row.
    """
    spark = events.sparkSession
    end = new_folder(spark, "end-of-input")
    columns = events.select(F.col(time).cast("timestamp").alias(time), *keys)
    nothing = spark.createDataFrame([], columns.schema)
    nothing.write.parquet(end)
    stream = columns.unionByName(spark.readStream.schema(columns.schema).parquet(end))
    found = bursts(stream, time, gap, *keys, watermark=watermark)
    write_available(found, target, checkpoint)
    last = spark.range(1).select(F.lit(END).cast("timestamp").alias(time), *[F.lit(None).cast(columns.schema[k].dataType).alias(k) for k in keys])
    last.write.mode("append").parquet(end)
    write_available(found, target, checkpoint)
    return spark.read.schema(found.schema).parquet(target).where(F.col("started") < F.lit(END).cast("timestamp"))


def write_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now into Parquet files."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
