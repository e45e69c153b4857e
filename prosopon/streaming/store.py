"""Entry store kept by a stream: an append-only change log in tiers that needs no table format.

Every micro-batch writes its own folder, named after its stream and number, in overwrite mode: a batch that is run again
after a failure replaces its own output, so the result is exactly-once, and streams that share a store cannot touch
each other's batches. The current table is the last change per id by the time of the change, then by stream and batch.

`fold` gathers the batches since the last fold into a tier, keeps the last change per id, and after TIERS tiers gathers those too. Tiers lie in folders by a
hash of the id, and beside them the ids by a hash of their paths. A pointer, written last, names the tiers and the batches they hold, so readers see
the state before a fold or after it. A batch finds what it changes from its own paths' and ids' folders and the batches since the last fold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_COLUMNS = "id string, path string, digest string, deleted boolean, at timestamp"
PLACE = "stream string, batch bigint"
#: Folders of a tier, and tiers that are gathered into one.
BUCKETS, TIERS = 64, 4


def with_payload(columns: str) -> str:
    """Schema of a store whose entries carry more columns."""
    return f"{LOG_COLUMNS}, {columns}"


def _shaped(batch: DataFrame, schema: str) -> DataFrame:
    """The store's columns; those that the batch lacks (tombstones carry no data) are NULL."""
    wanted = batch.sparkSession.createDataFrame([], schema).schema
    return batch.select(
        *[(F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    )


def _read(spark: SparkSession, schema: str, base: str, paths: str) -> DataFrame:
    """Parquet folders below `base`; no rows where there are none yet."""
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(paths)
    except Exception as err:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], schema)


def _folder(spark: SparkSession, place: str):
    """(the store's file system, a function to name what lies in the store)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: path(f"{place}/{name}")


def _pointers(spark: SparkSession, place: str) -> list[int]:
    """Numbers of the committed folds, ascending."""
    files, named = _folder(spark, place)
    return sorted(int(x.getPath().getParent().getName().removeprefix("pointer=")) for x in files.globStatus(named("pointer=*/_SUCCESS")) or [])


def _folded(spark: SparkSession, place: str) -> tuple[list[str], dict[str, int]]:
    """(tiers, last batch of each stream that is in them) of the newest fold."""
    numbers = _pointers(spark, place)
    if not numbers:
        return [], {}
    rows = spark.read.schema("kind string, name string, batch bigint").parquet(f"{place}/pointer={numbers[-1]}").collect()
    return sorted(r.name for r in rows if r.kind == "tier"), {r.name: r.batch for r in rows if r.kind == "stream"}


def bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _since(spark: SparkSession, place: str, schema: str, last: dict[str, int]) -> DataFrame:
    """Changes of the batches since the last fold."""
    log = _read(spark, f"{schema}, {PLACE}", place, f"{place}/stream=*/batch=*")
    for stream, batch in last.items():
        log = log.where((F.col("stream") != stream) | (F.col("batch") > batch))
    return log


def _log(spark: SparkSession, place: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """All changes that count, or those of the ids in some buckets and of every batch since the last fold."""
    tiers, last = _folded(spark, place)
    log = _since(spark, place, schema, last)
    for tier in tiers:
        rows = _read(spark, f"{schema}, {PLACE}, bucket int", f"{place}/{tier}/rows", f"{place}/{tier}/rows")
        log = log.unionByName((rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket"))
    return log


def _last(log: DataFrame) -> DataFrame:
    return log.groupBy("id").agg(F.max_by(F.struct(*log.columns), F.struct("at", "stream", "batch")).alias("c")).select("c.*")


def current(spark: SparkSession, store: str, schema: str = LOG_COLUMNS, before: tuple[str, int] | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Last change per id, deleted ids left out; `before` (stream, batch) leaves out that batch and later ones of its stream."""
    log = _log(spark, store, schema, buckets)
    if before is not None:
        log = log.where((F.col("stream") != before[0]) | (F.col("batch") < before[1]))
    return _last(log).where(~F.col("deleted")).drop("stream", "batch", "deleted")


def touched(spark: SparkSession, store: str, batch: DataFrame) -> list[int]:
    """Buckets of the ids that a batch (id, path) brings or that its paths have had; at most BUCKETS numbers of each kind come to the driver."""
    tiers, last = _folded(spark, store)
    if not tiers:
        return []
    numbers = lambda rows, c: {r.b for r in rows.where(F.col(c).isNotNull()).select(bucket(F.col(c)).alias("b")).distinct().collect()}
    by_path, wanted = list(numbers(batch, "path")), batch.select("path").distinct()
    # Ids that a batch since the last fold has brought count too: what it says of them may be older than what a tier says.
    held = _since(spark, store, LOG_COLUMNS, last).select("path", "id")
    for tier in tiers:
        known = _read(spark, "path string, id string, bucket int", f"{store}/{tier}/paths", f"{store}/{tier}/paths")
        held = held.unionByName(known.where(F.col("bucket").isin(by_path)).select("path", "id"))
    return sorted(numbers(batch, "id") | numbers(held.join(wanted, "path", "left_semi"), "id"))


def changes(batch: DataFrame, known: DataFrame) -> DataFrame:
    """What a batch changes in the table.

    `batch` is (id, path, digest, deleted, at): the last row per path counts, rows with a digest that the table
    already has are dropped, and a path that now leads to another id takes its old id out.
    """
    columns = batch.columns
    last = batch.groupBy("path").agg(F.max_by(F.struct(*columns), F.col("at")).alias("c")).select("c.*")
    held = known.select("path", F.col("id").alias("_old_id"), F.col("digest").alias("_old_digest"))
    met = last.join(held, "path", "left")
    written = met.where(~F.col("deleted") & ~(F.col("_old_id").eqNullSafe(F.col("id")) & F.col("_old_digest").eqNullSafe(F.col("digest"))))
    gone = met.where(F.col("_old_id").isNotNull() & (F.col("deleted") | (F.col("_old_id") != F.col("id"))))
    removed = gone.select(
        *[
            F.col("_old_id").alias("id") if c == "id" else F.lit(True).alias("deleted") if c == "deleted" else F.col(c)
            for c in columns
        ]
    )
    # An id that one path leaves and another takes over in the same batch stays.
    kept = removed.join(written.select("id"), "id", "left_anti").select(*columns)
    by_id = written.select(*columns).groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("at", "path")).alias("c"))
    return by_id.select("c.*").unionByName(kept)


def upsert(store: str, schema: str = LOG_COLUMNS, stream: str = "main", fill: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that appends a batch's changes; `stream` names the stream among those that share a store.

    What has changed is found from ids and digests alone, in the buckets that the batch touches and the batches since the last fold: no payload column of
    the log is read. `fill` then makes the full rows, so the costly work is done for new content only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, brought = batch.sparkSession, _shaped(batch, LOG_COLUMNS)
        known = current(spark, store, LOG_COLUMNS, before=(stream, batch_id), buckets=touched(spark, store, brought))
        changed = changes(brought, known)
        if fill is not None:
            keys = ["id", "path", "at"]
            fresh = batch.join(changed.where(~F.col("deleted")).select(*keys), keys, "left_semi")
            changed = fill(fresh).unionByName(changed.where("deleted"), allowMissingColumns=True)
        _shaped(changed, schema).write.mode("overwrite").parquet(f"{store}/stream={stream}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off everything that is there now."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def fold(spark: SparkSession, store: str, schema: str = LOG_COLUMNS, tiers: int = TIERS) -> None:
    """Gather the batches since the last fold into a tier; with `tiers` of them there already, gather all into one.

    Between batches only. A batch that is in a tier cannot be run again. What the pointer before last named is removed: readers that began before a fold
    have until the next one to finish.
    """
    had, last = _folded(spark, store)
    number = (_pointers(spark, store) or [0])[-1] + 1
    log = _since(spark, store, schema, last)
    latest = last | {r.stream: r.batch for r in log.groupBy("stream").agg(F.max("batch").alias("batch")).collect()}
    if latest == last:
        return
    whole = len(had) >= tiers
    tier = f"tier={number}"
    gathered = _last(_log(spark, store, schema) if whole else log).withColumn("bucket", bucket(F.col("id")))
    gathered.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{tier}/rows")
    paths = _log(spark, store, LOG_COLUMNS) if whole else log
    paths = paths.select("path", "id").distinct().withColumn("bucket", bucket(F.col("path")))
    paths.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{tier}/paths")
    kept = [("tier", t, None) for t in ([tier] if whole else [*had, tier])] + [("stream", s, b) for s, b in latest.items()]
    spark.createDataFrame(kept, "kind string, name string, batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{store}/pointer={number}")
    _remove(spark, store, {t for _, t, _ in kept} | set(had), last)


def _remove(spark: SparkSession, store: str, tiers: set[str], folded: dict[str, int]) -> None:
    """Everything that neither the newest fold nor the one before needs: tiers but `tiers`, batches up to `folded`, older pointers."""
    files, named = _folder(spark, store)
    for number in _pointers(spark, store)[:-2]:
        files.delete(named(f"pointer={number}"), True)
    for found in files.globStatus(named("tier=*")) or []:
        if found.getPath().getName() not in tiers:
            files.delete(found.getPath(), True)
    for stream, last in folded.items():
        for found in files.globStatus(named(f"stream={stream}/batch=*")) or []:
            if int(found.getPath().getName().removeprefix("batch=")) <= last:
                files.delete(found.getPath(), True)
