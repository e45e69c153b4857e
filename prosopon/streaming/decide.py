"""What to do about each version of an entry as it arrives, from the latest one per entry in keyed state.

The state of a slug is the hash and time of its latest known version. It starts from the published state and lives in RocksDB with the query's
checkpoint, so a batch reads the slugs that it brings and nothing else, and a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from prosopon.functions import fingerprints
from prosopon.profile import Profile
from prosopon.streaming.ingest import ROCKSDB

LATEST = StructType([StructField("state_hash", StringType()), StructField("micros", LongType()), StructField("decided", BooleanType())])
DECISION = StructType([StructField(c, LongType() if c == "micros" else StringType()) for c in ("slug", "content_hash", "state_hash", "action", "micros")])


class Decider(StatefulProcessor):
    """Decisions of one slug, in the order of the versions' times; a version older than the latest known one comes too late to count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._latest = handle.getValueState("latest", LATEST)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._latest.update((initialState["state_hash"], None, False))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, seen, decided = tuple(self._latest.get()) if self._latest.exists() else (None, None, False)
        for row in sorted(rows, key=lambda r: (r["micros"], r["state_hash"])):
            version = row["state_hash"]
            if seen is not None and (row["micros"], version) <= (seen, known):
                continue
            action = "create" if known is None else "newversion" if version != known else None if decided else "skip"
            known, seen, decided = version, row["micros"], True
            if action is not None:
                yield Row(slug=key[0], content_hash=row["content_hash"], state_hash=version, action=action, micros=seen)
        self._latest.update((known, seen, decided))

    def close(self) -> None:
        pass


def decisions(versions: DataFrame, state: DataFrame, profile: Profile) -> DataFrame:
    """create / newversion / skip for a stream of versions (slug, content_hash, at), as rows (slug, content_hash, state_hash, action, micros).

    `state` (slug, content_hash) is what was published before the query first ran. A content that comes back after another one is decided again; a
    repeated delivery is not, and `skip` is said once, for what is published already. Of versions with one time the larger hash is the later one. A task
    holds the versions that one batch brings of one slug.
    """
    signature = fingerprints.state_hash(F.col("content_hash"), profile.license, profile.publication_type, profile.render_version)
    keyed = versions.select("slug", "content_hash", signature.alias("state_hash"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    published = state.select("slug", F.col("content_hash").alias("state_hash")).groupBy("slug")
    return keyed.groupBy("slug").transformWithState(Decider(), DECISION, "append", "none", published)


def write_available(spark: SparkSession, found: DataFrame, target: str, checkpoint: str) -> None:
    """Decide everything that is there now; the state store is RocksDB whatever the session uses otherwise."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        query = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)


def decided(spark: SparkSession, target: str) -> DataFrame:
    """All decisions so far, with their time `at`."""
    return spark.read.schema(DECISION).parquet(target).withColumn("at", F.timestamp_micros("micros")).drop("micros")
