"""Sinks: the entry store, the feed, state and manifest tables, the CSV audit and the image export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopon.operators.enrich import WEB_EXTENSIONS

BOM = "﻿"


def write_store(entries: DataFrame, path: str) -> None:
    """The keyed entry table: id, data columns, body, file path and digest."""
    entries.write.mode("overwrite").parquet(path)


def write_feed(feed: DataFrame, path: str) -> None:
    """JSON lines in the slugs' locale order; the order is a range sort, so it stays distributed."""
    feed.orderBy(F.collate("slug", "UNICODE")).write.mode("overwrite").json(path)


def publish_state(state: DataFrame, path: str, version: int) -> str:
    """Write a key-sorted table as a new version folder; versions count upwards.

    A version exists for readers once Spark has committed it (its success marker is written last), so they see
    the old table or the new one and never a half-written one, and a run that is repeated replaces its own
    version.
    """
    folder = f"{path}/version={version:012d}"
    state.orderBy("slug").write.mode("overwrite").json(folder)
    return folder


def publish_keyed(state: DataFrame, path: str, version: int, buckets: int | None = None) -> str:
    """The same as a Parquet table bucketed and sorted by slug, which plans, merges and syncs join without shuffling it again.

    The folder's name tells the number of buckets (the session's shuffle partitions unless given) to `keyvalue.read_keyed`.
    """
    spark = state.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{path}/version={version:012d}.buckets={count}"
    name = f"keyed_{uuid.uuid4().hex}"
    state.repartition(count, "slug").write.mode("overwrite").bucketBy(count, "slug").sortBy("slug").option("path", folder).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # only the name goes: the folder is not the catalog's own
    return folder


def current_state_folder(spark: SparkSession, path: str) -> str | None:
    """Newest committed version folder, None before the first publication."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    committed = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marker) or []
    versions = sorted(status.getPath().getParent().getName() for status in committed)
    return f"{path}/{versions[-1]}" if versions else None


def write_csv_audit(rows: DataFrame, path: str) -> None:
    """Every cell quoted, doubled quotes, CRLF line ends, a header; sorted by entry."""
    rows.orderBy(F.collate("entry", "UNICODE")).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option(
        "lineSep", "\r\n"
    ).option("emptyValue", "").csv(path)


def write_csv_audit_with_bom(rows: DataFrame, path: str) -> None:
    """The same as one text column per line, the byte-order mark in front of the header of the first part.

    Spark's CSV writer has no such option; the lines are put together by the same quoting rule.
    """
    names = rows.columns

    def cell(c: str):
        return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))

    header = BOM + ",".join(f'"{n}"' for n in names)
    lines = rows.select(F.collate("entry", "UNICODE").alias("_key"), F.concat_ws(",", *[cell(c) for c in names]).alias("value"))
    first = rows.sparkSession.createDataFrame([(header,)], "value string").select(F.collate(F.lit(""), "UNICODE").alias("_key"), "value")
    ordered = first.withColumn("_rank", F.lit(0)).unionByName(lines.withColumn("_rank", F.lit(1))).orderBy("_rank", "_key")
    ordered.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def image_export(bios: DataFrame) -> DataFrame:
    """Active file name and bytes per entry; formats a browser cannot show are marked for conversion."""
    image = F.col("image_attachment")
    extension = F.lower(image["extension"])
    web = extension.isin(list(WEB_EXTENSIONS))
    return bios.where(image.isNotNull()).select(
        F.col("doc_id").alias("slug"),
        F.concat("doc_id", F.lit("."), F.when(web, extension).otherwise("png")).alias("file_name"),
        (~web).alias("converts"),
        image["data"].alias("data"),
    )


def write_images(bios: DataFrame, path: str) -> None:
    image_export(bios).write.mode("overwrite").parquet(path)


def write_manifest(plan: DataFrame, path: str, version: int) -> str:
    """Slug → digest of everything that is rendered now; published like the state."""
    return publish_state(plan.select("slug", "digest"), path, version)
