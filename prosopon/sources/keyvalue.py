"""JSON key → value files and the entry feed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosopon.sources import schemas


def pairs(json: Column, value_type: str = "string") -> Column:
    """Map of a JSON object; empty for anything that is not one. Keys starting with `_` are comments."""
    parsed = F.coalesce(F.from_json(json, f"map<string,{value_type}>"), F.create_map().cast(f"map<string,{value_type}>"))
    return F.map_filter(parsed, lambda k, v: ~F.startswith(k, F.lit("_")))


def numbers(json: Column) -> Column:
    """Map with the values as numbers; only finite ones of at least 1 stay."""
    numeric = F.transform_values(pairs(json), lambda k, v: v.try_cast("double"))
    return F.map_filter(numeric, lambda k, v: F.coalesce((v >= 1) & ~F.isnan(v) & (v < float("inf")), F.lit(False)))


def read_map(spark: SparkSession, path: str, value_type: str = "string", key: str = "slug") -> DataFrame:
    """Rows (key, value) of a JSON object file; absent or corrupt gives no rows.

    One object is one row for the parser, so a file has to fit a task (some hundred MB); what grows beyond that belongs into a table of rows.
    """
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], f"{key} string, value {value_type}")
    return text.select(F.explode(pairs(F.col("value"), value_type)).alias(key, "value"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state table as the state sink writes it; no rows before the first run."""
    try:
        return spark.read.schema(schemas.STATE).json(path)
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], schemas.STATE)


def read_keyed(spark: SparkSession, folder: str | None, schema: str = schemas.STATE) -> DataFrame:
    """A version folder of `exports.publish_keyed` as the bucketed table it is; no rows for None."""
    if folder is None:
        return spark.createDataFrame([], schema)
    name, buckets = f"keyed_{uuid.uuid4().hex}", int(folder.rpartition("buckets=")[2])
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (slug) SORTED BY (slug) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The entry feed; a missing feed is an error."""
    return spark.read.schema(schemas.ENTRY_FEED).json(path)
