"""Positions and runs over a total order, without one task seeing all rows.

The rows are written once. Only their order keys are range-partitioned (unique tie-breakers included, so that one hot sort value is
still spread), sorted and numbered; the rows then join their places. Of every range one row, never more than the number of partitions,
goes through the final step that adds up the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopon.session import cut_lineage

PART_BITS = 33


def sorted_keys(df: DataFrame, order: list[Column], *carried: str) -> tuple[DataFrame, DataFrame]:
    """(rows, keys): `df` written once with `_row`, and per row `_row`, `_seq` ascending along the order, its range `_part` and place `_at` there, and `carried`.

    The number of ranges is Spark's (`spark.sql.shuffle.partitions`, merged by size at run time). Both are written tables: the numbers must not change
    when a lost task is repeated, and range bounds, which are found by sampling, must not run all the work above a second time.
    """
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()), "unsorted")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_row", *carried, F.monotonically_increasing_id().alias("_seq"))
    keys = cut_lineage(placed, "ranges")
    return rows, keys.withColumn("_part", F.shiftright("_seq", PART_BITS)).withColumn("_at", F.col("_seq").bitwiseAND((1 << PART_BITS) - 1))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position in the total order."""
    rows, keys = sorted_keys(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keys.groupBy("_part").agg(F.count("*").alias("_rows"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    places = keys.join(F.broadcast(offsets), "_part").select("_row", (F.col("_offset") + F.col("_at") + 1).alias(name))
    return rows.join(places, "_row").drop("_row")


def run_numbers(df: DataFrame, order: list[Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, places): `df` written with `_row`, and per row `_row`, `position`, `run` (number of the stretch of rows with the same key) and
    `continuation` (not its first row). Where a stretch goes on in the next range, the range before hands its last key over.
    """
    rows, keys = sorted_keys(df, order, key)
    along = Window.partitionBy("_part").orderBy("_seq")
    local = keys.withColumn("_previous", F.lag(key).over(along)).withColumn(
        "_starts", F.sum(F.when(F.col("_previous") == F.col(key), 0).otherwise(1)).over(along)
    )
    edges = local.groupBy("_part").agg(
        F.count("*").alias("_rows"),
        F.max("_starts").alias("_runs"),
        F.min_by(key, "_seq").alias("_first"),
        F.max_by(key, "_seq").alias("_last"),
    )
    over_parts = Window.orderBy("_part")
    before = over_parts.rowsBetween(Window.unboundedPreceding, -1)
    joined = edges.withColumn("_joins", F.coalesce(F.lag("_last").over(over_parts) == F.col("_first"), F.lit(False)))
    offsets = joined.select(
        "_part",
        "_joins",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_offset"),
        (
            F.coalesce(F.sum(F.col("_runs") - F.col("_joins").cast("int")).over(before), F.lit(0))
            - F.col("_joins").cast("int")
        ).alias("_run_offset"),
    )
    continues = F.when(F.col("_at") == 0, F.col("_joins")).otherwise(F.coalesce(F.col("_previous") == F.col(key), F.lit(False)))
    places = local.join(F.broadcast(offsets), "_part").select(
        "_row",
        (F.col("_row_offset") + F.col("_at") + 1).alias("position"),
        (F.col("_run_offset") + F.col("_starts")).alias("run"),
        continues.alias("continuation"),
    )
    return rows, places


def with_runs(df: DataFrame, order: list[Column], key: str) -> DataFrame:
    """`position`, `run` and `continuation` (see `run_numbers`) of every row."""
    rows, places = run_numbers(df, order, key)
    return rows.join(places, "_row").drop("_row")


def nth_per_key(df: DataFrame, key: str, order: list[Column], wanted: str) -> DataFrame:
    """Of each key the row that is number `wanted` (a column, from 1) in `order`, which is unique within the key; no row where there are fewer.

    The first `wanted` rows are cut out per key and part of its rows, then per key: a key with very many rows is spread over as many tasks as the
    session has shuffle partitions, and only what can still be the wanted row meets in one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    some = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).where(F.col("_nth") <= F.col(wanted))
    return some.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_nth") == F.col(wanted)).drop("_nth", "_part")


def first_per_key(df: DataFrame, key: str, order: list[Column], limit: int, name: str = "place") -> DataFrame:
    """The first `limit` rows of each key in `order`, which is unique within the key, with their place from 1.

    As in `nth_per_key`, a key's rows are cut down in as many parts as the session has shuffle partitions before they meet, however large `limit` is.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    some = dealt.withColumn(name, F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).where(F.col(name) <= limit)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= limit).drop("_part")


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key and how many there were (`copies`).

    One struct per key is kept while aggregating, before the shuffle too, so a key with very many rows is cheap.
    """
    packed = F.struct(*df.columns)
    best = df.groupBy(key).agg(F.max_by(packed, F.col(order)).alias("_row"), F.count("*").alias("copies"))
    return best.select("_row.*", "copies")


def limit_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """First `limit` rows of the order; the limit must be a positive whole number."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise ValueError(f"limit must be a positive number (got {limit!r})")
    return df.orderBy(*order).limit(limit)
