"""Helpers of the training-data operators: tables, packed rows, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step inside a task holds as Python objects; whole texts, so a longer text is a step of its own.
STEP_BYTES = 2_000_000

#: White space between words, as a Java character class body.
SPACE = r"\x20\x09-\x0D"


def shared(spark: SparkSession, value) -> Callable[[], object]:
    """`value` broadcast; the function gives it back in a task. Its classes travel with it, so workers need no copy of this package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words between white space (long); null has none."""
    trimmed = F.regexp_replace(text, f"[{SPACE}]++$", "")
    return F.coalesce(F.length(F.regexp_replace(trimmed, f"[{SPACE}]*+[^{SPACE}]++", "x")), F.lit(0)).cast("long")


def packed(df: DataFrame, keep: list[str] | None = None, /, **columns: Column) -> DataFrame:
    """`row`, the whole input row or its columns `keep`, beside columns of our own: extra columns cannot clash with them."""
    return df.select(F.struct(*(["*"] if keep is None else keep)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame, before: DataFrame, **columns: Column) -> DataFrame:
    """The input row's columns and `columns`, which replace input columns of the same name."""
    made = df.select("row", F.struct(*(c.alias(n) for n, c in columns.items())).alias("made"))
    kept = [F.col("row").getField(c).alias(c) for c in before.columns if c not in columns]
    return made.select(*kept, *(F.col("made").getField(n).alias(n) for n in columns))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]], added: str) -> DataFrame:
    """`df` with the columns of the DDL string `added`, which replace input columns of the same name.

    `work` yields each batch with one list per added column. All other columns pass through Arrow unchanged, whatever their type.
    """
    new = T.StructType.fromDDL(added)
    names = {f.name for f in new}
    keep = [f for f in df.schema if f.name not in names]
    kept = [f.name for f in keep]
    arrow = pa.schema([(f.name, arrow_type(f.dataType)) for f in new])

    def run(batches):
        for batch, columns in work(batches):
            own = [c if isinstance(c, pa.Array) else pa.array(c, type=t.type) for c, t in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + own, names=kept + arrow.names)

    return df.mapInArrow(run, T.StructType(keep + list(new)))


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of a text column that together hold about `limit` bytes at most."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (size or 0) > limit:
            yield start, i
            start, held = i, 0
        held += size or 0
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
