"""Shard by sampled splitters: shards of near equal bytes, equal texts together.

The order is (hash of the text, hash of the id): equal texts lie side by side. A sample in which a row's chance is in
proportion to its bytes gives quantile boundaries; texts so frequent that they fill a range get ranges of their own,
split by the id's hash. Exact bytes per range follow from one aggregation; ranges that turn out overfull are sampled and
split again. `pack` then gives ranges to shards: frequent texts stay whole and go to the emptiest shard unless they exceed
a whole shard's share, in which case their ranges are spread; all other ranges fill the shards in order.

Law `bytes`: shards differ by about one range (1/64 of a shard) unless one text is larger than that.

Defined results: a null text has 1 byte and a null checksum; equal rows are told apart by nothing, so any of them may get either
of two slots; an empty table gives an empty result; extra columns are kept, those named like a result column are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopon.llm.common import packed, unpacked
from prosopon.session import cut_lineage

RANGES_PER_SHARD = 64
#: Rows per range at most on average; more rows give more ranges, up to MOST_RANGES boundaries held by the driver.
ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 65_536
SAMPLES_PER_RANGE = 16
ROUNDS = 3
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

Bound = tuple[int, int]


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def range_of(bounds: list[Bound]) -> Column:
    """Number of bounds at or below (text_hash, id_hash): a binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps([{"text_hash": a, "id_hash": b} for a, b in bounds])), "array<struct<text_hash:bigint,id_hash:bigint>>")
    jumps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    here = F.struct(F.col("text_hash"), F.col("id_hash"))
    return F.aggregate(jumps, F.lit(0), lambda at, jump: F.when((at + jump <= len(bounds)) & (F.get(array, at + jump - 1) <= here), at + jump).otherwise(at))


def sampled(rows: DataFrame, per_byte: float, salt: int) -> list[tuple[int, int, float]]:
    """(text_hash, id_hash, weight) of about `per_byte` rows a byte; rows larger than that are all drawn."""
    draw = F.pmod(F.xxhash64("text_hash", "id_hash", F.lit(salt)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drawn = rows.where(draw < F.col("size") * F.lit(per_byte)).select("text_hash", "id_hash", "size").collect()
    return sorted((r.text_hash, r.id_hash, max(float(r.size), 1 / per_byte)) for r in drawn)


def splitters(sample: list[tuple[int, int, float]], goal: float) -> list[Bound]:
    """Boundaries that cut the weighted sample into ranges of `goal` bytes; a text hash above that has ranges of its own."""
    weight: dict[int, float] = {}
    for a, _, w in sample:
        weight[a] = weight.get(a, 0.0) + w
    bounds, held = set(), 0.0
    for a, b, w in sample:
        frequent = weight[a] >= goal
        if frequent:
            bounds.add((a, LOWEST))
            if a < HIGHEST:
                bounds.add((a + 1, LOWEST))
        held += w
        if held >= goal:
            bounds.add((a, b) if frequent else (a, LOWEST))
            held = 0.0
    return sorted(bounds)


def pack(ranges: dict[int, tuple[int, int]], bounds: list[Bound], shards: int) -> tuple[list[int], list[int]]:
    """Shard and first slot of every range, from {range: (bytes, rows)}."""
    count = len(bounds) + 1
    size = [ranges.get(i, (0, 0))[0] for i in range(count)]
    share = sum(size) / shards
    texts: dict[int, list[int]] = {}  # ranges of one text hash alone
    for i in range(1, count):
        start, end = bounds[i - 1][0], bounds[i] if i < len(bounds) else None
        if end is not None and (end[0] == start or end == (start + 1, LOWEST)):
            texts.setdefault(start, []).append(i)
    load, shard = [0.0] * shards, [-1] * count
    whole = [(sum(size[i] for i in group), group) for group in texts.values()]
    for total, group in sorted(whole, key=lambda x: (-x[0], x[1])):
        if share / RANGES_PER_SHARD < total <= share:
            to = min(range(shards), key=lambda j: (load[j], j))
            load[to] += total
            for i in group:
                shard[i] = to
    at = 0
    for i in range(count):
        if shard[i] < 0:
            while at < shards - 1 and load[at] + size[i] / 2 > share:
                at += 1
            shard[i] = at
            load[at] += size[i]
    first, rows = [0] * count, [0] * shards
    for i in range(count):
        first[i] = rows[shard[i]]
        rows[shard[i]] += ranges.get(i, (0, 0))[1]
    return shard, first


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with size, text_crc32, shard and slot (gapless from 0 in its shard); only the columns `keep`, if given, are carried along."""
    hashes = {"text_hash": F.xxhash64(text), "id_hash": F.xxhash64(doc_id), "size": text_size(F.col(text))}
    rows = cut_lineage(docs.select(*(c.alias(n) for n, c in hashes.items())), "shard")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    goal_ranges = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, count // ROWS_PER_RANGE))
    goal = max(1.0, total / goal_ranges)
    bounds: list[Bound] = splitters(sampled(rows, SAMPLES_PER_RANGE / goal, 0), goal) if total else []
    sums: dict[int, tuple[int, int]] = {}
    for again in range(1, ROUNDS + 1):
        placed = rows.withColumn("range", range_of(bounds))
        sums = {r.range: (r.bytes, r.rows) for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        overfull = [i for i, (held, n) in sums.items() if held > 4 * goal and n > 1]
        if not overfull or again == ROUNDS:
            break
        more = splitters(sampled(placed.where(F.col("range").isin(overfull)), SAMPLES_PER_RANGE / goal, again), goal)
        if not set(more) - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    owner, first = pack(sums, bounds, shards)
    lookup = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), F.col("range"))
    carried = docs if keep is None else docs.select(*keep)
    wide = packed(docs, keep, **hashes, crc=F.crc32(text), id=F.col(doc_id)).withColumn("range", range_of(bounds))
    order = Window.partitionBy("range").orderBy("text_hash", "id_hash", "id")
    slot = lookup(first) + F.row_number().over(order) - 1
    return unpacked(wide.withColumn("slot", slot), carried, size=F.col("size"), text_crc32=F.col("crc"), shard=lookup(owner).cast("int"), slot=F.col("slot"))
