"""SimHash near-duplicates: exact comparison of fingerprints in tiles with exclusive-or and bit counts.

A fingerprint has a bit set where over half of the hashes of a text's shingles have it. Distinct fingerprints are dealt to tiles by the
population counts of their four 16-bit quarters. Two fingerprints within `radius` bits differ by at most `radius` in the
sum of those counts' differences, so a tile meets only the tiles around it; all others are skipped. The comparison is exact: no
link is lost. A tile holds about TILE fingerprints; a place with more is split into several tiles that meet each other.
There are at most 17^4 places, so their counts may be broadcast. Each pair of tiles yields a spanning forest of its links, at most
one link per fingerprint, and components come from rounds of joins.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; equal texts meet before the comparison as one
fingerprint; a null id never names a component unless no member has an id; repeated rows each get a result row; an
empty table gives an empty result; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosopon.llm import components
from prosopon.llm.common import map_batches, steps, text_bytes
from prosopon.session import cut_lineage

SEED = 42
TILE = 2048
#: Comparisons of one numpy step: eight bytes each.
BLOCK = 1 << 20
QUARTERS, QUARTER_BITS = 4, 16


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle of a lower-cased text; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, n: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    hashes = shingle_hashes(text, n)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint_bits") -> DataFrame:
    """`docs` with the fingerprint (long)."""

    def work(batches):
        for batch in batches:
            found: list[int] = []
            column = batch.column(text)
            for a, b in steps(column):
                found += [fingerprint(x, shingle) for x in text_bytes(column.slice(a, b - a))]
            yield batch, [found]

    return map_batches(docs, work, f"{name} bigint")


def _links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or within one."""
    nodes = a if same else np.concatenate([a, b])
    label = np.arange(len(nodes))
    base = 0 if same else len(a)
    rows = max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        label = components.hook(label, i, j + base)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that join the distinct fingerprints `fp` of `prints` into their components."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", QUARTER_BITS * q).bitwiseAND((1 << QUARTER_BITS) - 1)) for q in range(QUARTERS)]
    code = lambda parts: sum((p * (QUARTER_BITS + 1) ** q for q, p in enumerate(parts)), F.lit(0))
    placed = prints.select("fp", F.array(*quarter).alias("counts")).withColumn("place", code([F.get("counts", F.lit(q)) for q in range(QUARTERS)]))
    places = cut_lineage(placed.groupBy("place").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "places")
    split = placed.join(F.broadcast(places), "place").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = cut_lineage(split.groupBy("place", "part").agg(F.first("counts").alias("counts"), F.collect_list("fp").alias("fps")), "tiles")
    span = range(-radius, radius + 1)
    around = [s for s in itertools.product(span, repeat=QUARTERS) if sum(map(abs, s)) <= radius and sum(x * (QUARTER_BITS + 1) ** q for q, x in enumerate(s)) >= 0]
    to = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in around)))
    met = tiles.withColumn("to", to).withColumn("to", F.zip_with("counts", "to", lambda x, y: x + y))
    met = met.where(F.forall("to", lambda x: (x >= 0) & (x <= QUARTER_BITS)))
    met = met.select("place", "part", "fps", code([F.get("to", F.lit(q)) for q in range(QUARTERS)]).alias("to_place"))
    met = met.join(F.broadcast(places.withColumnRenamed("place", "to_place")), "to_place").withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.where((F.col("to_place") != F.col("place")) | (F.col("to_part") >= F.col("part")))
    other = tiles.select(F.col("place").alias("to_place"), F.col("part").alias("to_part"), F.col("fps").alias("to_fps"))
    same = (F.col("to_place") == F.col("place")) & (F.col("to_part") == F.col("part"))
    pairs = met.join(other, ["to_place", "to_part"]).select("fps", "to_fps", same.alias("same"))

    def compare(batches):
        for batch in batches:
            left, right = [], []
            for x, y, own in zip(batch.column("fps"), batch.column("to_fps"), batch.column("same").to_pylist(), strict=True):
                a, b = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                i, j = _links(a, b, own, radius)
                left.append(i)
                right.append(j)
            if sum(map(len, left)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def _classes(docs: DataFrame, radius: int, shingle: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc, key: hash of the text, fp) of each row, and (fp, root, component_id) of each distinct fingerprint; the root tells components apart."""
    own = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    rows = cut_lineage(with_fingerprints(own, "text", shingle, "fp").select("doc", "key", "fp"), "fingerprints")
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc").alias("first")), "prints")
    roots = cut_lineage(components.connected(links(prints, radius)), "roots")
    member = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = prints.join(member, prints.fp == member.node).select("fp", "root", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = linked.join(lowest, "root").select("fp", "root", "component")
    classes = prints.join(named, "fp", "left")
    return rows, classes.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint in 16 hexadecimal digits, component_id: the smallest id among all that links reach)."""
    rows, classes = _classes(docs, radius, shingle, doc_id, text)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(classes, "fp").select(F.col("doc").alias(doc_id), hexed, "component_id")


def deduplicated(docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id, and among texts under one id that of the smallest hash.

    A row without id is kept only where no member of its component has one. Rows of different components are kept also under one id, or without.
    """
    rows, classes = _classes(docs, radius, shingle, doc_id, text)
    best = F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "key", "n")).alias("best")
    lowest = rows.groupBy("fp", "doc", "key").agg(F.count("*").alias("n")).groupBy("fp").agg(best)
    lowest = lowest.join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = cut_lineage(lowest.select(F.col("best.doc").alias("kept_id"), F.col("best.key").alias("kept_key"), F.col("best.n").alias("n")), "kept")
    repeated = kept.where("n > 1").limit(1).count()
    # The list of kept rows grows with the documents: one plan for every size, none that depends on its being small.
    same = docs[doc_id].eqNullSafe(kept.kept_id) & (F.xxhash64(docs[text]) == kept.kept_key)
    found = docs.join(kept.hint("merge"), same, "left_semi")
    if not repeated:
        return found
    return found.select(F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("key")).dropDuplicates(["id", "key"]).select("row.*")
