"""Repeated passages: paragraph MinHash banding, exact verification, components; and copied stretches anywhere in a text.

Paragraphs are lines of at least LEAST words. Each distinct one gets minimum hashes of its word shingles, joined to BANDS bands of ROWS: two
paragraphs of similarity 0.8 miss all bands with a chance of (1 - 0.8^2)^6 = 0.2 %. Paragraphs that share a band are verified by the
exact Jaccard similarity of their shingle sets, in two steps that lose no link: every member of a band's bucket meets the bucket's
smallest member; a member that is not linked to it meets all others, in tiles of bounded size. Members linked to the smallest one
are connected already, so a bucket of near copies costs one comparison per member. Components of the links, with the exact copies,
are the classes.

A passage may also be copied into the middle of a paragraph, run over several lines or be wrapped differently. Whole texts are therefore
read at anchors as well, line breaks being white space like any other: words whose three-word hash is the largest within REACH words to
either side, or the largest of any SPAN hashes in a row. Both depend on the words around only, so equal stretches have equal anchors, and every
stretch of LONG words has one whose window lies inside it. The WINDOW words from an anchor that occur in two documents are repeated; the
document with the smallest id that has a window owns it. Overlapping windows of one owner are merged. Where windows of several owners overlap in the
document that owns one of them, the owned one stays whole: the rows of the others end where it begins and go on where it ends.

Every result row is an occurrence of a passage that two or more documents have. The document with the smallest id keeps it.

Defined results: null, empty and short texts have no paragraphs and no windows; a passage repeated only inside one document, or under one id, is none; rows
without id are left out; ties go to the smallest id; an empty table gives an empty result; only id and text are read.
Words are lower-cased (A-Z) and separated by white space; spans are bytes of the UTF-8 text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosopon.llm import components
from prosopon.llm.common import steps, text_bytes
from prosopon.session import cut_lineage

LEAST, SHINGLE, SIMILARITY = 25, 5, 0.8
BANDS, ROWS = 6, 2
LONG, REACH, WINDOW = 50, 5, 16
SPAN = LONG - WINDOW + 1
TILE = 256

RANDOM = np.random.default_rng(5)
BYTE_VALUES = RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MULTIPLIERS = RANDOM.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class Words:
    """The words of some texts: hash, byte span, line and document of each."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.origin = np.cumsum(lengths + 1) - lengths - 1
        blank = BLANK[data]
        before = np.concatenate([[True], blank[:-1]])
        self.start = np.flatnonzero(~blank & before)
        self.end = np.flatnonzero(blank & ~before)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(BYTE_VALUES[data] * powers(BASE, len(data)))])
        self.hash = mixed((sums[self.end] - sums[self.start]) * powers(INVERSE, len(data) + 1)[self.start])
        self.line = np.searchsorted(np.flatnonzero(data == 10), self.start)
        new = np.ones(len(self.start), bool)
        new[1:] = self.line[1:] != self.line[:-1]
        self.first = np.flatnonzero(new)  # word that opens each line with words
        self.count = np.diff(np.concatenate([self.first, [len(self.start)]]))
        self.doc = np.searchsorted(self.origin, self.start[self.first], side="right") - 1 if len(self.first) else np.empty(0, np.int64)
        self.doc_word = np.searchsorted(self.start, self.origin)  # first word of each text

    def chained(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each word of `at`."""
        code = np.zeros(len(at), np.uint64)
        for k in range(n):
            code = (code ^ self.hash[at + k]) * BASE
            code ^= code >> np.uint64(29)
        return mixed(code)

    def shingles(self, line: int) -> np.ndarray:
        return np.unique(self.chained(np.arange(self.first[line], self.first[line] + self.count[line] - SHINGLE + 1), SHINGLE))

    def digests(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line's words in order."""
        if not len(lines):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        count = self.count[lines]
        starts = np.cumsum(count) - count
        place = np.arange(count.sum()) - np.repeat(starts, count)
        words = self.hash[place + np.repeat(self.first[lines], count)]
        weight, other = powers(BASE, int(count.max())), powers(INVERSE, int(count.max()))
        return tuple(mixed(np.add.reduceat(words * w[place], starts) + count.astype(np.uint64)) for w in (weight, other))

    def bands(self, lines: np.ndarray) -> np.ndarray:
        """Band keys of each line, a row per line."""
        count = self.count[lines] - SHINGLE + 1
        starts = np.cumsum(count) - count
        place = np.arange(count.sum()) - np.repeat(starts, count)
        code = self.chained(place + np.repeat(self.first[lines], count), SHINGLE)
        lowest = np.stack([np.minimum.reduceat(mixed(code * m), starts) for m in MULTIPLIERS])
        keys = []
        for band in range(BANDS):
            key = np.full(len(lines), band + 1, np.uint64)
            for row in range(ROWS):
                key = mixed((key ^ lowest[band * ROWS + row]) * BASE)
            keys.append(key)
        return np.stack(keys, axis=1)

    def paragraphs(self) -> np.ndarray:
        return np.flatnonzero(self.count >= LEAST)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Words that open a window inside one text, and the text of each: the first largest value among REACH words to either side, or of SPAN values."""
        if len(self.start) < 2 * REACH + WINDOW:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        value = self.chained(np.arange(len(self.start) - 2), 3)
        bounds = np.append(self.doc_word, len(self.start))
        text = np.repeat(np.arange(len(self.doc_word)), np.diff(bounds))  # of each word
        into, after = np.arange(len(text)) - bounds[text], bounds[text + 1] - np.arange(len(text))
        view = np.lib.stride_tricks.sliding_window_view
        left = view(value, REACH).max(axis=1)  # of value[i : i + REACH]
        at = np.arange(REACH, len(value) - REACH)
        at = at[(value[at] > left[at - REACH]) & (value[at] >= left[at + 1]) & (into[at] >= REACH)]
        largest = first_largest(value, SPAN)
        at = np.union1d(at, largest[after[: len(largest)] >= SPAN + 2])
        at = at[after[at] >= WINDOW]
        return at, text[at]


def first_largest(value: np.ndarray, n: int) -> np.ndarray:
    """Place of the first largest of value[i : i + n] for each i."""
    best, size = np.arange(len(value)), 1
    while size < n:
        step = min(size, n - size)
        a, b = best[:-step], best[step:]
        best = np.where(value[b] > value[a], b, a)
        size += step
    return best


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _per_step(docs: DataFrame, emit, schema: str) -> DataFrame:
    """Rows that `emit(words, ids)` gives as a list of columns for each stretch of texts of a frame (doc, text)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches):
        for batch in batches:
            column = batch.column("text")
            for a, b in steps(column):
                columns = emit(Words(text_bytes(column.slice(a, b - a))), batch.slice(a, b - a))
                if columns is not None and len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(work, schema)


def paragraphs(docs: DataFrame) -> DataFrame:
    """A row per paragraph of (doc, text): span, words, 128-bit digest and band keys."""

    def emit(words: Words, batch):
        at = words.paragraphs()
        if not len(at):
            return None
        doc, first, last = words.doc[at], words.first[at], words.first[at] + words.count[at] - 1
        digest, digest2 = words.digests(at)
        bands = words.bands(at)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), signed(bands.reshape(-1)))
        small = [first - words.doc_word[doc], words.count[at], words.start[first] - words.origin[doc], words.end[last] - words.origin[doc]]
        return [batch.column("doc").take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in small), signed(digest), signed(digest2), lists]

    return _per_step(docs, emit, "doc bigint, first_word int, words int, start int, end int, digest bigint, digest2 bigint, bands array<bigint>")


def windows(docs: DataFrame) -> DataFrame:
    """A row per anchored window of (doc, text)."""

    def emit(words: Words, batch):
        at, doc = words.anchors()
        if not len(at):
            return None
        small = [at - words.doc_word[doc], words.start[at] - words.origin[doc], words.end[at + WINDOW - 1] - words.origin[doc]]
        return [signed(words.chained(at, WINDOW)), batch.column("doc").take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in small)]

    return _per_step(docs, emit, "hash bigint, doc bigint, first_word int, start int, end int")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(digest, shingles) of the paragraphs of (doc, text, wanted: digests)."""

    def emit(words: Words, batch):
        wanted = [set(x) for x in batch.column("wanted").to_pylist()]
        at = words.paragraphs()
        digest = words.digests(at)[0].view(np.int64)
        found = {int(d): words.shingles(line) for d, line, doc in zip(digest, at, words.doc[at], strict=True) if int(d) in wanted[doc]}
        kind = pa.list_(pa.int64())
        return [pa.array(found, pa.int64()), pa.array([s.view(np.int64) for s in found.values()], kind)]

    return _per_step(docs, emit, "digest bigint, shingles array<bigint>")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def tile_links(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b): verified links between the members of `left` and `right`, a spanning forest per pair of tiles."""

    def compare(batches):
        for batch in batches:
            links = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                root: dict[int, int] = {}

                def find(x, root=root):
                    while root.get(x, x) != x:
                        root[x] = root.get(root[x], root[x])
                        x = root[x]
                    return x

                others = [(m["digest"], np.array(m["shingles"])) for m in right]
                for m in left:
                    own = np.array(m["shingles"])
                    for digest, shingles in others:
                        a, b = find(m["digest"]), find(digest)
                        if a != b and similar(own, shingles, least):
                            root[max(a, b)] = min(a, b)
                            links.append((m["digest"], digest))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def links(docs: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(a, b): links between digests of different paragraphs of similarity `least` or more, enough to connect all of them."""
    distinct = cut_lineage(found.groupBy("digest").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands")), "distinct")
    keyed = distinct.select("digest", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("digest").alias("hub"), F.max("digest").alias("top"), F.count("*").alias("n"))
    buckets = cut_lineage(buckets.where("hub <> top").select("key", "hub", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "buckets")
    members = cut_lineage(keyed.join(buckets, "key"), "members")
    wanted = members.select("digest").distinct().join(distinct.select("digest", "doc"), "digest").groupBy("doc").agg(F.collect_set("digest").alias("wanted"))
    wanted = cut_lineage(wanted, "wanted")
    sets = cut_lineage(shingle_sets(docs.join(wanted, "doc")).dropDuplicates(["digest"]), "shingles")
    star = members.where("digest <> hub").select("digest", "hub").distinct()
    star = star.join(sets, "digest").join(sets.select(F.col("digest").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
    both = F.size(F.array_intersect("shingles", "hub_shingles"))
    enough = both >= F.lit(least) * (F.size("shingles") + F.size("hub_shingles") - both)
    star = cut_lineage(star.select("digest", "hub", enough.alias("linked")), "star")
    first = star.where("linked").select(F.col("digest").alias("a"), F.col("hub").alias("b"))
    rest = cut_lineage(members.join(star.where("not linked"), ["digest", "hub"], "left_semi"), "unlinked")
    part = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")

    def tiles(rows: DataFrame, name: str) -> DataFrame:
        placed = rows.join(sets, "digest").withColumn("part", part)
        return placed.groupBy("key", "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("digest", "shingles")).alias(name))

    left = tiles(rest, "left").select("key", "left", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = tiles(members.join(rest.select("key").distinct(), "key", "left_semi"), "right").drop("parts")
    return first.union(tile_links(left.join(right, ["key", "part"]).select("left", "right"), least))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A row per occurrence of a repeated passage.

    kind (`paragraph` or `passage`), first_word, words, start and end (bytes), component_id (the smallest id that has
    the passage), documents (at least that many have it: occurrences for a paragraph, 2 for a passage), kept.
    """
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    found = cut_lineage(paragraphs(own), "paragraphs")
    roots = cut_lineage(components.connected(links(own, found, least)), "roots")
    member = roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("digest"), "root")
    named = found.drop("bands").join(member, "digest", "left")
    named = named.withColumn("class", F.coalesce("root", "digest")).withColumn("class2", F.when(F.col("root").isNull(), F.col("digest2")).otherwise(0))
    classes = named.groupBy("class", "class2").agg(F.min("doc").alias("component_id"), F.max("doc").alias("last"), F.count("*").alias("documents"))
    lines = named.join(classes.where("component_id <> last").drop("last"), ["class", "class2"])
    lines = lines.select("doc", F.lit("paragraph").alias("kind"), "first_word", "words", "start", "end", "component_id", "documents")

    stored = cut_lineage(windows(own), "windows")
    shared = stored.groupBy("hash").agg(F.min("doc").alias("component_id"), F.max("doc").alias("last")).where("component_id <> last").drop("last")
    seen = stored.join(shared, "hash").drop("hash")
    # Windows are equally long: only the nearest own window to either side can take words off another owner's, at one end each.
    along = Window.partitionBy("doc").orderBy("first_word")
    own_window = F.when(F.col("doc") == F.col("component_id"), F.struct("first_word", "start", "end"))
    seen = seen.withColumn("own", own_window).withColumn("to", F.col("first_word") + WINDOW)
    seen = seen.withColumn("before", F.last("own", True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn("after", F.first("own", True).over(along.rowsBetween(0, Window.unboundedFollowing)))
    cut_start = F.col("own").isNull() & (F.col("before.first_word") + WINDOW > F.col("first_word"))
    cut_end = F.col("own").isNull() & (F.col("after.first_word") < F.col("to"))
    left = seen.select(
        "doc", "component_id",
        F.when(cut_start, F.col("before.first_word") + WINDOW).otherwise(F.col("first_word")).alias("first_word"),
        F.when(cut_end, F.col("after.first_word")).otherwise(F.col("to")).alias("to"),
        F.when(cut_start, F.col("before.end")).otherwise(F.col("start")).alias("start"),
        F.when(cut_end, F.col("after.start")).otherwise(F.col("end")).alias("end"),
    ).where("first_word < to")
    along = Window.partitionBy("doc", "component_id").orderBy("first_word", "to")
    apart = F.col("first_word") > F.lag("to").over(along)
    merged = left.withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    inside = merged.groupBy("doc", "component_id", "run").agg(
        F.min("first_word").alias("first_word"), (F.max("to") - F.min("first_word")).alias("words"), F.min("start").alias("start"), F.max("end").alias("end"),
    )
    inside = inside.select("doc", F.lit("passage").alias("kind"), "first_word", "words", "start", "end", "component_id", F.lit(2).cast("long").alias("documents"))
    return lines.union(inside).withColumn("kept", F.col("doc") == F.col("component_id")).withColumnRenamed("doc", doc_id)
