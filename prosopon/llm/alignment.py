"""Alignment of two tokenizers over the same texts, by whitespace-token anchors.

A byte-level BPE (A) encodes a space and the text, a piece BPE with byte fallback (B) the text, both in full. Ends that both token
sequences share, checked by bytes, cut a document into groups. Those shared ends whose next tokens both start with a space
are anchors: they split the document into windows of token ids. Of all windows in a stretch of documents (STEP bytes) each tuple of ids
is aligned once and remembered for the others (found by a hash of the ids, compared by the ids). A link is a pair of an A and a B token
that share a byte; a pair's count is the number of documents that hold it.

Plan: texts are read once, for a written table of counts and linked pairs per document (`aligned`). Its pairs are added up in
each task, then by Spark (`pair_counts`). To weigh links, pairs are dealt into blocks of A ids of about PAIRS pairs; a document's
pairs of one block travel with that block's counts to one of several tasks, so a task holds one block and streams through documents
(`weighed`). Nothing goes through the driver but the two vocabulary files and the number of pairs.

The files' paths are parameters; the driver reads them and their bytes travel with the tasks. A is run by tiktoken on the file's own
vocabulary, which equals its merge order (checked, else the tokenizers library does it); so are texts with runs of LONG characters
without or of white space, for which tiktoken takes quadratic time.

Defined results: a text that is null, empty, or whose tokens' bytes differ from space + text on either side has zeros and an empty hash;
rows with null or repeated ids are documents like any other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosopon.llm.common import steps
from prosopon.session import cut_lineage

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Fixed value: how the byte-level vocabulary's pre-tokenizer parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text encoded at a time in a task; a longer text is a step of its own.
STEP = 500_000
LONG = 2_000
GAP = re.compile(rf"\s{{{LONG}}}")
#: Pairs that a task holds at a time, and pairs that a task counts before it hands them on.
PAIRS = 2_000_000
HELD = 4_000_000
#: A pair of ids in one number.
SHIFT = 1 << 15


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """The byte-level BPE of a vocabulary file."""

    def __init__(self, file: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        letters, model = byte_letters(), json.loads(file)
        special = {t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (max([*ranks.values(), *special]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        merged = [ranks[bytes(letters[c] for c in (m if isinstance(m, str) else "".join(m)) if c in letters)] for m in model["model"]["merges"]]
        in_order = all(a < b for a, b in zip(merged, merged[1:], strict=False))
        self.whole = Tokenizer.from_str(file.decode())
        self.whole.encode_special_tokens = True
        self.fast = tiktoken.Encoding("byte", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None

    def encode(self, text: str) -> list[int]:
        if self.fast and max(map(len, text.split()), default=0) < LONG and not GAP.search(text):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


class PieceBPE:
    """The piece BPE of a vocabulary file."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """What aligning needs of a vocabulary: the tokens' bytes, one after another, and which tokens start with a space."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.spaced = np.array([t[:1] == b" " for t in tokens])
        generator = np.random.default_rng(len(tokens))
        self.mix = generator.integers(1, 1 << 63, len(tokens), np.uint64)


def stretched(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def faithful(ids: np.ndarray, sizes: np.ndarray, side: Side, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each document's tokens (`sizes` of them) have exactly the bytes of its text; `ends` are the ends of the texts in `text`."""
    last = np.cumsum(sizes)
    reached = np.concatenate([[0], np.cumsum(side.length[ids])])
    same = reached[last] - reached[last - sizes] == np.diff(ends, prepend=0)
    kept = np.repeat(same, sizes)
    found = side.bytes[stretched(side.start[ids[kept]], side.length[ids[kept]])]
    own = text[np.repeat(same, np.diff(ends, prepend=0))]
    wrong = np.searchsorted(np.cumsum(np.diff(ends, prepend=0)[same]), np.flatnonzero(found != own), side="right")
    same[np.flatnonzero(same)[np.unique(wrong)]] = False
    return same


def hashes(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, side: Side) -> np.ndarray:
    """A 64-bit number per window from its ids and their places."""
    place = np.arange(len(ids)) - np.repeat(starts, sizes)
    mixed = (side.mix[ids] ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)


def remembered(a: np.ndarray, b: np.ndarray, a_starts, a_sizes, b_starts, b_sizes, one: Side, other: Side) -> tuple[np.ndarray, np.ndarray]:
    """(first, at): one window for each tuple of ids, and for each window its place among those. Equal hashes are compared by their ids."""
    _, first, at = np.unique(hashes(a, a_starts, a_sizes, one) + np.uint64(3) * hashes(b, b_starts, b_sizes, other), return_index=True, return_inverse=True)
    model = first[at]
    same = (a_sizes == a_sizes[model]) & (b_sizes == b_sizes[model])
    for ids, starts, sizes in ((a, a_starts, a_sizes), (b, b_starts, b_sizes)):
        size = np.where(same, sizes, 0)
        differs = ids[stretched(starts, size)] != ids[stretched(starts[model], size)]
        same[np.unique(np.searchsorted(np.cumsum(size), np.flatnonzero(differs), side="right"))] = False
    odd = np.flatnonzero(~same)  # another tuple of the same hash: a window of its own
    at[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), at


class Spelled:
    """Ids as text, each followed by what comes next in a group."""

    def __init__(self, one: Side, other: Side):
        self.texts = [f"{i}{c}" for side, last in ((one, "|"), (other, ";")) for c in (",", last) for i in range(len(side.length))]
        self.base = (0, len(one.length), 2 * len(one.length), 2 * len(one.length) + len(other.length))
        self.size = np.array([len(t) for t in self.texts], np.int64)


def window_alignments(a: np.ndarray, b: np.ndarray, a_sizes, b_sizes, one: Side, other: Side, spelled: Spelled):
    """For windows one after another: numbers of groups and of links, the linked pairs, and the groups as text."""
    ends, others = np.cumsum(one.length[a]), np.cumsum(other.length[b])
    total = ends[-1]
    is_end, is_other = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    is_end[ends], is_other[others] = True, True
    # Between two neighbouring ends of either side lies exactly one link.
    cuts = np.flatnonzero(is_end | is_other)
    i, j = np.searchsorted(ends, cuts), np.searchsorted(others, cuts)
    pairs = a[i].astype(np.int32) * SHIFT + b[j]
    window_ends = ends[np.cumsum(a_sizes) - 1]
    links = np.diff(np.searchsorted(cuts, window_ends, side="right"), prepend=0)
    shared = np.flatnonzero(is_end & is_other)
    groups = np.diff(np.searchsorted(shared, window_ends, side="right"), prepend=0)
    # Within a group come its A ids, then its B ids.
    a_last, b_last = is_other[ends], is_end[others]
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_upto, b_upto = np.cumsum(np.bincount(a_group)), np.cumsum(np.bincount(b_group))
    words = np.empty(len(a) + len(b), np.int64)
    words[np.arange(len(a)) + (b_upto - np.bincount(b_group))[a_group]] = np.where(a_last, spelled.base[1], spelled.base[0]) + a
    words[np.arange(len(b)) + a_upto[b_group]] = np.where(b_last, spelled.base[3], spelled.base[2]) + b
    written = "".join(map(spelled.texts.__getitem__, words.tolist()))
    stops = np.cumsum(spelled.size[words])[np.cumsum(a_sizes + b_sizes) - 1].tolist()
    return groups, links, pairs, [written[p : q - 1] for p, q in zip([0, *stops], stops, strict=False)]


def documents(a_ids: list, b_ids: list, texts: list[bytes], one: Side, other: Side, spelled: Spelled):
    """Per document: (tokens of A and B, groups, links, hash of the groups) or zeros, its different pairs in order, how often it holds each, and where they end."""
    sizes, others = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    figures = np.zeros((len(texts), 4), np.int64)
    digests = [""] * len(texts)
    nothing = np.zeros(0, np.int32)
    if not sizes.any():
        return figures, digests, nothing, nothing, np.zeros(len(texts), np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    text_ends = np.cumsum([len(t) for t in texts])
    a, b = (np.concatenate([np.asarray(x, np.int64) for x in ids]) for ids in (a_ids, b_ids))
    kept = faithful(a, sizes, one, text, text_ends) & faithful(b, others, other, text, text_ends) & (sizes > 0)
    a, b, own = a[np.repeat(kept, sizes)], b[np.repeat(kept, others)], np.flatnonzero(kept)
    if not len(own):
        return figures, digests, nothing, nothing, np.zeros(len(texts), np.int64)
    ends, stops = np.cumsum(one.length[a]), np.cumsum(other.length[b])
    is_end = np.zeros(ends[-1] + 1, bool)
    is_end[ends] = True
    j = np.flatnonzero(is_end[stops])  # B tokens whose end is an A token's end too
    i = np.searchsorted(ends, stops[j])
    document_ends = ends[np.cumsum(sizes[own]) - 1]
    is_last = np.zeros(ends[-1] + 1, bool)
    is_last[document_ends] = True
    following = one.spaced[a[np.minimum(i + 1, len(a) - 1)]] & other.spaced[b[np.minimum(j + 1, len(b) - 1)]]
    anchor = following | is_last[stops[j]]
    i, j = i[anchor] + 1, j[anchor] + 1
    a_sizes, b_sizes = np.diff(i, prepend=0), np.diff(j, prepend=0)
    first, at = remembered(a, b, i - a_sizes, a_sizes, j - b_sizes, b_sizes, one, other)
    windows = a[stretched((i - a_sizes)[first], a_sizes[first])], b[stretched((j - b_sizes)[first], b_sizes[first])]
    groups, links, pairs, written = window_alignments(*windows, a_sizes[first], b_sizes[first], one, other, spelled)
    upto = np.searchsorted(ends[i - 1], document_ends, side="right")  # windows up to each document's end
    ended = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[at])])[upto], prepend=0)
    figures[own] = np.stack([sizes[own], others[own], ended(groups), ended(links)], 1)
    said = np.array(written, object)[at].tolist()
    for k, (p, q) in zip(own.tolist(), zip([0, *upto.tolist()], upto.tolist(), strict=False), strict=True):
        digests[k] = hashlib.sha256(";".join(said[p:q]).encode()).hexdigest()
    held = pairs[stretched((np.cumsum(links) - links)[at], links[at])].astype(np.int64)
    codes, times = np.unique((np.repeat(own, figures[own, 3]) << 32) | held, return_counts=True)
    return figures, digests, (codes & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32), np.searchsorted(codes >> 32, np.arange(len(texts)), side="right")


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row: its different linked pairs and how often it holds each."""
    with open(byte_bpe, "rb") as one, open(piece_bpe, "rb") as other:
        files = one.read(), other.read()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def work(batches):
        a_model, b_model = ByteBPE(shared.value[0]), PieceBPE(shared.value[1])
        one, other = Side(a_model.bytes), Side(b_model.bytes)
        spelled = Spelled(one, other)
        for batch in batches:
            for start, end in steps(batch.column("text"), STEP):
                texts = [t or "" for t in batch.column("text").slice(start, end - start).to_pylist()]
                a_ids, b_ids = [a_model.encode(" " + t) if t else [] for t in texts], b_model.encode(texts)
                figures, digests, pairs, times, ends = documents(a_ids, b_ids, [b" " + t.encode() if t else b"" for t in texts], one, other, spelled)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pairs, times)]
                counted = [pa.array(figures[:, k]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, end - start), *counted, pa.array(digests), *lists], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many rows each pair is linked, and whether no pair of its A id is in more."""

    def counted(held):
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def work(batches):
        held, size = [], 0
        for batch in batches:
            codes = batch.column("pairs").flatten().to_numpy()
            if not len(codes):
                continue
            held.append(np.unique(codes, return_counts=True))
            size += len(held[-1][0])
            if size > HELD:
                held = [counted(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0], pa.int32()), pa.array(held[0][1], pa.int64())], names=["pair", "docs"])
                    held, size = [], 0
        if held:
            codes, counts = counted(held)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(counts, pa.int64())], names=["pair", "docs"])

    total = cut_lineage(found.select("pairs").mapInArrow(work, "pair int, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    a_id = F.shiftright("pair", 15)
    top = total.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("most"))
    return total.join(top, a_id == F.col("a_id")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def weighed(found: DataFrame, counts: DataFrame, pairs: int, held: int = PAIRS, tasks: int | None = None) -> DataFrame:
    """`found` (with a column `key`, unique) with n_best and count_sum; `pairs` is the number of rows of `counts`."""
    blocks = max(1, math.ceil(pairs / held))
    tasks = tasks or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, math.ceil(tasks / blocks))  # copies of each block's counts, so that documents spread over all tasks
    own = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    # Pairs sort by A id, so multiplying a pair's hash keeps no id together; a block has about `pairs / blocks` pairs.
    block = lambda pair: F.pmod(F.hash(pair), F.lit(blocks))
    sides = counts.select(
        F.lit(None).cast("long").alias("key"), block(F.col("pair")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.array("pair").alias("pairs"), F.array(F.when(F.col("best"), F.col("docs")).otherwise(-F.col("docs"))).alias("times"),
    )
    lane = F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int").alias("lane")
    if blocks == 1:
        parts = found.select("key", F.lit(0).alias("block"), lane, "pairs", F.col("times").cast("array<long>").alias("times")).where(F.size("pairs") > 0)
    else:
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        dealt = found.select("key", each.alias("block"), lane, F.arrays_zip("pairs", "times").alias("z"))
        dealt = dealt.select("key", "block", "lane", F.filter("z", lambda z: F.pmod(F.hash(z["pairs"]), F.lit(blocks)) == F.col("block")).alias("z")).where(F.size("z") > 0)
        parts = dealt.select("key", "block", "lane", F.col("z.pairs").alias("pairs"), F.col("z.times").cast("array<long>").alias("times"))
    dealt = sides.unionByName(parts).repartition(blocks * lanes, "block", "lane").sortWithinPartitions("block", "lane", F.col("key").asc_nulls_first())

    def flat(batch, column):
        return batch.column(column).flatten().to_numpy()

    def work(batches):
        at, codes, docs, known = None, [], [], None
        for batch in batches:
            places = list(zip(batch.column("block").to_pylist(), batch.column("lane").to_pylist(), batch.column("key").is_null().to_pylist(), strict=True))
            start = 0
            while start < len(places):  # runs of one block and lane, of counts or of documents
                end = start
                while end < len(places) and places[end] == places[start]:
                    end += 1
                part, (block, lane, is_count) = batch.slice(start, end - start), places[start]
                start = end
                if at != (block, lane):
                    at, codes, docs, known = (block, lane), [], [], None
                if is_count:
                    codes.append(flat(part, "pairs"))
                    docs.append(flat(part, "times"))
                    continue
                if known is None:
                    known, value = np.concatenate(codes), np.concatenate(docs)
                    order = np.argsort(known)
                    known, value = known[order], value[order]
                    codes, docs = [], []
                sizes = np.diff(part.column("pairs").offsets.to_numpy())
                of = np.repeat(np.arange(len(part)), sizes)
                times, weight = flat(part, "times"), value[np.searchsorted(known, flat(part, "pairs"))]
                best = np.zeros(len(part), np.int64)
                total = np.zeros(len(part), np.int64)
                np.add.at(best, of, np.where(weight > 0, times, 0))
                np.add.at(total, of, times * np.abs(weight))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(best), pa.array(total)], names=["key", "n_best", "count_sum"])

    sums = dealt.mapInArrow(work, "key long, n_best long, count_sum long").groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    joined = found.select("key", *own).join(sums.hint("merge"), "key", "left")
    return joined.select(*own, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, held: int = PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row."""
    found = cut_lineage(aligned(docs, doc_id, text, byte_bpe, piece_bpe).withColumn("key", F.monotonically_increasing_id()), "aligned")
    counts = cut_lineage(pair_counts(found), "counts")
    return weighed(found, counts, counts.count(), held).withColumnRenamed("id", doc_id)
