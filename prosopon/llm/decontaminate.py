"""Benchmark decontamination by suffix arrays over the training text.

Inside a task, the words of a stretch of whole documents form one sequence of numbers; words that no benchmark item has are 0 and
end every match. The suffix array holds all suffixes that may contain a window (those with enough benchmark words
ahead), sorted by their first `window` words, packed several to a 64-bit key. Every suffix of every item is binary-searched
in it; the matching suffixes give the locations, and neighbouring locations on one diagonal join to the longest verbatim
matches. Words are compared, not hashes: the result is exact.

The benchmark is read in blocks of BLOCK_BYTES. A block is broadcast, all documents pass it, and the result is written to the
shared folder before the next block, so that any benchmark size works with one block in memory.

Defined results: null and wordless texts have no words and no matches, null and wordless items have no windows; an item
with a null id is searched and left out of the list of items; equal items are found under each of their ids; repeated rows each get
their result; an empty table on either side gives no matches; other columns are kept, and those named like a result
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.llm.common import map_batches, steps, text_bytes
from prosopon.session import cut_lineage

WINDOW = 13
BLOCK_BYTES = 8_000_000
#: Upper case to lower case, everything in ASCII that is neither letter nor digit to a blank.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
MATCHES = "array<struct<item_id:string,item_word:int,doc_word:int,words:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Suffixes:
    """All windows of one block of items, packed for binary search."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        tokens = [words_of(text) for _, text in items]
        self.ids = [i for i, _ in items]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for t in tokens for w in t), 1)}
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = 64 // self.bits
        self.keys = -(-window // self.per_key)
        self.depth = self.keys * self.per_key
        at = [(n, j, min(window, len(t))) for n, t in enumerate(tokens) if t for j in range(len(t) - min(window, len(t)) + 1)]
        self.item, self.word, self.length = (np.array([x[k] for x in at], np.int64) for k in range(3))
        self.shortest = int(self.length.min()) if at else 0
        low = np.zeros((len(at), self.depth), np.uint64)
        high = np.full((len(at), self.depth), (1 << self.bits) - 1, np.uint64)
        number = [np.array([self.vocabulary[w] for w in t], np.uint64) for t in tokens]
        for row, (n, j, size) in enumerate(at):
            low[row, :size] = high[row, :size] = number[n][j : j + size]
        self.low, self.high = self._packed(low), self._packed(high)
        self._once()

    def _once(self) -> None:
        """Windows that an item repeats are searched once, from the first place: else repetitive items and texts would multiply."""
        order = np.lexsort([self.word, *self.low, self.item])
        new = np.ones(len(order), bool)
        new[1:] = self.item[order][1:] != self.item[order][:-1]
        for key in self.low:
            new[1:] |= key[order][1:] != key[order][:-1]
        kept = np.sort(order[new])
        self.item, self.word, self.length = self.item[kept], self.word[kept], self.length[kept]
        self.low, self.high = ([key[kept] for key in keys] for keys in (self.low, self.high))

    def _packed(self, words: np.ndarray) -> list[np.ndarray]:
        keys = []
        for k in range(self.keys):
            key = np.zeros(len(words), np.uint64)
            for c in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << np.uint64(self.bits)) | words[:, c]
            keys.append(key)
        return keys

    def suffix_array(self, sequence: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions of the suffixes that can hold a window, sorted, and their keys."""
        stops = np.flatnonzero(sequence == 0)
        ahead = np.diff(np.concatenate([[-1], stops]))  # length of each stretch of known words, its stop included
        left = np.repeat(stops, ahead) - np.arange(len(sequence))
        at = np.flatnonzero(left >= self.shortest)
        longer = np.concatenate([sequence, np.zeros(self.depth, sequence.dtype)]).astype(np.uint64)
        keys = []
        for k in range(self.keys):
            key = np.zeros(len(at), np.uint64)
            for c in range(k * self.per_key, (k + 1) * self.per_key):
                key = (key << np.uint64(self.bits)) | longer[at + c]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        return at[order], [key[order] for key in keys]

    def search(self, keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """For every test suffix, the first place in the array that is not before it (or is after it)."""
        low, high = np.zeros(len(self.item), np.int64), np.full(len(self.item), len(keys[0]), np.int64)
        for _ in range(len(keys[0]).bit_length()):
            middle = np.minimum((low + high) // 2, len(keys[0]) - 1)
            less, equal = np.zeros(len(middle), bool), np.ones(len(middle), bool)
            for key, want in zip(keys, wanted, strict=True):
                here = key[middle]
                less |= equal & (here < want)
                equal &= here == want
            right = (less | equal if after else less) & (low < high)
            low, high = np.where(right, middle + 1, low), np.where(right | (low >= high), high, middle)
        return low

    def matches(self, sequence: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, word of the item, position in the sequence, words) of the longest verbatim matches."""
        empty = (np.empty(0, np.int64),) * 4
        if not len(self.item):
            return empty
        suffixes, keys = self.suffix_array(sequence)
        if not len(suffixes):
            return empty
        first, last = self.search(keys, self.low, False), self.search(keys, self.high, True)
        count = last - first
        test = np.repeat(np.arange(len(count)), count)
        if not len(test):
            return empty
        place = np.arange(len(test)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        position, item, word, size = suffixes[place], self.item[test], self.word[test], self.length[test]
        order = np.lexsort((position, position - word, item))
        position, item, word, size = position[order], item[order], word[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (item[1:] != item[:-1]) | (position[1:] - word[1:] != position[:-1] - word[:-1]) | (position[1:] != position[:-1] + 1)
        start = np.flatnonzero(new)
        run = np.diff(np.concatenate([start, [len(order)]]))
        return item[start], word[start], position[start], run - 1 + size[start]


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    block, held = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null").toLocalIterator():
        if held and held + len(row.t) > limit:
            yield block
            block, held = [], 0
        block.append((row.i, bytes(row.t)))
        held += len(row.t)
    yield block


def find(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int, text: str) -> DataFrame:
    """`docs` with n_words and new_matches against one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    made: list[Suffixes] = []

    def work(batches):
        if not made:
            made.append(Suffixes(shared.value, window))
        tests = made[0]
        number = tests.vocabulary.get
        for batch in batches:
            counts, found = [], []
            column = batch.column(text)
            for a, b in steps(column):
                ids, starts, at = [], [], 0
                for one in text_bytes(column.slice(a, b - a)):
                    words = words_of(one)
                    counts.append(len(words))
                    starts.append(at)
                    at += len(words) + 1
                    ids += [np.fromiter(map(number, words, repeat(0)), np.int64, len(words)), np.zeros(1, np.int64)]
                item, word, position, size = tests.matches(np.concatenate(ids))
                doc = np.searchsorted(starts, position, side="right") - 1
                found.append((doc + a, item, word, position - np.array(starts)[doc], size))
            doc, item, word, position, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5
            order = np.lexsort((word, item, position, doc))
            offsets = np.searchsorted(doc[order], np.arange(len(batch) + 1))
            columns = [pa.array([tests.ids[i] for i in item[order].tolist()], pa.string())] + [pa.array(x[order].astype(np.int32)) for x in (word, position, size)]
            matches = pa.StructArray.from_arrays(columns, names=["item_id", "item_word", "doc_word", "words"])
            yield batch, [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), matches)]

    return map_batches(docs, work, f"n_words bigint, new_matches {MATCHES}")


def covered(matches: Column) -> Column:
    """Words inside any match; matches are in order of their first word."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def step(held, match):
        end = match["doc_word"] + match["words"]
        new = F.greatest(end - F.greatest(match["doc_word"], held["to"]), F.lit(0))
        return F.struct((held["n"] + new).alias("n"), F.greatest(end, held["to"]).alias("to"))

    return F.aggregate(matches, start, step, lambda held: held["n"])


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, matches (item, its word, the document's word, length), n_hit, items (distinct ids) and contaminated."""
    found, count = docs, 0
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        found = cut_lineage(found, "contamination") if count else found
        result = find(found, items, window, text)
        found = result.withColumn("matches", F.concat("matches", "new_matches") if count else F.col("new_matches")).drop("new_matches")
        count += 1
    by_word = F.array_sort("matches", lambda x, y: x["doc_word"] - y["doc_word"]) if count > 1 else F.col("matches")
    found = found.withColumn("n_hit", covered(by_word))
    found = found.withColumn("items", F.array_sort(F.array_compact(F.array_distinct(F.col("matches.item_id")))))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    clash = set(docs.columns) & {"n_words", "matches", "new_matches", "n_hit", "items", "contaminated"}
    kept = search(docs.withColumn("kept_row", F.struct("*")) if clash else docs, benchmark, **options).where(~F.col("contaminated"))
    return kept.select("kept_row.*") if clash else kept.select(docs.columns)
