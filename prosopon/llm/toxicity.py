"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding undoes disguise: accents and look-alike letters become plain letters, and digits or signs inside a word become the letters they
stand for. Entries are whole words and word beginnings. `learn_entries` weighs them from labelled texts: every entry's
texts are counted on the executors, and those that are significantly tied to the label (likelihood ratio) are kept with their log odds.
Phrases of an entry and a neighbouring word that are significantly harmless become exceptions: a match inside one counts nothing.
A text's weight is the sum over its different matched words of the best entry's weight, times 1 + ln(how often), divided by
1 + ln(1 + words); an entry weighs the lower end of a 90 % interval around its log odds. A logistic curve fitted to a
histogram of all learned texts turns it into a score from 0 to 1. The text is read twice: for the words of the
texts to learn from, and for the matches of all texts.

Defined results: a null, empty or blank text has weight 0; without labels, or with labels of one kind only, the lexicon is empty and every
score is the smoothed share of the label; a null label is not learned from, of repeated labels the largest counts; a null id is scored and not learned
from; only id and text are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.llm.common import map_batches, shared, steps
from prosopon.session import cut_lineage

#: Word beginnings of these lengths are entries, beside whole words.
BEGINNINGS = (4, 5, 6)
#: Entries and exceptions matched in one pass over the texts. It bounds what is broadcast; more of them take more passes.
BLOCK = 20_000
#: An entry counts if it is in LEAST_TEXTS texts with the label, if PRECISION of its texts have it, and if chance alone would give its
#: likelihood ratio to one in exp(MARGIN / 2) lexicons: the bar rises with the number of entries tried.
LEAST_TEXTS, PRECISION, MARGIN = 3, 0.8, 14.0
BINS, BIN_WIDTH = 2048, 0.02
#: Rows counted together inside a task.
STEP_ROWS = 500

#: Letters that look like a Latin letter.
LOOKALIKES = dict(zip("абвеіїјкмнорсѕтухԁԛԝοαερτυικνηχгѵ", "abbeiijkmhopcstyxdqwoaeptuiknnxrv", strict=True))
#: Digits and signs that stand for a letter inside a word.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
TABLE = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in "­​‌‍⁠﻿"}
SIGNS = re.compile(r"(?<=[^\W\d_])[0134578 9@$!|]+(?=[^\W\d_])".replace(" ", "") + r"|(?<![\w@$!|])[0134578@$]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]{1,2}(?![\w@$])")
STAND_TABLE = str.maketrans(STANDS_FOR)
DISGUISED = re.compile("[" + "".join(map(chr, TABLE)) + "]")
HINT = re.compile(r"[0134578@$!|]")
MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]+")
#: Everything in ASCII but letters parts words; what folding leaves beyond ASCII counts as letters.
PARTS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str | None) -> str:
    """Lower case without accents, disguise or digits in words; l counts as i, since 1 and | may mean either."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text.translate(TABLE) if DISGUISED.search(text) else text))
    if HINT.search(text):
        text = SIGNS.sub(lambda m: m.group().translate(STAND_TABLE), text)
    return text.replace("l", "i")


def words_of(folded: str) -> list[str]:
    return folded.encode("utf-8", "replace").translate(PARTS).decode().split()


def entries_of(word: str) -> list[str]:
    """A whole word is written with a closing blank, a beginning without."""
    return [word + " "] + [word[:n] for n in BEGINNINGS if n <= len(word)]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # entry -> weight
    exceptions: frozenset[str] = frozenset()  # "word word"
    slope: float = 0.0
    level: float = 0.0
    positive: int = 0  # texts learned from, with the label and without
    negative: int = 0
    bar: float = 0.0  # least likelihood ratio

    def automaton(self):
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            made.add_word(" " + entry, weight)
        made.make_automaton()
        return made

    def blocks(self, size: int) -> list[Lexicon]:
        """Lexicons of about `size` entries, cut between entries that differ in their first letters; at least one."""
        parts: list[dict[str, float]] = [{}]
        last = None
        for entry in sorted(self.weights):
            begins = entry[: BEGINNINGS[0]]
            if len(parts[-1]) >= size and begins != last:
                parts.append({})
            parts[-1][entry] = self.weights[entry]
            last = begins
        return [replace(self, weights=p, exceptions=frozenset()) for p in parts]

    def matches(self, automaton, text: str | None) -> tuple[int, list[tuple[str, str, str, float]]]:
        """Number of words, and (word before, word, word after, weight) of each match; exceptions are not looked at."""
        words = words_of(fold(text))
        if not words or not self.weights:
            return len(words), []
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        for end, weight in automaton.iter(line):
            start = line.rfind(" ", 0, end if line[end] == " " else end + 1) + 1
            best[start] = max(best.get(start, -math.inf), weight)
        found = []
        for start, weight in best.items():
            stop = line.index(" ", start)
            before = line[line.rfind(" ", 0, start - 1) + 1 : start - 1] if start > 1 else ""
            after = line[stop + 1 : line.find(" ", stop + 1)] if stop + 1 < len(line) else ""
            found.append((before, line[start:stop], after, weight))
        return len(words), found

    def weight(self, words: int, matches: list[dict]) -> float:
        """The normalised weight of matches outside exceptions."""
        weights: dict[str, float] = {}
        times: dict[str, int] = {}
        for m in matches:
            if f"{m['before']} {m['word']}" not in self.exceptions and f"{m['word']} {m['after']}" not in self.exceptions:
                weights[m["word"]] = m["weight"]
                times[m["word"]] = times.get(m["word"], 0) + 1
        return sum(w * (1 + math.log(times[word])) for word, w in weights.items()) / (1 + math.log1p(words))

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * raw + self.level))))


def ratio(a, b, positive, negative):
    """Signed likelihood ratio of `a` of `positive` texts against `b` of `negative` ones, as a column or number."""
    total, both = positive + negative, a + b

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = part(a, both * positive / total) + part(b, both * negative / total) + part(positive - a, (total - both) * positive / total)
    g = 2 * (g + part(negative - b, (total - both) * negative / total))
    return F.when(a * negative > b * positive, g).otherwise(-g)


def counted(rows: DataFrame, column: str, units) -> DataFrame:
    """(entry, a, b): texts with and without the label in which each of `units(value)` occurs; each step adds up its rows first."""

    def work(batches):
        for batch in batches:
            labels, values = batch.column("label").to_pylist(), batch.column(column)
            for start in range(0, len(batch), STEP_ROWS):
                seen: dict[str, list[int]] = {}
                for label, value in zip(labels[start : start + STEP_ROWS], values.slice(start, STEP_ROWS).to_pylist(), strict=True):
                    for unit in units(value):
                        count = seen.get(unit)
                        if count is None:
                            count = seen[unit] = [0, 0]
                        count[1 - label] += 1
                with_label, without = ([x[k] for x in seen.values()] for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(with_label, pa.int64()), pa.array(without, pa.int64())], names=["entry", "a", "b"])

    return rows.select("label", column).mapInArrow(work, "entry string, a bigint, b bigint").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """The different folded words of each text, as one string in place of the text: all that counting entries needs."""

    def work(batches):
        for batch in batches:
            column = batch.column(text)
            yield batch, [[" ".join(sorted(set(words_of(fold(t))))) for a, b in steps(column) for t in column.slice(a, b - a).to_pylist()]]

    return map_batches(docs, work, f"{text} string")


def marked(rows: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """`rows` that have a label, with `label` 0 or 1. Labels grow with the documents, so both sides are sorted at every size."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("marked")).agg((F.max(label) != 0).cast("long").alias("label"))
    return rows.join(marks.hint("merge"), rows[doc_id] == marks.marked).drop("marked")


def learn_entries(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """The entries and their weights, from all of `docs` that have a label."""
    own = docs.select(doc_id, text)
    positive, negative = marked(own.select(doc_id), labels, doc_id, label).agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first()
    if not positive or not negative:
        return Lexicon(level=math.log((positive + 0.5) / (negative + 0.5)), positive=positive, negative=negative)
    rows = marked(with_words(own, text), labels, doc_id, label)
    tried = cut_lineage(counted(rows, text, lambda words: {e for w in words.split() for e in entries_of(w)}).where(F.col("a") >= LEAST_TEXTS), "entries")
    bar = 2 * math.log(max(1, tried.count())) + MARGIN
    doubt = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    odds = F.log((F.col("a") + 0.5) / (positive - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (negative - F.col("b") + 0.5)) - 1.64 * doubt
    precise = F.col("a") >= PRECISION * (F.col("a") + F.col("b"))
    kept = tried.withColumn("g", ratio(F.col("a"), F.col("b"), positive, negative)).where((F.col("g") >= bar) & precise).withColumn("odds", odds)
    return Lexicon({r.entry: r.odds for r in kept.orderBy("entry").collect()}, positive=positive, negative=negative, bar=bar)


def match(docs: DataFrame, lexicon: Lexicon, text: str = "text", block: int = BLOCK) -> DataFrame:
    """`docs` with n_words and matches. Entries are matched in blocks; all entries that can match one word share their first letters and so a block."""
    found = None
    for part in lexicon.blocks(block):
        before = docs if found is None else cut_lineage(found.withColumnRenamed("matches", "earlier"), "matched-block")
        found = match_block(before, part, text)
        if "earlier" in before.columns:
            found = found.withColumn("matches", F.concat("earlier", "matches")).drop("earlier")
    return found


def match_block(docs: DataFrame, lexicon: Lexicon, text: str) -> DataFrame:
    held = shared(docs.sparkSession, lexicon)
    made: list = []

    def work(batches):
        if not made:
            made.append(held().automaton())
        for batch in batches:
            column = batch.column(text)
            found = [held().matches(made[0], t) for a, b in steps(column) for t in column.slice(a, b - a).to_pylist()]
            yield batch, [[n for n, _ in found], [[dict(zip(("before", "word", "after", "weight"), m, strict=True)) for m in ms] for _, ms in found]]

    return map_batches(docs, work, "n_words bigint, matches array<struct<before:string,word:string,after:string,weight:double>>")


def learn_curve(matched: DataFrame, labels: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", label: str = "toxic") -> Lexicon:
    """`lexicon` with exceptions and curve, from all rows of `matched` that have a label."""
    if not lexicon.positive or not lexicon.negative:
        return lexicon
    rows = cut_lineage(marked(matched.select(doc_id, "n_words", "matches"), labels, doc_id, label).drop(doc_id), "matched")

    def phrases_of(matches):
        return {p for m in matches for p in (f"{m['before']} {m['word']}", f"{m['word']} {m['after']}")}

    tied = ratio(F.col("a"), F.col("b"), lexicon.positive, lexicon.negative)
    harmless = counted(rows.where(F.size("matches") > 0), "matches", phrases_of).withColumn("g", tied).where(F.col("g") <= -lexicon.bar)
    found = replace(lexicon, exceptions=frozenset(r.entry for r in harmless.collect()))
    bins = weighed(rows, found).groupBy("label", F.least(F.lit(BINS - 1), F.round(F.greatest(F.col("toxic_weight"), F.lit(0.0)) / BIN_WIDTH)).cast("int").alias("bin")).count().collect()
    found.slope, found.level = curve(np.array([(r.bin * BIN_WIDTH, r.label, r["count"]) for r in sorted(bins)], float))
    return found


def weighed(matched: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of `match` with score, predicted and toxic_weight."""
    held = shared(matched.sparkSession, lexicon)

    def work(batches):
        for batch in batches:
            raw = [held().weight(n, m) for n, m in zip(batch.column("n_words").to_pylist(), batch.column("matches").to_pylist(), strict=True)]
            scores = [held().score(r) for r in raw]
            yield batch, [scores, [int(s >= 0.5) for s in scores], raw]

    return map_batches(matched, work, "score double, predicted int, toxic_weight double")


def curve(points: np.ndarray) -> tuple[float, float]:
    """(slope, level) of the logistic curve through (weight, label, texts), by Newton's method with a small penalty on the slope."""
    x, y, n = points.T
    slope, level = 1.0, -1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + level, -60, 60)))
        w = n * p * (1 - p) + 1e-9
        gradient = np.array([(n * (y - p) * x).sum() - 0.01 * slope, (n * (y - p)).sum()])
        curved = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(curved, gradient), -2, 2)
        slope, level = slope + step[0], level + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(level)


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, n_words, matches, score, predicted, toxic_weight) of every row; only rows where `learn_from` holds lend their labels."""
    lexicon = learn_entries(docs.where(learn_from), labels, doc_id, text, label)
    matched = cut_lineage(match(docs.select(doc_id, text), lexicon, text).drop(text), "matches")
    return weighed(matched, learn_curve(matched.where(learn_from), labels, lexicon, doc_id, label))
