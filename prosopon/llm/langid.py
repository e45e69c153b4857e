"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased whole text, runs of non-letters being one blank. Document
frequencies count every learnable document, on the executors. The classifier is trained by follow-the-regularised-leader
(FTRL-proximal with L1 and L2 penalties) on a sample drawn by a hash of the id: about `sample_rows` learnable documents of all, but of each
language about LEAST_ROWS, or all it has if fewer. The languages are those of all learnable documents, so the sample holds about
`sample_rows` + LEAST_ROWS x languages rows at most. A fifth of it only sets the temperature that calibrates the scores; a language that
has no row in the other four is learned from that fifth. Every document is scored in Arrow batches.

Defined results: null text and text without a letter are `und` with score 0; with no learnable document at all, everything is `und`;
with one language, every text with letters has it, with score 1; equal scores go to the first language in code point order; a null id
is not learned from and not held out; other columns are kept, and those named like a result column are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.llm.common import map_batches, shared, steps

BITS = 15
LENGTHS = (1, 2, 3)
SAMPLE_ROWS = 4000
#: Rows to draw of a language that has less than its share of the sample.
LEAST_ROWS = 50
UNKNOWN = "und"
#: Any word character that is not a digit or underscore; checked again with isalpha, which a few numerals fail.
LETTER = re.compile(r"[^\W\d_]")
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in LETTER.finditer(text))


def folded(text: str) -> np.ndarray:
    """Code points in lower case; each run of ASCII characters that are no letters is one blank, also at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points >= 128) | ((points >= 97) & (points <= 122))
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return points[keep]


def frequencies(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a text, ascending."""
    points = folded(text)
    counts = np.zeros(1 << bits, np.int64)
    for n in LENGTHS:
        if len(points) < n:
            continue
        code = np.full(len(points) - n + 1, n, np.uint32)
        for k in range(n):
            code = (code ^ points[k : len(points) - n + 1 + k]) * np.uint32(MULTIPLIERS[k])
        counts += np.bincount(code >> np.uint32(32 - bits), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features and a bias, by language
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[at]
        size = np.sqrt(x @ x)
        return x / size if size else x

    def probabilities(self, text: str) -> np.ndarray:
        at, counts = frequencies(text)
        return softmax((self.vector(at, counts) @ self.weights[at] + self.weights[-1]) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> np.ndarray:
    """Weights (features + bias, classes) after `epochs` passes over (indices, values, class)."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, features), np.append(x, 1.0)
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
            z[at] += g - more / alpha * w
            n[at] += g * g
    return weights(z, n)


def calibrated(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    a, b, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    while b - a > 1e-3:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame, bits: int = BITS) -> np.ndarray:
    """In how many texts each feature occurs; each task adds up its own rows first."""

    def count(batches):
        seen = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for a, b in steps(batch.column(0)):
                for text in batch.column(0).slice(a, b - a).to_pylist():
                    seen[frequencies(text, bits)[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["feature", "texts"])

    found = np.zeros(1 << bits, np.int64)
    for r in docs.mapInArrow(count, "feature int, texts bigint").groupBy("feature").agg(F.sum("texts").alias("texts")).collect():
        found[r.feature] = r.texts
    return found


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> Model:
    """The model from the rows of `docs` where `learn` holds and text and language are given."""
    rows = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    draw = F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"), F.min(draw).alias("lowest")).collect()
    total = sum(r.n for r in sizes)
    if not total:
        return Model([], np.zeros((1, 0)), np.zeros(0))
    languages = sorted(r.lang for r in sizes)
    # Whatever the hashes, the row of the lowest one is drawn.
    limits = [(r.lang, max(sample_rows / total, LEAST_ROWS / r.n, math.nextafter(r.lowest, 2.0))) for r in sizes]
    limits = docs.sparkSession.createDataFrame(limits, "limit_lang string, draw_limit double")
    part, place = F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(5)), F.xxhash64(doc_id)
    sample = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), part.alias("fold"), place.alias("place"), draw.alias("draw"))
    sample = sample.join(limits, (F.col("lang") == F.col("limit_lang")) & (F.col("draw") < F.col("draw_limit"))).select("text", "lang", "fold", "place")

    def features(batches):
        for batch in batches:
            found = [frequencies(t, bits) for a, b in steps(batch.column(0)) for t in batch.column(0).slice(a, b - a).to_pylist()]
            at, counts = ([x[k].astype(np.int32) for x in found] for k in range(2))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("fold"), batch.column("place"), pa.array(at, kind), pa.array(counts, kind)], names=["lang", "fold", "place", "at", "counts"])

    drawn = sample.mapInArrow(features, "lang string, fold bigint, place bigint, at array<int>, counts array<int>").toArrow().sort_by("place")
    seen = document_frequencies(rows.select(text), bits)
    model = Model(languages, np.zeros(((1 << bits) + 1, len(languages))), np.log((1 + total) / (1 + seen)) + 1)
    if len(languages) > 1:
        data = []
        for place in range(drawn.num_rows):
            at, counts = (drawn.column(c)[place].values.to_numpy() for c in ("at", "counts"))
            data.append((at, model.vector(at, counts), languages.index(drawn.column("lang")[place].as_py()), drawn.column("fold")[place].as_py()))
        learned = {d[2] for d in data if d[3]}
        model.weights = ftrl([d[:3] for d in data if d[3] or d[2] not in learned], 1 << bits, len(languages))
        rest = [d for d in data if not d[3]]
        scores = np.array([x @ model.weights[at] + model.weights[-1] for at, x, _, _ in rest]).reshape(-1, len(languages))
        model.temperature = calibrated(scores, np.array([d[2] for d in rest], int))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    held = shared(docs.sparkSession, model)

    def work(batches):
        for batch in batches:
            column = batch.column(text)
            found = [held().predict(t) for a, b in steps(column) for t in column.slice(a, b - a).to_pylist()]
            yield batch, [[x[0] for x in found], [x[1] for x in found]]

    return map_batches(docs, work, "lang_pred string, score double")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """`docs` with held_out, lang_pred and score; the third of the ids whose fold is 1 is held out from learning."""
    part = fold(F.col(doc_id), 3)
    found = predict(docs, train(docs, part != 1, text, lang, doc_id, **options), text)
    return found.withColumn("held_out", F.coalesce(part == 1, F.lit(False)))


def accepted(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents whose language is told with a score of `least` or more, with their own columns."""
    clash = set(docs.columns) & {"held_out", "lang_pred", "score"}
    found = identify(docs.withColumn("kept_row", F.struct("*")) if clash else docs, **options)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select("kept_row.*") if clash else kept.select(docs.columns)
