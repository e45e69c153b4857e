"""Quality classification by positive-unlabelled learning.

A text becomes a vector of shape statistics (character classes, words, lines, repeats). Trusted positives are the learnable rows that
`labels` marks 1; the unlabelled text is every learnable row, whatever its label, so labels of 0 are never learned from.
Three steps, each over all rows in the feature table:

1. a logistic regression of positives against unlabelled text;
2. the class prior: the share of unlabelled text over the share of positives, both above a bound on that score, at the bound where this ratio
   is lowest with its confidence interval (best bin), on a fifth of the rows that step 1 has not seen;
3. the classifier: the non-negative unbiased risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  with logistic loss
   and an L2 penalty, by Newton steps. Where the second part is negative, the next step makes it grow instead, as the non-negative
   estimator asks. With logistic loss the decision value is the log odds of the label, so its logistic is the score.

Texts are read once, for their features; each Newton step is one pass over the feature table, in which every task adds up its rows and
Spark adds up the tasks. The driver holds one matrix of FEATURES x FEATURES numbers.

Defined results: null, empty and blank texts are scored like any other (no words, no characters); a null id is scored and belongs to no
fold, so it lends no label but counts as unlabelled text; of repeated labels the largest counts, null labels and labels of unknown ids are
left out; without positives every score is 0, and with no unlabelled row but positives there is the positive's own prior; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosopon.llm.common import steps, text_bytes
from prosopon.session import cut_lineage

#: Classes of a UTF-8 byte: lower, upper, digit, blank, line break, other control, beyond ASCII, and each ASCII sign on its own.
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CLASSES = 7 + len(SIGNS)
CLASS = np.full(256, 5, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[32, 9]], CLASS[[10, 13]], CLASS[128:] = 0, 1, 2, 3, 4, 6
CLASS[np.frombuffer(SIGNS, np.uint8)] = np.arange(7, CLASSES)
SHAPES = ("words", "word length", "spread of word length", "different words", "repeated word", "capital words", "words ending in two signs", "signs before blanks",
    "line length", "different lines", "lines without end mark", "runs of three", "most frequent byte", "entropy", "one-byte words", "empty", "longest word")
FEATURES = CLASSES + len(SHAPES) + 1  # and the constant 1
PENALTY = 2e-3
#: Newton steps at most; they end when the risk falls by less than ENOUGH.
STEPS, ENOUGH = 25, 1e-5
#: Bins of the histogram for the prior and the confidence that its best bin asks for.
BINS, RISK = 400, 0.1
PRIOR_RANGE = (0.01, 0.99)


def features(text: bytes) -> np.ndarray:
    """Shape statistics of a text, each between 0 and about 10."""
    found = np.zeros(FEATURES, np.float32)
    found[-1] = 1.0
    words = text.split()
    if not words:
        found[CLASSES + SHAPES.index("empty")] = 1.0
        return found
    points = np.frombuffer(text, np.uint8)
    kinds = CLASS[points]
    share = np.bincount(kinds, minlength=CLASSES) / len(points)
    found[:CLASSES] = np.log1p(200 * share)
    n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x]
    counts = np.bincount(points, minlength=256) / len(points)
    sign, gap = kinds >= 7, (kinds == 3) | (kinds == 4)
    same = points[1:] == points[:-1]
    ends = sum(x.rstrip()[-1:] in b".!?:;" for x in lines)
    found[CLASSES:-1] = (
        math.log1p(n), math.log1p(lengths.mean()), math.log1p(lengths.std()), len(set(words)) / n * 4,
        math.log1p(200 * sum(map(operator.eq, words, words[1:])) / n), math.log1p(200 * sum(map(bytes.isupper, words)) / n),
        math.log1p(200 * np.count_nonzero(sign[:-2] & sign[1:-1] & gap[2:]) / n), math.log1p(200 * np.count_nonzero(sign[:-1] & gap[1:]) / n),
        math.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)) * 4, (1 - ends / max(1, len(lines))) * 4,
        math.log1p(200 * np.count_nonzero(same[1:] & same[:-1]) / len(points)), counts.max() * 10, -float(counts[counts > 0] @ np.log(counts[counts > 0])),
        math.log1p(200 * np.count_nonzero(lengths == 1) / n), 0.0, math.log1p(lengths.max()),
    )
    return found


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `features` in place of the text."""
    kept = [f for f in docs.schema if f.name not in (text, "features")]

    def work(batches):
        for batch in batches:
            column = batch.column(text)
            for a, b in steps(column):
                rows = np.array([features(t) for t in text_bytes(column.slice(a, b - a))], np.float32)
                made = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, FEATURES, dtype=np.int32), rows.reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(f.name).slice(a, b - a) for f in kept] + [made], names=[f.name for f in kept] + ["features"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(work, f"{schema}, features array<float>")


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def added_up(rows: DataFrame, size: int, work) -> np.ndarray:
    """The sum over all rows of `work(features, positive)`, a vector of `size` numbers per batch; tasks add up first."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += work(matrix(batch.column("features")), batch.column("positive").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["place", "total"])

    found = np.zeros(size)
    for r in rows.select("features", "positive").mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
        found[r.place] = r.total
    return found


def spread(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over the unlabelled rows; (unlabelled, positive) numbers of rows."""

    def work(x, positive):
        u = x[~positive]
        return np.concatenate([u.sum(0), (u * u).sum(0), [len(u), positive.sum()]])

    got = added_up(rows, 2 * FEATURES + 2, work)
    counts = got[-2:]
    mean = got[:FEATURES] / max(1, counts[0])
    deviation = np.sqrt(np.maximum(got[FEATURES:-2] / max(1, counts[0]) - mean**2, 0))
    mean[-1], deviation[deviation < 1e-4] = 0.0, np.inf  # a constant feature says nothing
    deviation[-1] = 1.0
    return mean, deviation, counts


def sums(rows: DataFrame, w: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> dict[str, np.ndarray]:
    """Per class of rows (`u`nlabelled, `p`ositive): the losses as +1 and as -1, the mean vector, gradient and curvature of the loss as -1."""
    half = 2 + 2 * FEATURES + FEATURES * FEATURES

    def work(x, positive):
        parts = []
        x = (x - mean) / deviation
        for own in (x[~positive], x[positive]):
            z = own @ w
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            parts += [[np.logaddexp(0, -z).sum(), np.logaddexp(0, z).sum()], own.sum(0), s @ own, ((own * (s * (1 - s))[:, None]).T @ own).ravel()]
        return np.concatenate(parts)

    got = added_up(rows, 2 * half, work)
    found = {}
    for kind, at in (("u", 0), ("p", half)):
        part = got[at : at + half]
        found |= {f"{kind}+": part[0], f"{kind}-": part[1], f"{kind}x": part[2 : 2 + FEATURES], f"{kind}g": part[2 + FEATURES : 2 + 2 * FEATURES]}
        found[f"{kind}h"] = part[2 + 2 * FEATURES :].reshape(FEATURES, FEATURES)
    return found


def newton(rows: DataFrame, mean, deviation, risk) -> np.ndarray:
    """The weights of least `risk(sums) -> (risk, gradient, curvature)`, plus the penalty on all weights but the constant's."""
    penalty = np.full(FEATURES, PENALTY)
    penalty[-1] = 1e-6
    penalty[np.isinf(deviation)] = 1.0  # stays at 0

    def at(w):
        value, gradient, curvature = risk(sums(rows, w, mean, deviation))
        return value + 0.5 * float(penalty @ (w * w)), gradient + penalty * w, curvature + np.diag(penalty + 1e-9)

    w = np.zeros(FEATURES)
    value, gradient, curvature = at(w)
    for _ in range(STEPS):
        step, length = np.linalg.solve(curvature, gradient), 1.0
        while True:
            found = at(w - length * step)
            if found[0] <= value or length < 1e-3:
                break
            length /= 4
        if found[0] > value:
            break
        w, fell = w - length * step, value - found[0]
        value, gradient, curvature = found
        if fell < ENOUGH:
            break
    return w


def apart(counts: np.ndarray):
    """Risk of positives against unlabelled text, both classes weighing the same."""
    n, m = np.maximum(counts, 1)

    def risk(s):
        return s["p+"] / m + s["u-"] / n, s["pg"] / m - s["px"] / m + s["ug"] / n, s["ph"] / m + s["uh"] / n

    return risk


def non_negative(prior: float, counts: np.ndarray):
    """The non-negative unbiased risk with logistic loss."""
    n, m = np.maximum(counts, 1)

    def risk(s):
        as_positive, rest = prior * s["p+"] / m, s["u-"] / n - prior * s["p-"] / m
        rest_gradient = s["ug"] / n - prior * s["pg"] / m
        if rest < 0:  # the estimate of a risk cannot be negative: let it grow
            return as_positive - rest, -rest_gradient, s["uh"] / n + prior * s["ph"] / m
        return as_positive + rest, prior * (s["pg"] - s["px"]) / m + rest_gradient, s["uh"] / n

    return risk


def estimated_prior(rows: DataFrame, w: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, by the best bin."""

    def work(x, positive):
        z = ((x - mean) / deviation) @ w
        place = np.clip((1 / (1 + np.exp(-np.clip(z, -500, 500))) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(place[~positive], minlength=BINS), np.bincount(place[positive], minlength=BINS)]).astype(float)

    got = added_up(rows, 2 * BINS, work).reshape(2, BINS)
    if not got.sum(1).all():
        return PRIOR_RANGE[1]
    n, m = got.sum(1)
    u, p = (np.cumsum(x[::-1])[::-1] / x.sum() for x in got)
    doubt = math.sqrt(math.log(4 / RISK) / 2 / n) + math.sqrt(math.log(4 / RISK) / 2 / m)
    ratio = np.where(p > 0, u / np.maximum(p, 1e-12), np.inf)
    best = int(np.argmin(ratio + doubt / np.maximum(p, 1e-12)))
    return float(np.clip(ratio[best], *PRIOR_RANGE))


def learn(rows: DataFrame) -> dict:
    """The model from rows of `features`, `positive` (trusted, else unlabelled) and `fold` (0 to 4, 0 only for the prior)."""
    mean, deviation, counts = spread(rows)
    if not counts[1]:
        return {"w": None, "mean": mean, "deviation": deviation, "prior": 0.0}
    seen = rows.where("fold <> 0")
    w = newton(seen, mean, deviation, apart(spread(seen)[2]))
    prior = estimated_prior(rows.where("fold = 0"), w, mean, deviation)
    return {"w": newton(rows, mean, deviation, non_negative(prior, counts)), "mean": mean, "deviation": deviation, "prior": prior}


def scored(rows: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """`rows` with score and predicted in place of the features."""
    kept = [f for f in rows.schema if f.name not in ("features", "score", "predicted")]
    w, mean, deviation = (model[k] for k in ("w", "mean", "deviation"))

    def work(batches):
        for batch in batches:
            if w is None or not len(batch):
                score = np.zeros(len(batch))
            else:
                z = ((matrix(batch.column("features")) - mean) / deviation) @ w
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[f.name for f in kept] + ["score", "predicted"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(work, f"{schema}, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of every row; rows where `held_out` is true lend neither label nor text to the model."""
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    table = cut_lineage(featured(base), "features")
    learnable = table.where("not held_out").select("id", "features", F.coalesce(F.pmod(F.xxhash64("id", F.lit("prior")), F.lit(5)), F.lit(1)).alias("fold"))
    trusted = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("marked")).agg(F.max(label).alias("label")).where("label <> 0")
    # Both sides grow with the documents, so they are sorted at every size; rows without id have no label and stay out of the join.
    positives = cut_lineage(learnable.where("id is not null").join(trusted.select("marked").hint("merge"), F.col("id") == F.col("marked"), "left_semi").drop("id"), "positives")
    rows = learnable.select("features", "fold", F.lit(False).alias("positive")).unionByName(positives.select("features", "fold", F.lit(True).alias("positive")))
    return scored(table, learn(rows), threshold).withColumnRenamed("id", doc_id)
