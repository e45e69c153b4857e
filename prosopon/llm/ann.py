"""Nearest neighbours by collision-counting hashing over query-centred windows.

Every vector is projected on `PROJECTIONS` random lines; per shard and line, the projections are kept as a sorted array. A query opens a window
of half-width WIDTH * R / 2 around its own projection on every line. A vector inside the windows of at least `THRESHOLD` lines is
verified. R then grows by the factor GROWTH (virtual rehashing: the windows widen, only the newly covered stretches are counted), until
the k-th best verified vector lies within R. A vector at distance R collides on a line with probability 0.826 and so reaches the threshold
with probability 0.93, a nearer one sooner; as every shard finds its own k, those of all shards together lie well within
the shards' R. Nothing is cut off: the worst case verifies all vectors.

Largest inner product becomes nearest distance by one more coordinate, sqrt(M^2 - |x|^2), M being the largest norm; the query has 0 there
and is scaled to norm M. Rows are dealt to shards by a hash; queries meet every shard in blocks, and each
query's best k per shard are merged by a ranking that keeps k rows before the shuffle.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors meet only vectors of the
same length; rows equal in id and vector count as one; every different row with a query id is a query of its own;
null ids are candidates, last among ties, and no queries; with fewer than k candidates all are returned; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosopon.session import cut_lineage

PROJECTIONS, THRESHOLD = 40, 30
WIDTH, GROWTH = 2.719, 1.1
#: Relative error of a product in single precision, with a wide margin; closer calls are decided in double precision.
CLOSE = 1e-4
SHARD_ROWS, QUERY_ROWS = 8192, 4096
#: Queries that a shard searches together, and vectors from which the first radius is guessed.
TOGETHER, SAMPLE = 128, 256


def eligible(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    vector = F.col("vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = rows.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    return own.where(vector.isNotNull() & (F.size("vector") > 0)).where(finite).where(F.exists("vector", lambda x: x != 0))


class Shard:
    """The sorted arrays of one shard."""

    def __init__(self, vectors: np.ndarray, norm: float):
        self.vectors = vectors
        self.single = vectors.astype(np.float32)
        self.norm = norm
        rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
        self.points = np.column_stack([vectors, rest])
        self.lines = np.random.default_rng(11).standard_normal((self.points.shape[1], PROJECTIONS))
        hashes = self.points @ self.lines
        self.order = np.argsort(hashes, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(hashes, self.order.T, axis=0).T.copy()

    def nearest(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, (place, score) of verified vectors, among them the k of largest inner product without place `own`.

        All queries widen their windows together; the ends of the windows are searched per line for all of them at once.
        """
        count, asked = len(self.vectors), len(queries)
        length, short = np.sqrt((queries * queries).sum(axis=1)), queries.astype(np.float32)
        scaled = np.column_stack([queries * (self.norm / length)[:, None], np.zeros(asked)])
        centre = (scaled @ self.lines).T
        some = self.points[:: max(1, count // SAMPLE)]
        apart = 2 * self.norm * self.norm - 2 * scaled @ some.T
        apart[apart < 1e-9 * self.norm * self.norm] = np.inf
        nearest = apart.min(axis=1)
        radius = np.where(np.isfinite(nearest), 0.8 * np.sqrt(nearest), self.norm)
        hits, done = np.zeros((asked, count), np.int64), np.zeros((asked, count), bool)
        done[np.flatnonzero(own >= 0), own[own >= 0]] = True
        low = high = None
        found: list[list] = [[np.empty(0, np.int64)] for _ in range(asked)]
        scores, distances = ([[np.empty(0)] for _ in range(asked)] for _ in range(2))
        active = np.arange(asked)
        while len(active):
            half = WIDTH * radius[active] / 2
            to_low = np.stack([s.searchsorted(c[active] - half, "left") for s, c in zip(self.sorted, centre, strict=True)], axis=1)
            to_high = np.stack([s.searchsorted(c[active] + half, "right") for s, c in zip(self.sorted, centre, strict=True)], axis=1)
            ended = np.zeros(len(active), bool)
            for n, q in enumerate(active.tolist()):
                a, b, sign = to_low[n].tolist(), to_high[n].tolist(), 1
                if low is None and sum(b) - sum(a) > len(self.order) * count / 2:  # fewer lie outside the windows
                    new = [o[:x] for o, x in zip(self.order, a, strict=True)] + [o[y:] for o, y in zip(self.order, b, strict=True)]
                    hits[q] = len(self.order)
                    sign = -1
                elif low is None:
                    new = [o[x:y] for o, x, y in zip(self.order, a, b, strict=True)]
                else:
                    new = [o[x:y] for o, x, y in zip(self.order, a, low[q].tolist(), strict=True)] + [o[x:y] for o, x, y in zip(self.order, high[q].tolist(), b, strict=True)]
                hits[q] += sign * np.bincount(np.concatenate(new), minlength=count)
                at = np.flatnonzero((hits[q] >= THRESHOLD) & ~done[q])
                if len(at):
                    done[q, at] = True
                    score = self.single[at] @ short[q]
                    found[q].append(at)
                    scores[q].append(score)
                    distances[q].append(np.sqrt(np.maximum(2 * self.norm * (self.norm - score / length[q]), 0)))
                ended[n] = sum(int((d <= radius[q]).sum()) for d in distances[q]) >= k or done[q].all()
            if low is None:
                low, high = np.zeros((asked, len(self.order)), np.int64), np.zeros((asked, len(self.order)), np.int64)
            low[active], high[active] = to_low, to_high
            active = active[~ended]
            radius[active] *= GROWTH
        best = []
        for q in range(asked):
            at, rough = np.concatenate(found[q]), np.concatenate(scores[q])
            if len(at) > k:
                at = at[rough >= np.partition(rough, -k)[-k] - CLOSE * self.norm * length[q]]
            best.append((at, (self.vectors[at] * queries[q]).sum(axis=1)))
        return best


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def search(rows: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest by inner product; `is_query` is a condition on the column `id`."""
    data = cut_lineage(eligible(rows, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.size("vector")), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    groups = data.groupBy("size").agg(
        F.sqrt(F.max(square)).alias("norm"),
        F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"),
        F.ceil(F.count(F.when(is_query, 1)) / QUERY_ROWS).cast("int").alias("blocks"),
    )
    groups = cut_lineage(groups.where("blocks > 0"), "vector-groups")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("row", F.lit(n)), F.col(n)).cast("int")
    sized = data.join(groups, "size")
    stored = sized.withColumn("shard", place("shards")).withColumn("block", each("blocks")).drop("shards", "blocks")
    keys = ["size", "shard", "block"]
    asked = sized.where(is_query).withColumn("block", place("blocks")).withColumn("shard", each("shards"))
    asked = asked.select(*(F.col(c).alias(f"asked_{c}") for c in (*keys, "id", "row", "vector")))
    kind = rows.schema[vec_id].dataType

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_row", pa.int64()), ("query_id", right.schema.field("asked_id").type), ("vec_id", right.schema.field("asked_id").type), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        shard = Shard(matrix(left.column("vector")), left.column("norm")[0].as_py())
        ids, at = left.column("id").combine_chunks(), {r: i for i, r in enumerate(left.column("row").to_pylist())}
        key = np.empty(len(ids), np.int64)
        key[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        questions, found, scores = [], [], []
        queries, own = matrix(right.column("asked_vector")), np.array([at.get(row, -1) for row in right.column("asked_row").to_pylist()])
        for start in range(0, len(queries), TOGETHER):
            for q, (places, score) in enumerate(shard.nearest(queries[start : start + TOGETHER], k, own[start : start + TOGETHER]), start):
                best = np.lexsort((key[places], -score))[:k]
                questions.append(np.full(len(best), q))
                found.append(places[best])
                scores.append(score[best])
        q = pa.array(np.concatenate(questions))
        columns = [right.column("asked_row").take(q), right.column("asked_id").take(q), ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(columns, schema=schema)

    found = stored.groupBy(*keys).cogroup(asked.groupBy(*(f"asked_{c}" for c in keys))).applyInArrow(compare, f"query_row bigint, query_id {kind.simpleString()}, vec_id {kind.simpleString()}, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
