"""Exact top-k inner products with a table of distances to pivots.

Vectors become integers, floor(256 * x). With distances d(., p) to pivots p,
the triangle inequality bounds the distance of query and candidate from below
by the largest |d(q, p) - d(c, p)|, and so the inner product
(|q|^2 + |c|^2 - d(q, c)^2) / 2 from above. Candidates are evaluated in order
of that bound until it falls below the k-th best score; ties are evaluated, so
the result is exact.

Distances to pivots are computed once per vector and written. So is a floor for
every query: its k-th best score among a bounded sample of vectors, which the
result cannot be below, so that candidates whose bound is less are left out from
the start in every block. Queries and candidates are dealt into blocks of
bounded size and every pair of blocks is one task's work, which keeps k rows a
query; the best k over all blocks follow from a window. Pivots are picked from
the same sample; which ones they are changes the speed only.

How much is left out depends on the vectors: almost all candidates where they
lie in clusters, almost none where they are spread evenly in many dimensions,
for then all distances are nearly the same and no bound tells them apart.

Defined cases: vectors that are null or empty or hold a null or non-finite
component take no part, nor do rows with a null vec_id. Vectors of different
length are compared as if the shorter had zeros behind it, very long ones too.
A vec_id that is divisible by the step and occurs on several different rows is
a query with each; equal rows are one query. No row with the query's vec_id is
its candidate. An empty table, or one without queries, gives an empty result.
Only vec_id and embedding are read, so further columns may bear any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

PIVOTS = 32
#: Vectors collected to pick pivots from.
PIVOT_SAMPLE = 1024
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 2048
_BEST = "query_id long, query_key long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding) -> vec_id, v (array of long), of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from each other: each next one is farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    least = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _floors(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A value that the k best scores of each row are not below, by the rows of ``sample``."""
    scores = x @ sample.T
    scores[ids[:, None] == sample_ids] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(x), -np.inf)
    best = np.partition(scores, -k, axis=1)[:, -k]
    return best - (1e-9 * ((x * x).sum(1) + (sample * sample).sum(1).max()) + 1e-3)


def _distances(pivots: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, every: int, k: int):
    def add(batches):
        for batch in batches:
            lists = batch["v"].tolist()
            width = max([sample.shape[1], *map(len, lists)])
            x, p, known = _matrix(lists, width), np.zeros((len(pivots), width)), np.zeros((len(sample), width))
            p[:, : pivots.shape[1]], known[:, : sample.shape[1]] = pivots, sample
            square = (x * x).sum(1)
            apart = np.maximum(square[:, None] + (p * p).sum(1) - 2 * (x @ p.T), 0)
            ids = batch["vec_id"].to_numpy()
            floors, asked = np.full(len(x), -np.inf), ids % every == 0
            if asked.any():
                floors[asked] = _floors(ids[asked], x[asked], sample_ids, known, k)
            yield batch.assign(to_pivots=list(np.sqrt(apart)), floor=floors)

    return add


def best_of_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block of candidates for each of a block of queries; ``evaluated`` of the result's attrs counts scores."""
    if not len(queries) or not len(candidates):
        return pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}, dtype="int64")
    c_lists, q_lists = candidates["v"].tolist(), queries["v"].tolist()
    width = max(map(len, c_lists + q_lists))
    c, q = _matrix(c_lists, width), _matrix(q_lists, width)
    exact = np.abs(c).max() * np.abs(q).max() * width < 2**53  # then doubles hold every partial sum
    ids = candidates["vec_id"].to_numpy()
    c_far = np.ascontiguousarray(np.stack(candidates["to_pivots"].to_numpy()).T)
    q_far = np.stack(queries["to_pivots"].to_numpy())
    c_square, q_square = (c * c).sum(1), (q * q).sum(1)
    found, evaluated = [], 0
    for i, (qid, key, floor) in enumerate(zip(queries["vec_id"], queries["query_key"], queries["floor"], strict=True)):
        apart = np.zeros(len(c))
        for p in range(len(c_far)):
            np.maximum(apart, np.abs(c_far[p] - q_far[i, p]), out=apart)
        scale = q_square[i] + c_square
        bound = (scale - apart * apart) / 2 + 1e-9 * scale + 1e-3  # above any rounding of what it is made of
        bound[(ids == qid) | (bound < floor)] = -np.inf
        order = np.argsort(-bound)
        best: list[tuple[int, int]] = []
        at, step = 0, 64
        while at < len(order):
            rows = order[at : at + step]
            rows = rows[bound[rows] > -np.inf]
            if not len(rows) or (len(best) == k and bound[rows[0]] < -best[-1][0]):
                break
            if exact:
                scores = (c[rows] @ q[i]).astype(np.int64).tolist()
            else:
                scores = [_whole(q_lists[i], c_lists[r]) for r in rows.tolist()]
            evaluated += len(rows)
            own = ids[rows].tolist()
            best = sorted([*best, *((-s, v) for s, v in zip(scores, own, strict=True))])[:k]
            at, step = at + step, step * 2
        found += [(qid, key, v, -s) for s, v in best]
    out = pd.DataFrame(found, columns=["query_id", "query_key", "vec_id", "score"])
    out.attrs["evaluated"] = evaluated
    return out


def _whole(a, b) -> int:
    """The inner product in whole numbers, held within 64 bits."""
    return max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=False))))


def top_k(
    embeddings: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """Rows whose vec_id is divisible by ``every``, against all: query_id, rank, vec_id, score."""
    vectors = integer_vectors(embeddings)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).select("vec_id", "v").toPandas()
    lists = sample["v"].tolist()
    known = _matrix(lists, max(map(len, lists), default=1))
    picked = pick_pivots(known, pivots) if len(known) else np.zeros((1, 1))
    add = _distances(picked, sample["vec_id"].to_numpy(), known, every, k)
    table = written(vectors.mapInPandas(add, "vec_id long, v array<long>, to_pivots array<double>, floor double"), "pivot-table")
    asked = table.where(F.col("vec_id") % every == 0).withColumn("query_key", F.xxhash64("v")).dropDuplicates(["vec_id", "query_key"])
    asked = written(asked, "queries")
    c_blocks = max(1, -(-table.count() // candidate_block))
    q_blocks = max(1, -(-asked.count() // query_block))
    block = lambda n, *by: F.pmod(F.xxhash64(*by, F.lit(9)), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "query_key", "v", "to_pivots", "floor", block(q_blocks, "vec_id", "query_key").alias("qb"), every_block(c_blocks).alias("cb"))
    right = table.select("vec_id", "v", "to_pivots", block(c_blocks, "vec_id", "v").alias("cb"), every_block(q_blocks).alias("qb"))
    best = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(lambda a, b: best_of_block(a, b, k), _BEST)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
