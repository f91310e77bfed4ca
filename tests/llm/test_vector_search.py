import math
import random

import numpy as np
import pandas as pd
import pytest

from waypost.llm import vector_search
from waypost.llm.vector_search import top_k

SCHEMA = "vec_id long, embedding array<double>, score long, rank string"


def brute(rows, every, k):
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in {w for w in whole if w[0] % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)  # noqa: B905
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def result(spark, rows, every=50, k=5, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, every, k, **more).collect()}


@pytest.mark.parametrize("clustered", [True, False])
def test_exact(spark, clustered):
    rng = random.Random(clustered)
    centers = [[rng.gauss(0, 3) for _ in range(12)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1 if clustered else 3) for c in rng.choice(centers)]) for i in range(600)]
    assert result(spark, rows, candidate_block=100, query_block=4) == brute(rows, 50, 5)


def test_share_that_is_evaluated():
    """Clustered vectors are hardly evaluated, evenly spread ones almost all; the floor of a sample helps in every block."""
    rng = np.random.default_rng(6)
    shares = {}
    for kind in ("clustered", "even"):
        x = np.floor(256 * (rng.normal(0, 3, (20, 32))[rng.integers(0, 20, 3000)] + rng.normal(0, 0.05, (3000, 32)) if kind == "clustered" else rng.normal(0, 1, (3000, 32))))
        pivots = vector_search.pick_pivots(x[:1024], 32)
        table = pd.DataFrame({"vec_id": np.arange(3000), "v": [r.astype(int).tolist() for r in x]})
        table = next(vector_search._distances(pivots, np.arange(1024), x[:1024], 50, 5)([table])).assign(query_key=0)
        asked = table[table.vec_id % 50 == 0]
        shares[kind] = sum(vector_search.best_of_block(asked, table[at : at + 500], 5).attrs["evaluated"] for at in range(0, 3000, 500)) / (len(asked) * 3000)
    assert shares["clustered"] < 0.25 and shares["even"] <= 1, shares


def test_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(60)]
    rows += [(100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (None, [1.0, 1.0]), (300, []), (350, [0.5, 1.0]), (350, [0.5, 1.0])]
    assert result(spark, rows) == brute(rows, 50, 5)


def test_large_components_and_lengths(spark):
    rows = [(0, [1e6 + 0.3, 2e6, 3.0]), (1, [1e6, -1e6]), (2, [3e6 + 0.7]), (3, [-1e6, 5.0, 7.0, 9.0])]
    assert result(spark, rows, every=1, k=2) == brute(rows, 1, 2)


def test_few_or_none(spark):
    assert result(spark, [(0, [1.0])]) == set()
    assert result(spark, [(0, [1.0]), (7, [2.0])]) == {(0, 1, 7, 256 * 512)}
    assert result(spark, [(100, None)]) == set()


def test_given_vectors(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df).collect()} == brute(rows, 50, 5)
