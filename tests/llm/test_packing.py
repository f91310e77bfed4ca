import random

import pytest
from pyspark.sql import functions as F

from waypost.llm import packing, queries


def check(sizes, sources, clusters, capacity, per_source, bins):
    """Every item is in the tightest compatible open bin of the time."""
    left, held = [], []
    for size, source, cluster, got in zip(sizes, sources, clusters, bins, strict=True):
        fit = [
            left[b]
            for b in range(len(left))
            if left[b] >= size and (cluster < 0 or cluster not in [c for _, c in held[b]]) and [s for s, _ in held[b]].count(source) < per_source
        ]
        if not fit:
            assert got == len(left)
            left.append(capacity)
            held.append([])
        else:
            assert left[got] == min(fit)
            assert cluster < 0 or cluster not in [c for _, c in held[got]]
            assert [s for s, _ in held[got]].count(source) < per_source
        left[got] -= size
        held[got].append((source, cluster))
        assert left[got] >= 0


@pytest.mark.parametrize("per_source", [1, 2, 3])
def test_best_fit(per_source):
    rng = random.Random(per_source)
    for _ in range(30):
        n = rng.randint(0, 150)
        sizes = sorted((rng.randint(1, 50) for _ in range(n)), reverse=True)
        sources, clusters = [rng.choice([0, 0, 1, 2, 3]) for _ in sizes], [rng.choice([-1, -1, 0, 1, 2]) for _ in sizes]
        check(sizes, sources, clusters, 50, per_source, packing.best_fit(sizes, sources, clusters, 50, per_source))


def test_documents(documents):
    rows = packing.pack_documents(documents).toPandas()
    items = packing.items_of(documents).toPandas().set_index("doc_id")
    assert rows.groupby("doc_id")["words"].sum().to_dict() == items["size"].to_dict()
    filled = rows[rows.words > 0]
    assert (filled.groupby("bin_id")["words"].sum() == filled.groupby("bin_id")["bin_words"].first()).all() and filled.bin_words.max() <= packing.CAPACITY
    filled = filled.join(items[["cluster"]], on="doc_id")
    assert filled.groupby(["bin_id", "source"]).size().max() <= packing.PER_SOURCE
    assert filled.groupby(["bin_id", "cluster"]).size().max() == 1
    for _, own in filled.sort_values("first_word").groupby("doc_id"):
        assert own.first_word.tolist() == [0, *own.words.cumsum().tolist()[:-1]]


def test_near_copies_share_no_bin(spark, tmp_path):
    words = [f"w{i}" for i in range(100)]
    texts = [words, [*words[:-1], "x"], [w.upper() for w in words], [f"other{i}" for i in range(100)], words]
    rows = [(i if i < 4 else None, " ".join(t), f"s{i}") for i, t in enumerate(texts)] + [(9, None, "s9")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.bin_id for r in queries.op4_pack_documents(spark, str(tmp_path)).collect()}
    assert len({got[i] for i in (0, 1, 2)}) == 3 and got[3] in {got[i] for i in (0, 1, 2, None)} and got[9] is None
    assert got[None] not in {got[i] for i in (0, 1, 2)}


def test_odd_rows(odd):
    rows = packing.pack_documents(odd, capacity=1000).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.words, r.bin_words))
    assert sum(w for w, _ in by[6]) == 30_000 and len(by[6]) == 30
    assert by[3] == by[4] == by[5] == [(0, None)]
    bins = [r.bin_id for r in rows if r.doc_id in (1, 2)]
    assert len(bins) == len(set(bins)) == 3  # copies, also a repeated row, never share a bin
    assert len(by[None]) == 2


def test_empty_table(none):
    assert packing.pack_documents(none).count() == 0


def test_many_equal_rows_are_spread(spark):
    """Equal rows, of one cluster, lie in many shards and each in a bin of its own; a shard stays small."""
    rows = spark.range(20_000).selectExpr("1L doc_id", "'a' source", "7L cluster", "700L size")
    others = spark.range(3000).selectExpr("id + 10 doc_id", "'b' source", "cast(null as long) cluster", "300L size")
    packed = packing.pack(rows.unionAll(others), shard_documents=1000).cache()
    equal = packed.where("doc_id = 1")
    assert equal.count() == 20_000 == equal.select("bin_id").distinct().count()
    assert packed.groupBy("doc_id").agg(F.sum("words").alias("w")).where("doc_id > 1 and w != 300").count() == 0
    shards = packed.groupBy(F.shiftright("bin_id", 32).alias("shard")).count().collect()
    assert len(shards) == 23 and max(r["count"] for r in shards) < 5000
    again = packing.pack(rows.unionAll(others).repartition(5), shard_documents=1000)
    assert again.exceptAll(packed).count() == 0
