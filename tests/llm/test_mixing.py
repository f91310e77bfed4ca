import random

import pytest
from pyspark.sql import functions as F

from waypost.llm.mixing import mix_sources, sainte_lague, source_targets


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_sainte_lague(spark, seats):
    rng = random.Random(seats)
    rows = [(f"g{i % 3}", f"k{i:02}", float(rng.choice([0, 1, 5, 5, 100, 1000, 3333]))) for i in range(40)]
    got = {(r.g, r.k): r.q for r in sainte_lague(spark.createDataFrame(rows, "g string, k string, w double"), ["g"], "w", F.lit(seats), ["k"], "q").collect()}
    for g in ("g0", "g1", "g2"):
        own = [(k, w) for h, k, w in rows if h == g]
        won = dict.fromkeys((k for k, _ in own), 0)
        for _ in range(seats):
            won[min((-w / (2 * won[k] + 1), k) for k, w in own)[1]] += 1
        assert {k: got[g, k] for k in won} == won


@pytest.mark.parametrize("seats", [0, 5, 60, 200, 10_000])
def test_sainte_lague_with_bounds(spark, seats):
    rng = random.Random(seats)
    rows = [(f"k{i:02}", float(rng.choice([1, 5, 5, 100, 333])), rng.choice([0, 1, 3, 20, 50])) for i in range(25)]
    df = spark.createDataFrame(rows, "k string, w double, m int")
    got = {r.k: r.q for r in sainte_lague(df, [], "w", F.lit(seats), ["k"], "q", F.col("m")).collect()}
    won = dict.fromkeys((k for k, _, _ in rows), 0)
    for _ in range(seats):
        open_ = [(-w / (2 * won[k] + 1), k) for k, w, m in rows if won[k] < m]
        if open_:
            won[min(open_)[1]] += 1
    assert got == won


def reshared(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess again and again."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[n] for n in full)
        open_ = sum(w[n] for n in names if n not in full)
        t = {n: 2 * sizes[n] if n in full else left * w[n] / open_ for n in names}
        more = {n for n in names if n not in full and t[n] > 2 * sizes[n]}
        if not more:
            return t
        full |= more


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 90_000]) for i in range(rng.randint(1, 12))} | {None: rng.choice([0, 77])}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    if sum(sizes.values()):
        assert got == pytest.approx(reshared(sizes))


def test_documents(documents):
    a, b = (mix_sources(documents).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b)
    assert (a.taken <= 2 * a["size"]).all() and (a.taken >= 0).all() and len(a) == documents.count()
    by = a.join(documents.select("doc_id", "source").toPandas().set_index("doc_id"), on="doc_id").groupby("source")
    sums = by.agg(size=("size", "sum"), given=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.given).all()
    assert sums.target.to_dict() == pytest.approx(reshared(sums["size"].to_dict()))
    assert ((sums.taken - sums.target).abs() <= 0.01 * sums.target + 16).all()


def test_shards_share_exactly(documents):
    rows = mix_sources(documents, block_words=8, shard_words=500).toPandas().join(documents.select("doc_id", "source").toPandas().set_index("doc_id"), on="doc_id")
    sums = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((sums.taken - sums.target).abs() <= 0.03 * sums.target).all() and (rows.taken <= 2 * rows["size"]).all()


def brute(rows, block_words, shard_words, seed=17):
    """The documented steps one by one: rows (doc_id, source, size, hashes) of one shard a source -> taken."""
    sizes = {}
    for _, source, size, *_ in rows:
        sizes[source] = sizes.get(source, 0) + size
    targets = reshared(sizes)
    names = sorted(n for n in sizes if n is not None) + ([None] if None in sizes else [])
    blocks = dict.fromkeys(names, 0)
    for _ in range(round(sum(targets.values()) / block_words)):
        blocks[max(names, key=lambda n: (targets[n] / (2 * blocks[n] + 1), -names.index(n)))] += 1
    taken = {}
    for name in names:
        own = sorted((h, i, t, size) for i, source, size, t, h, _ in rows if source == name and size)
        stream = [i for _, i, _, size in own for _ in range(size)]
        count = -(-len(stream) // block_words)
        if not count:
            continue
        shift = next(s for _, source, size, _, _, s in rows if source == name and size) % count
        quota = min(blocks[name], 2 * count)
        extra = quota % count
        for b in range(count):
            times = quota // count + ((b + shift + 1) * extra // count > (b + shift) * extra // count)
            for i in stream[b * block_words : (b + 1) * block_words]:
                taken[i] = taken.get(i, 0) + times
    return {i: taken.get(i, 0) for i, *_ in rows}


@pytest.mark.parametrize("block_words", [1, 4, 16])
def test_against_brute_force(spark, block_words):
    rng = random.Random(block_words)
    texts = [(i, f"s{rng.choice([0, 0, 0, 1, 2, 3])}" if i % 9 else None, " ".join("w" * rng.randint(0, 60))) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id long, source string, text string")
    rows = df.select(
        "doc_id", "source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("size"), F.xxhash64("text").alias("h")
    ).select("*", F.xxhash64("doc_id", "h", F.lit(18)).alias("seeded"), F.xxhash64("source", F.lit(0).cast("long"), F.lit(19)).alias("start"))
    got = {r.doc_id: r.taken for r in mix_sources(df, block_words=block_words).collect()}
    assert got == brute([tuple(r) for r in rows.collect()], block_words, 1 << 17)


def test_small_sources_come_near_their_targets(spark):
    rows = [(i, "big", "word " * 50) for i in range(100)] + [(1000, "small", "ten words " * 5), (1001, "tiny", "one")]
    got = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[1000].target == 20 and got[1000].taken >= 16 and got[1001].target == 2 and 1 <= got[1001].taken <= 2


def test_odd_rows(odd, none):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken <= 2 * r.size for r in rows)
    assert {(r.size, r.taken) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 0)}
    assert mix_sources(none).count() == 0
