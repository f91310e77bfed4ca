import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waypost.llm import prefix_trie


def brute(rows):
    """Rows (conv_id, turn, role, text) -> the nodes by (smallest member, depth)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, sums = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[p] for p in children[path]]
        last = len(path[-1][1]) if path else 0
        sums[path] = (sum(s[0] for s in below) or 1, sum(s[1] for s in below) + (len(members[path]) - 1) * last)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[min(members[path]), len(path)] = (parent, len(members[path]), len(children[path]), *sums[path], hashlib.sha256(ends.encode()).hexdigest())
    return out


def check(spark, rows, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], "conv_id long, turn long, role string, text string" + ", depth int, p string, size string" * bool(extra))
    got = prefix_trie.prefix_trie(df.repartition(3)).collect()
    assert {(r.conv_id, r.depth): tuple(r)[2:] for r in got} == brute(rows) and len(got) == len(brute(rows))


def made(n, rng, depth):
    words = ["hi", "héé", "", None, "yes \U0001f600"]
    return [(c, t, rng.choice(["user", "user", None]), rng.choice(words[: 1 + t % 5])) for c in rng.sample(range(-150, 900), n) for t in range(rng.randint(1, depth))]


@pytest.mark.parametrize("band", [2, 3, 16])
def test_all_nodes(spark, monkeypatch, band):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    rng = random.Random(band)
    rows = made(120, rng, 9) + [(100, 50 + t, "user", "hi") for t in range(40)]
    check(spark, rows)


def test_odd_rows_and_ids_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 8)
    rows = [(c, 0, "user", "same") for c in range(60)] + [(None, 1, "user", "x"), (200, None, None, None), (200, None, None, None), (200, 3, "a", "b"), (200, None, "", "x" * 50_000)]
    rows += [(107, 0, "user", "gone"), (10**12, 0, "user", "far"), (-5, 0, "user", "same")]
    check(spark, rows, (1, "clash", "clash"))


def test_hot_parents_are_looked_up(spark):
    rows = [(c, t, "user", f"{c} {t}" if t else "same") for c in range(1200) for t in range(2)]
    check(spark, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], df.schema)).count() == 0


def test_a_long_conversation_lies_in_many_partitions(spark, monkeypatch):
    spread = prefix_trie.scans.ranged
    monkeypatch.setattr(prefix_trie.scans, "ranged", lambda df, by, order: spread(df, by, order).withColumn("_part", F.floor(F.col("turn") / 7).cast("int")))
    check(spark, [(c, t, "user", f"t{t}") for c in (0, 1, 2, 7) for t in range(60)])
