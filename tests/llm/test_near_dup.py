import random
import re
from collections import defaultdict

import numpy as np
import pytest

from waypost.llm import near_dup
from waypost.llm.components import connected_components
from waypost.llm.words import WordHasher, shingle_hashes


def brute(rows):
    """(id, text) -> id: (set size, component)."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    for pair in {(a, b) for own in by.values() for a in own for b in own if a < b}:
        a, b = (sets[x] for x in pair)
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = map(find, pair)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}


def test_documents(documents):
    assert result(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize("block", [1024, 16])
def test_family_of_edits(spark, monkeypatch, block):
    """Many copies at similarities around the limit, also in small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(1000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(words)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_pairs_that_sketches_leave():
    """No pair that is similar enough is ruled out, in one block or two, and of two components one stays."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(250, 401)], rng.integers(0, 2**63, rng.integers(0, 80), dtype=np.uint64)])) for _ in range(60)]
    n = np.array([len(x) for x in sets])
    bits = np.frombuffer(near_dup.sketches(np.concatenate(sets), n).tobytes(), dtype=np.uint64).reshape(60, -1)
    ids, own = np.arange(60), np.ones(60, dtype=bool)
    true = set()
    for i in range(60):
        for j in range(i + 1, 60):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (n[i] + n[j] - both):
                true.add((i, j))
    for block in (np.zeros(60, dtype=int), ids % 2):
        got = set(near_dup.possible_pairs(ids, ids, n, own, block, bits, False))
        meant = {(i, j) for i, j in true if len(set(block.tolist())) == 1 or block[i] != block[j]}
        assert meant <= got and len(got) < len(meant) + 200
        assert len(near_dup.possible_pairs(ids, ids % 3, n, own, np.zeros(60, dtype=int), bits, True)) <= 3


def test_one_id_with_two_texts(spark):
    texts = {"a": " ".join(f"a{i}" for i in range(40)), "b": " ".join(f"b{i}" for i in range(40)), "c": " ".join([f"b{i}" for i in range(39)] + ["c"])}
    df = spark.createDataFrame([(5, texts["a"]), (5, texts["b"]), (7, texts["c"]), (9, texts["a"])], "doc_id long, text string")
    rows = near_dup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(5, 5), (5, 5), (7, 5), (9, 5)]
    assert len({r.first_hash for r in rows}) == 2


def test_odd_rows(odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    named = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None]
    assert sorted({x for x in named if x[0] <= 2}) == [(1, 15, 1, True), (2, 15, 1, False)]
    assert {x for x in named if x[0] in (3, 4, 5)} == {(i, 0, i, True) for i in (3, 4, 5)}
    assert (8, 1, 8, True) in named and (6, 29_996, 6, True) in named
    assert {(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None} == {(4, None, False), (0, None, False)}


def test_empty_table(none):
    assert near_dup.near_duplicates(none).count() == 0


def test_limit_is_inclusive(spark):
    """Sets of 7 shingles each that share 6: 6 of 8 is 0.75."""
    a, b = "a b c d e f g h i j k", "z b c d e f g h i j k"
    assert result(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")) == {1: (7, 1), 2: (7, 1)}
    c = "a b c d e f g h i j y"
    assert result(spark.createDataFrame([(1, a), (2, c)], "doc_id long, text string")) == {1: (7, 1), 2: (7, 1)}
    assert result(spark.createDataFrame([(1, b), (2, c)], "doc_id long, text string")) == {1: (7, 1), 2: (7, 2)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    sig = near_dup.signatures(np.concatenate([common, a, common, b]), np.array([800, 800]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08


def test_signatures_do_not_depend_on_batches():
    values = np.random.default_rng(2).integers(0, 2**63, 100_000, dtype=np.uint64)
    sizes = np.array([1, 70_000, 9, 29_990])
    whole, at = near_dup.signatures(values, sizes, 8), 0
    for i, n in enumerate(sizes):
        assert (near_dup.signatures(values[at : at + n], np.array([n]), 8)[0] == whole[i]).all()
        at += n


def test_word_hashes_match_words():
    texts = ["  Ab ab\tAB\n", "", "x", "été\x0bété  ab", "y " * 400_000]
    hashes, counts = WordHasher().words([t.encode() for t in texts])
    assert counts.tolist() == [3, 0, 1, 3, 400_000]
    assert len({*hashes[:3], hashes[6]}) == 1 and hashes[4] == hashes[5] and len(set(hashes[7:])) == 1
    assert len(set(hashes.tolist())) == 4
    assert shingle_hashes(hashes, counts, 5)[1].tolist() == [1, 0, 1, 1, 399_996]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(7)
    edges = {"chain": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(200)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]}[shape]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3), (9, 9)], "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
