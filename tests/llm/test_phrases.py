import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from waypost.llm import phrases
from waypost.llm.phrases import frequent_phrases, mine_phrases


def pieces_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def count(rows, longest):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        for words in pieces_of(text):
            sizes[lang or "und" if lang is None else lang] += len(words)
            for m in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return counts, sizes


def brute(rows, least, longest, top):
    counts, sizes = count(rows, longest)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if inside[p] < a:
                score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, sizes[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(rng, n):
    words = "the of new york city é\U0001f600 a-b THE x's 日本".split()
    some = [" ".join(rng.choice(words[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 9))) for _ in range(12)]
    return [(rng.choice(["en", "en", "de", None, ""]), rng.choice([". ", " ", "\t", "\n", "!"]).join(rng.choices(some, k=rng.randint(0, 6)))) for _ in range(n)]


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_whole_result(spark, shards):
    rows = made(random.Random(shards), 150)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = mine_phrases(df, 6, 5, 7, shards=shards).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 6, 5, 7)


def test_counts_whatever_the_table(spark):
    """A table of few bytes makes phrases share them, which lets more phrases be counted and changes no count."""
    rows = made(random.Random(9), 120)
    counts, sizes = count(rows, 4)
    want = {(g, " ".join(p), f) for g, own in counts.items() for p, f in own.items() if f >= 5} | {(g, None, n) for g, n in sizes.items()}
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    for bits in (3, 5, 7, 20):
        got = frequent_phrases(df, 5, 4, shards=2, table_bits=bits).collect()
        assert {(r.lang, r.phrase, r["count"]) for r in got} == want and len(got) == len(want)
        assert all(r.phrase is None or r.n_words == len(r.phrase.split(" ")) for r in got)


def test_a_phrase_is_counted_for_a_whole_circle_whoever_shares_its_place():
    """Any table, in any order of marks: a phrase that is counted at all is counted in each shard once, from the same scan on."""
    rng = random.Random(4)
    text = b"a a a a a a. b a b a b b. a b c a b c a"
    codes = phrases.Codes()
    every = {" ".join(w[i : i + m]) for w in pieces_of(text.decode()) for m in range(1, 5) for i in range(len(w) - m + 1)}
    for _ in range(60):
        shards, size = rng.choice([1, 2, 3]), 64
        slots = {p: phrases._slots(codes.phrases("en", [p], len(p.split(" "))), size)[0] for p in sorted(every)}
        marks = {s: rng.choice([0, 1, 2, 3, 5, 9]) for s in set(slots.values()) if rng.random() < 0.8}
        seen = defaultdict(list)
        for step in range(30):
            table = np.full(size, 255, dtype=np.uint8)
            for s, at in marks.items():
                if at < step:
                    table[s] = at
            for b in phrases.Counter(step, table, shards, 5).count("en", [text]):
                for r in b.to_pylist():
                    if r["n_words"] > 1:
                        seen[r["phrase"]].append((step, r["since"]))
        for found in seen.values():
            start = found[0][1]
            assert found == [(start + k, start) for k in range(shards)]


def test_a_scan_counts_only_what_is_open():
    table = np.full(1 << 20, 255, dtype=np.uint8)

    def counted(step):
        out = defaultdict(int)
        for b in phrases.Counter(step, table, 2, 3).count("en", [b"a b c. a b", b"b c"]):
            for r in b.to_pylist():
                out[r["phrase"]] += r["count"]
        return dict(out)

    codes = phrases.Codes()
    slots = {p: phrases._slots(codes.phrases("en", [p], len(p.split())), len(table))[0] for p in ("a", "b", "c", "a b", "b c")}
    assert counted(0) == {None: 7, "a": 2, "b": 3, "c": 2}
    table[[slots["a"], slots["b"]]] = 0
    assert counted(1) == {None: 7, "a": 2, "b": 3, "c": 2, "a b": 2}
    table[slots["c"]] = 1
    assert counted(2) == {"a b": 2, "b c": 2} and counted(3) == {"b c": 2}  # each for one circle of two shards
    table[[slots["a b"], slots["b c"]]] = 2
    assert counted(3) == {"b c": 2, "a b c": 1} and counted(5) == {}


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**12
    rows = [("en", None, 0, 3 * 10**13), ("en", "p", 1, big), ("en", "q", 1, big - 1), ("en", "p q", 2, big - 7)]
    (r,) = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, n_words int, count long")).collect()
    assert r.score == 1000 * (big - 7) * 3 * 10**13 // (big * (big - 1))


def test_odd_rows(odd, none):
    got = {(r.lang, r.phrase): r["count"] for r in frequent_phrases(odd, 3, 3).collect()}
    assert got["en", "the quick"] == 3 and got["en", "fox jumps over"] == 3 and ("en", "bank a") not in got
    assert got["en", None] == 3 * 19 + 30_000 + 1 and got["und", None] == 0
    assert mine_phrases(none).count() == 0
