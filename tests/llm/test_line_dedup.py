import math
import random
import re
import string

import pytest

from waypost.llm import line_dedup


def brute(rows):
    """(id, text) -> {id: (text, lines, removed)}."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    lines = [(i, k, line, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(lower)))) for i, t in sorted(rows) for k, line in enumerate(t.split("\n"))]
    gone = set()
    for at, (i, k, _, s) in enumerate(lines):
        for _, _, _, other in lines[:at]:
            if s and other and 10 * len(s & other) >= 9 * len(s | other):
                gone.add((i, k))
                break
    out = {}
    for i, t in rows:
        own = t.split("\n")
        kept = [x for k, x in enumerate(own) if (i, k) not in gone]
        out[i] = ("\n".join(kept), len(own), len(own) - len(kept))
    return out


def result(df):
    return {r.doc_id: (r.text, r.n_lines, r.removed_lines) for r in line_dedup.dedup_lines(df).collect()}


def edited(rng, n_docs):
    base = [[f"w{rng.randrange(200)}" for _ in range(rng.randint(1, 40))] for _ in range(12)]
    rows = []
    for i in range(n_docs):
        text = []
        for _ in range(rng.randint(1, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            text.append(rng.choice([" ", "  ", "\t"]).join(words))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("hot", [2, 1024])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = edited(random.Random(hot), 120)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("hot", [2, 1024])
def test_family_of_near_misses(spark, monkeypatch, hot):
    """Variants of one long line, a few words apart: some match an earlier one, many just do not."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        words = list(base)
        for k in rng.sample(range(60), rng.choice([0, 1, 2, 3, 3, 4, 5])):
            words[k] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(rng.sample(words, 60)).title()))
    expected = brute(rows)
    assert 50 < sum(gone for _, _, gone in expected.values()) < 240
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == expected


def test_very_long_lines(spark):
    words = [f"w{i}" for i in range(30_000)]
    texts = [words, words[:27_000], words[:26_999], words[1_500:] + ["x"] * 9, ["y"] * 30_000, ["y"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_prefix_is_long_enough():
    """Sets of n words that match share a word among the first n - ceil(0.9 n) + 1 of each."""
    for n in range(1, 400):
        for m in range(n, 400):
            shared = math.ceil(9 * (n + m) / 19)
            if shared <= n:
                assert shared >= math.ceil(0.9 * m) and n - (n - math.ceil(0.9 * n) + 1) < shared


def test_case_is_ignored(spark):
    rows = [(1, "ALL RIGHTS RESERVED"), (2, "All rights reserved\nThe end of it"), (3, "the end OF it\nÉté"), (4, "été")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {i: t for i, (t, _, _) in result(df).items()} == {1: "ALL RIGHTS RESERVED", 2: "The end of it", 3: "Été", 4: "été"}
    assert {r.removed_lines for r in line_dedup.dedup_lines(df, ignore_case=False).collect()} == {0}


def test_odd_rows(odd):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    assert line_dedup.dedup_lines(odd).columns == [c for c in odd.columns if c != "removed_lines"] + ["n_lines", "removed_lines"]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.removed_lines))
    assert by[1][0][1:] == (2, 0)
    assert by[2] == [("", 2, 2)] * 2
    assert by[3] == [(None, 0, 0)] and by[4] == [("", 1, 0)] and by[5][0][0] == " \t\r\n \x0b\x0c"
    assert sorted(by[None], key=str) == [("a row without an id but with words", 1, 0), (None, 0, 0)]


def test_empty_table(none):
    assert line_dedup.dedup_lines(none).count() == 0


def test_letters_that_are_not_ascii(spark):
    """A to Z are folded among any letters, no other letter is, and letters of like bytes stay different."""
    letters = ["é", "É", "ã", "Ã", "\u00e9\u0081", "あ", "い", "ÿ", "Ÿ", "Þ", "þ", "\u0403", "\u0453", "\U0001f600", "𐐀", "𐐨", "\u1e9e", "ß", "İ", "i", "ı", "\u00a0", "\u0085"]
    rows = [(i, f"{a}{b} {b}") for i, (a, b) in enumerate((a, b) for a in letters for b in ("x", "X", *letters))]
    rows += [(len(rows) + i, t) for i, t in enumerate(["ÉTÉ One\r\nTwo\tthree", "one ÉtÉ\nTWO \x0b three\r", "\x0c\n\r\n é"])]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_table_that_meets_itself_is_shuffled_once(spark, tmp_path):
    spark.range(20).selectExpr("id % 7 as token", "id", "10 as n", "id as rare_bits", "id as frequent_bits", "0 as i").write.parquet(f"{tmp_path}/entries")
    hot = spark.range(0).selectExpr("cast(id as int) as token")
    entries = line_dedup._dealt(spark.read.parquet(f"{tmp_path}/entries"), hot)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = line_dedup._partnered(entries, entries)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "ReusedExchange" in plan


def test_words_are_cut_once(spark, monkeypatch):
    """Ranks and sets are made from the written hashes of words, and arrays are cut before functions run over them."""
    plans = {}

    def noted(df, name, *more, f=line_dedup.written):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return f(df, name, *more)

    monkeypatch.setattr(line_dedup, "written", noted)
    rows = edited(random.Random(3), 30)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert "split(" in plans["words"] and "split(" not in plans["rarity"] + plans["lines"]
    assert "aggregate(" in plans["lines"] and "aggregate(slice(" not in plans["lines"]
