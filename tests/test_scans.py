import random

import pytest
from pyspark.sql import functions as F

from waypost.operators import scans


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_sums(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.randint(-5, 5)) for i in range(2000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, at long, v long").repartition(5)
    dealt = scans.ranged(df, by, ["at"])
    assert dealt.select(scans.PART).distinct().count() >= 1
    spread = dealt.withColumn(scans.PART, (F.col("at") / 300).cast("int"))  # a key in many partitions
    for table in (dealt, spread):
        out = scans.accumulate(table, by, ["at"], {"n": ("sum", F.lit(1).cast("long")), "s": ("sum", F.col("v")), "x": ("xor", F.col("v"))})
        got = {r["at"]: (r.n, r.s, r.x) for r in out.collect()}
        seen = {}
        for k, at, v in rows:
            n, s, x = seen.get(k if by else 0, (0, 0, 0))
            seen[k if by else 0] = got_of = (n + 1, s + v, x ^ v)
            assert got[at] == got_of
        assert len(got) == len(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, at long")
    assert scans.placed(none, [], ["at"]).count() == 0 == scans.placed(none, ["k"], ["at"]).count()


def test_equal_rows_get_places_of_their_own(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("a", 0)], "k string, at long")
    out = scans.placed(df, ["k"], ["at"]).collect()
    assert sorted(r.place for r in out) == list(range(1, 52)) and [r.place for r in out if r["at"] == 0] == [1]
