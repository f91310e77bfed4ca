import random

import pytest
from pyspark.sql import functions as F

from waypost.operators import filters, search


def made(rng, n):
    letters = "aB éx%"
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    rows = [(i, rng.choice([None, f"St{i % 40}", word(4)]), rng.choice([None, "", f"Same name {i % 7}", word(12)]), float(i), -float(i)) for i in range(n)]
    terms = [(k, rng.choice([None, "", word(2), word(5), "same", "SAME NAME", f"sT{k % 50}", "e"])) for k in range(120)]
    return rows, terms


@pytest.mark.parametrize("hot", [2, 64, 10**9])
def test_equal_to_comparing_all(spark, monkeypatch, hot):
    monkeypatch.setattr(search, "HOT", hot)
    monkeypatch.setattr(search, "SALTS", 4)
    rows, terms = made(random.Random(hot), 300)
    partners = spark.createDataFrame(rows, "partner_ordinal long, store_id string, name string, lat double, lon double").repartition(3)
    asked = spark.createDataFrame(terms, "term_id long, term string")
    low = lambda x: (x or "").lower()
    want = {(k, i + 1, r[1], r[2]) for k, t in terms if t and len(t) > 1 for i, r in enumerate([r for r in rows if low(t) in low(r[2]) or low(t) in low(r[1])][:5])}
    got = filters.autocomplete_partners(partners, asked).collect()
    assert {(r.term_id, r.place, r.store_id, r.name) for r in got} == want and len(got) == len(want)
    visible = partners.where("partner_ordinal % 2 = 0")
    shown = {r[1] for r in rows if r[0] % 2 == 0}
    want = {}
    for k, t in terms:
        if t:
            first = next((r for r in rows if (r[1] is not None and low(r[1]) == low(t)) or low(t) in low(r[2])), None)
            want[k] = (first[0], "found" if first[1] in shown else "filtered_out") if first else (None, "not_found")
    got = filters.lookup_partner(partners, visible, asked).collect()
    assert {r.term_id: (None if r.lat is None else int(r.lat), r.outcome) for r in got} == want and len(got) == len(want)


def test_no_nested_loops(spark):
    partners = spark.range(1000).select(F.col("id").alias("partner_ordinal"), F.concat(F.lit("ST"), "id").alias("store_id"), F.concat(F.lit("name "), "id").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    terms = spark.range(500).select(F.col("id").alias("term_id"), F.concat(F.lit("e "), "id").alias("term"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (filters.autocomplete_partners(partners, terms), filters.lookup_partner(partners, partners, terms)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
