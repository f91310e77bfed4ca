"""Places and running sums of a group or series that lies in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from waypost.operators import partners, scorecard

REGION = "polygon_ordinal long, delivery_station string, cluster string, num_points double"


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_station_with_most_regions(spark, many_partitions):
    rng = random.Random(1)
    rows = [(i, rng.choice(["A"] * 18 + ["B", None]), rng.choice([f"R{i}", f"R{i % 50}", None]), rng.choice([None, 0.0, 5.0, 10.0])) for i in range(800)]
    people = [(rng.choice([f"R{i}" for i in range(60)]), rng.choice(["Active", "Onboarding", "x"]), 1.0) for _ in range(500)]
    regions = spark.createDataFrame(rows, REGION)
    staff = spark.createDataFrame(people, "regiao string, status string, ADV double")

    def attainment(cluster, points):
        n = sum(1 for r, s, _ in people if r == cluster and s != "x")
        return n / points * 100 if points else 0

    place, best = {}, {}
    for station in ("A", "B", None):
        own = sorted([(attainment(c, p), -(p or 0), i) for i, s, c, p in rows if s == station])
        for k, (_, _, i) in enumerate(own):
            place[i] = k + 1
    for i, s, c, _ in rows:
        best[s, c] = min(best.get((s, c), 10**9), place[i])
    got = partners.region_priority(regions, staff).collect()
    assert {(r.delivery_station, r.cluster): r.priority for r in got} == best and len(got) == len(best)
    shown = regions.where("polygon_ordinal % 3 = 0")
    got = partners.region_summary(shown, regions, staff).collect()
    assert {r.polygon_ordinal: r.priority for r in got} == {i: best[s, c] for i, s, c, _ in rows if i % 3 == 0}
    assert len(got) == shown.count()


def test_legend_colors(spark, many_partitions):
    df = spark.createDataFrame([(f"s{i}", f"v{i % 25:02}" if i % 5 else None) for i in range(100)], "store_id string, field string")
    legend, rows = partners.category_encoding(df, "field", ("a", "b", "c"))
    values = sorted({r.value for r in legend.collect()})
    assert {r.value: r.color for r in legend.collect()} == {v: "abc"[k % 3] for k, v in enumerate(values)} and "N/A" in values
    assert "SinglePartition" not in plan_of(legend) and rows.count() == 100


@pytest.mark.parametrize("by", [[], ["owner"]])
def test_series(spark, many_partitions, by):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 7]), rng.randint(0, 3)) for i in range(500)]
    daily = spark.createDataFrame(rng.sample(rows, len(rows)), "day_ordinal long, owner string, contatos long, cadastros long").withColumn("data_contato", F.lit(None).cast("date"))
    out = scorecard.cumulative_series(daily, by)
    assert "SinglePartition" not in plan_of(out)
    got = {r.day_ordinal: (r.position, r.contacts_cum, r.registrations_cum) for r in out.collect()}
    seen, last = {}, {}
    for i, owner, x, y in rows:
        key = owner if by else 0
        n, a, b = seen.get(key, (0, 0, 0))
        seen[key] = (n + 1, a + (x or 0), b + y)
        last.setdefault(key, []).append((x or 0, y))
        assert got[i] == seen[key]
    means = scorecard.trailing_mean(daily, 20, by)
    want = {k: tuple(sum(v[j] for v in own[-20:]) / len(own[-20:]) for j in (0, 1)) for k, own in last.items()}
    assert {(r.owner if by else 0): (r.contacts_mean, r.registrations_mean) for r in means.collect()} == want
    plan = plan_of(means)
    assert ("WindowGroupLimit" in plan and "Partial" in plan) if by else "TakeOrderedAndProject" in plan
