from datetime import date

import pytest

from waypost.operators import partners as ops
from waypost.sources.constants import reference_tables

MSD = "main_store_data struct<radius:double,ADV:double,capped_days:double,working_days:double,dispatched_packages:double,delivered_packages:double,ead:double,dea:double,dcr:double,fdds:double,ftds:double>"
P = f"partner_ordinal long, store_id string, name string, lat double, lon double, radius double, status string, delivery_station string, hub_delivey_initiatives string, supply_run string, HCP_rate_card string, ADV double, regiao string, {MSD}"


def partner(i, status="Active", station="DSP2", run="SR1", hub=None, tier="Tier 1", adv=10.0, region="A", packages=None, days=None, rate=None):
    msd = (1.0, None, None, days, packages, packages, rate, rate, rate, rate, rate)
    return (i, f"ST{i}", f"n{i}", float(i), float(-i), 5.0, status, station, hub, run, tier, adv, region, msd)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), P)


def regions(spark, *rows):
    return spark.createDataFrame(list(rows), "polygon_ordinal long, cluster string, delivery_station string, num_points double")


def test_nothing_expected_comes_first(spark):
    rg = regions(spark, (0, "A", "S", 10.0), (1, "B", "S", 0.0), (2, "C", "S", None))
    got = ops.region_summary(rg, rg, frame(spark, partner(0), partner(1, "BG Checks"))).orderBy("polygon_ordinal").collect()
    assert [(r.attainment_pct, r.priority, r.active, r.onboarding) for r in got] == [(20.0, 3, 1, 1), (0.0, 1, 0, 0), (0.0, 2, 0, 0)]
    assert got[0].avg_adv == 10.0


def test_rounding_changes_the_order(spark):
    rg = regions(spark, (0, "A", "S", 1000.0), (1, "B", "S", 1999.0))
    p = frame(spark, partner(0, region="A"), partner(1, region="B"), partner(2, region="B"))
    by_region = lambda df, key: {r[key]: r.priority for r in df.collect()}
    assert by_region(ops.region_priority(rg, p), "cluster") == {"A": 1, "B": 2}
    assert by_region(ops.expansion_by_region(rg, p), "polygon") == {"A": 2, "B": 1}


def test_repeated_region_names(spark):
    rg = regions(spark, (0, "A", "S", 2.0), (1, "A", "S", 4.0))
    p = frame(spark, partner(0))
    assert [(r.cluster, r.priority) for r in ops.region_priority(rg, p).collect()] == [("A", 1)]
    assert sorted(r.priority for r in ops.expansion_by_region(rg, p).collect()) == [1, 2]


def test_runs(spark):
    cost = reference_tables(spark)["station_cost"]
    p = frame(
        spark,
        partner(0, station=None, run="SR1", packages=10.0),  # first of its run: no station, default cost
        partner(1, "BG Checks", run="SR1", packages=5.0, hub="HCP Host Partner"),
        partner(2, "Onboarding", run="SR2", packages=None, days=3.0),
        partner(3, run=""),
        partner(4, run=None),
    )
    got = {r.route: r for r in ops.routes_by_run(p, cost).collect()}
    assert set(got) == {"SR1", "SR2"}
    assert (got["SR1"].delivery_station, got["SR1"].spr, got["SR1"].cpp, got["SR1"].onboarding, got["SR1"].hosts) == (None, 15.0, 40.0, 0, 1)
    assert (got["SR2"].spr, got["SR2"].cpp, got["SR2"].onboarding) == (0.0, 0.0, 1)


def test_low_cost_is_good(spark):
    cost = reference_tables(spark)["station_cost"]
    p = frame(spark, partner(0, packages=1000.0))
    got = {r.metric: r for r in ops.routes_totals(ops.routes_by_run(p, cost), p).collect()}
    assert (got["cpp_mean"].value, got["cpp_mean"].status, got["spr_mean"].status, got["runs"].status) == (0.59, "positive", "positive", None)


def test_kpis_and_goals(spark):
    period = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 30))], "start_date date, end_date date")
    p = frame(spark, partner(0, adv=None, packages=3.0, rate=0.96), partner(1, adv=79.0, rate=None), partner(2, "Inactive", packages=4.0))
    row = ops.performance_kpis(p, period).collect()[0]
    assert (row.period_days, row.active, row.adv_mean, row.dispatched, row.ead) == (30, 2, 39.5, 7.0, 0.48)
    got = {r.metric: r for r in ops.performance_goals(ops.performance_kpis(p, period)).collect()}
    assert (got["adv_mean"].card_value, got["adv_mean"].status) == (40.0, "positive")
    assert (got["dispatched"].goal, got["delivered"].goal) == (2 * 40 * 30, 2 * 40 * 0.985)
    assert (got["ead"].value, got["ead"].card_value, got["ead"].status) == (pytest.approx(48), 50.0, "negative")
    nobody = ops.performance_kpis(p.where("partner_ordinal > 9"), period).collect()[0]
    assert (nobody.active, nobody.adv_mean, nobody.dispatched) == (0, 0.0, 0.0)
    assert ops.performance_kpis(p, period, by=["delivery_station"]).count() == 1


def test_station_average_joins_missing_stations(spark):
    p = frame(spark, partner(0, station=None, adv=4.0), partner(1, "Inactive", station=None), partner(2, station="X", adv=None))
    assert {r.store_id: r.station_adv for r in ops.station_average(p).collect()} == {"ST0": 4.0, "ST1": 4.0, "ST2": 0.0}


def test_expansion_totals_count_partners_outside_regions(spark):
    rg = regions(spark, (0, "A", "S", 4.0))
    p = frame(spark, partner(0), partner(1, region="elsewhere"), partner(2, "Onboarding", region="elsewhere"))
    got = {r.metric: (r.value, r.status) for r in ops.expansion_totals(rg, p).collect()}
    assert got == {"expected": (4.0, None), "active": (2.0, "negative"), "onboarding": (1.0, "negative"), "attainment_pct": (75.0, "negative")}


def test_comparison(spark):
    one = "struct<overlap_id:bigint,store_id:string,radius:double,capped_days:double>"
    rows = [("S", (5.0, 2.0), [(1, "a", 6.0, 1.0), (2, "b", 5.0, None), (3, "c", 4.0, 3.0), (4, "d", 1.0, 2.0), (5, "e", 1.0, 1.0)]), ("T", (1.0, 1.0), [])]
    df = spark.createDataFrame(rows, f"store_id string, main_store_data struct<radius:double,capped_days:double>, overlap_data array<{one}>")
    rows = ops.comparison_matrix(df, {"radius": True, "capped_days": False}).collect()
    assert sorted((r.store_id, r.metric, r.value, r.overlap_id) for r in rows if r.slot is None) == [("T", "capped_days", None, None), ("T", "radius", None, None)]
    assert {(r.slot, r.overlap_id, r.overlap_store_id) for r in rows if r.slot} == {(1, 1, "a"), (2, 2, "b"), (3, 3, "c"), (4, 4, "d")}
    got = {(r.metric, r.slot): r["class"] for r in rows if r.slot}
    assert got == {
        ("radius", 1): "better-value", ("radius", 2): "", ("radius", 3): "worse-value", ("radius", 4): "worse-value",
        ("capped_days", 1): "better-value", ("capped_days", 2): "", ("capped_days", 3): "worse-value", ("capped_days", 4): "",
    }


def test_comparison_of_partners_alone(spark):
    rows = [("S", (5.0,), [(1, "a", 6.0)]), ("T", (1.0,), []), ("U", (2.0,), None)]
    df = spark.createDataFrame(rows, "store_id string, main_store_data struct<radius:double>, overlap_data array<struct<overlap_id:bigint,store_id:string,radius:double>>")
    got = {(r.store_id, r.main_value, r.slot, r.value, r["class"]) for r in ops.comparison_matrix(df, {"radius": True}, alone=True).collect()}
    assert got == {("S", 5.0, 1, 6.0, "better-value"), ("T", 1.0, None, None, ""), ("U", 2.0, None, None, "")}


def test_route_totals_by_station(spark):
    cost = reference_tables(spark)["station_cost"]
    p = frame(spark, partner(0, packages=1000.0), partner(1, station="X", run=None), partner(2, station=None, run="SR9"))
    got = {(r.delivery_station, r.metric): r.value for r in ops.routes_totals(ops.routes_by_run(p, cost), p, by=["delivery_station"]).collect()}
    assert len(got) == 18 and [got[s, "runs"] for s in ("DSP2", "X", None)] == [1.0, 0.0, 1.0]
    assert got["DSP2", "cpp_mean"] == 0.59 and got["X", "cpp_mean"] == 0.0


def test_flatten_prefers_the_nested_value(spark):
    row = ops.flatten_main_store(frame(spark, partner(0))).collect()[0]
    assert (row.radius, row.ADV) == (1.0, 10.0)  # nested radius given, nested ADV missing


def test_route_endpoints(spark):
    p = frame(spark, partner(0), partner(1))
    asked = spark.createDataFrame([(1, "ST0", "ST1"), (2, "", "ST1"), (3, "ST0", "nope"), (4, None, "ST1")], "request_id long, from_id string, to_id string")
    got = {r.request_id: (r.outcome, r.from_lat, r.to_lat) for r in ops.resolve_route_endpoints(asked, p).collect()}
    assert got == {1: ("resolved", 0.0, 1.0), 2: ("missing_endpoint", None, None), 3: ("invalid_partner", None, None), 4: ("missing_endpoint", None, None)}


def test_category_colors_wrap_around(spark):
    p = frame(spark, *(partner(i, run=f"r{i:02}") for i in range(10)), partner(10, run=None))
    legend, colored = ops.category_encoding(p, "supply_run")
    got = {r.value: r.color for r in legend.collect()}
    assert got["N/A"] == "#e41a1c" and got["r00"] == "#377eb8" and got["r08"] == "#e41a1c"
    assert {r.store_id: r.color for r in colored.collect()}["ST10"] == "#e41a1c"
