import pytest
from pyspark.sql import functions as F

from waypost.operators import filters

P = "partner_ordinal long, store_id string, name string, lat double, lon double, status string, delivery_station string, hub_delivey_initiatives string, jurisdiction_type string, ADV double, eligible_packages double, overlapping_count double"


@pytest.fixture
def partners(spark):
    rows = [
        (0, "ST1", "Alpha 100%", 1.0, 2.0, "Active", "DSP2", "Other", "Exclusive", 10.0, 50.0, 0.0),
        (1, "st2", "Beta", 1.0, 2.0, "Inactive", "DSP3", None, None, None, None, None),
        (2, "ST20", "Alphabet", 3.0, 4.0, None, None, "", "Shared", 40.0, 500.0, 2.0),
    ]
    return spark.createDataFrame(rows, P)


def ids(df):
    return sorted(r.partner_ordinal for r in df.collect())


def test_defaults_keep_everything(partners):
    assert ids(filters.filter_partners(partners)) == [0, 1, 2]


def test_empty_station_set_keeps_nothing(partners):
    assert ids(filters.filter_partners(partners, stations=[])) == []


def test_all_among_stations_keeps_everything(partners):
    assert ids(filters.filter_partners(partners, stations=["all", "DSP2"])) == [0, 1, 2]


def test_null_equals_no_choice(partners):
    assert ids(filters.filter_partners(partners, status="Active")) == [0]
    assert ids(filters.filter_partners(partners, jurisdiction="Shared")) == [2]


def test_overlap_equal_zero(partners):
    assert ids(filters.highlight_partners(partners, overlapping=("eq", 0))) == [0, 1]


def test_zero_threshold_is_off(partners):
    assert ids(filters.highlight_partners(partners, eligible=("gt", 0), overlapping=("gt", 0))) == [0, 1, 2]


def test_strict_comparisons(partners):
    assert ids(filters.highlight_partners(partners, eligible=("gt", 50))) == [2]
    assert ids(filters.highlight_partners(partners, allocated=("lt", 10))) == [1]


def test_autocomplete_is_literal_and_needs_two_characters(spark, partners):
    terms = spark.createDataFrame([(1, "0%"), (2, "a"), (3, "aLPha"), (4, "st2")], "term_id long, term string")
    found = filters.autocomplete_partners(partners, terms).orderBy("term_id", "place").collect()
    assert [(r.term_id, r.place, r.store_id) for r in found] == [(1, 1, "ST1"), (3, 1, "ST1"), (3, 2, "ST20"), (4, 1, "st2"), (4, 2, "ST20")]
    assert found[0].label == "Alpha 100% (ST1)"


def test_lookup_outcomes(spark, partners):
    terms = spark.createDataFrame([(1, "st1"), (2, "BETA"), (3, "zzz"), (4, ""), (5, None)], "term_id long, term string")
    found = filters.lookup_partner(partners, partners.where(F.col("partner_ordinal") != 1), terms)
    assert {r.term_id: (r.store_id, r.outcome) for r in found.collect()} == {1: ("ST1", "found"), 2: ("st2", "filtered_out"), 3: (None, "not_found")}


def test_search_joins_cells_without_separator(spark):
    df = spark.createDataFrame([("ab", "cd"), ("x", None)], "p string, q string")
    assert filters.search_rows(df, "BC").count() == 1
    assert filters.search_rows(df, "xn/a").count() == 1
    assert filters.search_rows(df, "").count() == 2


def test_colors(spark):
    df = spark.createDataFrame([("DSP2", "#1"), ("DSP2", ""), ("DSP3", None)], "delivery_station string, cor string")
    assert sorted(r.color for r in filters.filter_regions(df, ["DSP2"]).collect()) == ["#1", "#3388ff"]
    assert sorted(r.color for r in filters.filter_jurisdictions(df).collect()) == ["#1", "#6E00B3", "#6E00B3"]
