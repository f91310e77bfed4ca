from datetime import date, timedelta

import pytest

from waypost.operators import scorecard as ops

LEAD = "lead_ordinal long, responsavel string, origem string, data_contato date, data_cadastro date, data_conversao date"
DAY = date(2024, 1, 1)


def leads(spark, *rows):
    """(owner, origin, registered)"""
    return spark.createDataFrame([(i, o, g, DAY, DAY if r else None, None) for i, (o, g, r) in enumerate(rows)], LEAD)


def daily(spark, *counts):
    rows = [(i + 1, DAY + timedelta(i), c, c // 10) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "day_ordinal long, data_contato date, contatos long, cadastros long")


def test_no_registrations(spark):
    df = leads(spark, ("p", "a", False), ("q", "b", False))
    assert ops.best_origin(df).count() == 0
    assert {r.responsavel: r.best_origin for r in ops.best_origin_per_owner(df).collect()} == {"p": "N/A", "q": "N/A"}


def test_ties_go_to_the_first_seen(spark):
    df = leads(spark, ("p", "z", True), ("p", "a", True), ("q", "a", False))
    assert [r.origem for r in ops.best_origin(df).collect()] == ["z"]
    assert {r.responsavel: r.best_origin for r in ops.best_origin_per_owner(df).collect()} == {"p": "z", "q": "N/A"}


def test_podium(spark):
    rows = [("a", "o", True), ("a", "o", False), ("b", "o", True), ("c", "o", True), ("c", "o", False), ("d", "o", False)]
    got = [(r.place, r.responsavel, r.rate) for r in ops.podium_by_origin(leads(spark, *rows)).orderBy("place").collect()]
    assert got == [(1, "b", 100.0), (2, "a", 50.0), (3, "c", 50.0)]


@pytest.mark.parametrize(("score", "band"), [(0.8, "green"), (0.6, "gold"), (0.599, "red"), (None, "red")])
def test_owner_bands(spark, score, band):
    scores = spark.createDataFrame([("p", score, 1, None, 0)], "responsavel string, score_final double, contatos long, cadastros long, conversoes long")
    row = ops.owner_cards(scores, leads(spark, ("x", "o", True))).collect()[0]
    assert (row.band, row.best_origin, row.registrations) == (band, "N/A", 0)


GOAL = "struct<atingido:double,meta:double,percentual:double>"


@pytest.mark.parametrize(("percent", "band", "bar"), [(100.0, "success", 100.0), (70.0, "warning", 70.0), (69.9, "danger", 69.9), (130.0, "success", 100.0), (None, "danger", 0.0)])
def test_goal_bands(spark, percent, band, bar):
    df = spark.createDataFrame([((1.0, 2.0, percent), (0.0, None, percent), 0.5)], f"contatos {GOAL}, cadastros {GOAL}, scorecard_geral double")
    assert [(r.band, r.bar) for r in ops.goal_progress(df).collect()] == [(band, bar)] * 2


def test_kpis_need_an_owner(spark):
    goals = spark.createDataFrame([((0.0, 2.0, 0.0), (0.0, 1.0, 0.0), 0.5)], f"contatos {GOAL}, cadastros {GOAL}, scorecard_geral double")
    owners = spark.createDataFrame([("p",)], "responsavel string")
    assert ops.scorecard_kpis(goals, owners).collect()[0].registration_rate is None
    assert ops.scorecard_kpis(goals, owners.where("responsavel = 'q'")).count() == 0


def test_trailing_mean(spark):
    assert ops.trailing_mean(daily(spark, *range(7))).collect()[0].contacts_mean == 3.0
    assert ops.trailing_mean(daily(spark, *range(30))).collect()[0].contacts_mean == 19.5
    assert ops.trailing_mean(daily(spark, 1).where("contatos > 5")).collect()[0].contacts_mean == 0.0


def test_chart(spark):
    chart = ops.temporal_chart(daily(spark, 10, 30), date(2024, 1, 29)).orderBy("position").collect()
    assert [(r.position, r.label, r.contacts_cum) for r in chart] == [(1, "2024-01-01", 10), (2, "2024-01-02", 40), (3, "Proj+1", 60), (4, "Proj+2", 80)]
    assert [r.contacts_target for r in chart] == [580, 1160, 1740, 2320]
    assert ops.temporal_chart(daily(spark, 1), date(2024, 1, 31)).count() == 1


def test_lead_detail(spark):
    row = ops.lead_detail(leads(spark, ("p", None, False))).collect()[0]
    assert row["LEAD ORDINAL"] == "0" and row["ORIGEM"] == "N/A"


def test_bands_can_be_replaced(spark):
    goal = "struct<atingido:double,meta:double,percentual:double>"
    df = spark.createDataFrame([((50.0, 100.0, 50.0), (99.0, 100.0, 99.0))], f"contatos {goal}, cadastros {goal}")
    bands = lambda **more: {r.metric: r.band for r in ops.goal_progress(df, **more).collect()}
    assert bands() == {"contacts": "danger", "registrations": "warning"}
    assert bands(bands=[(99.0, "high"), (50.0, "middle"), (0.0, "low")]) == {"contacts": "middle", "registrations": "high"}
