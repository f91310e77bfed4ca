"""The lead-generation scorecard: figures, best origins, podiums and time series."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import banded, ratio, share, truthy, zero
from ..sources.constants import DAILY_TARGETS, PROGRESS_BANDS, SCORE_BANDS
from . import scans

WINDOW_ROWS = 20


def scorecard_kpis(goals_attained: DataFrame, owner_scores: DataFrame) -> DataFrame:
    """Overall figures; no row if no owner passes the filter."""
    row = goals_attained.select(
        zero("contatos.atingido").alias("contacts"),
        zero("cadastros.atingido").alias("registrations"),
        F.round(F.try_divide(zero("cadastros.atingido") * 100, zero("contatos.atingido")), 2).alias("registration_rate"),
        F.round(zero("scorecard_geral") * 100, 0).alias("score"),
    )
    return row.join(owner_scores.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_semi")


def goal_progress(goals_attained: DataFrame, bands: Iterable[tuple[float, str]] = PROGRESS_BANDS) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).alias("g")) for n, c in (("contacts", "contatos"), ("registrations", "cadastros"))))
    rows = goals_attained.select(F.explode(cells).alias("c")).select(
        "c.metric", zero("c.g.atingido").alias("attained"), zero("c.g.meta").alias("goal"), zero("c.g.percentual").alias("percent")
    )
    return rows.withColumns({"band": banded(F.col("percent"), bands), "bar": F.least("percent", F.lit(100.0))})


def _given(leads: DataFrame, column: str) -> Column:
    """Whether anything was written in a column, dates or not, where the reader says so."""
    return F.col(f"{column}_given") if f"{column}_given" in leads.columns else truthy(column)


def _by_group(leads: DataFrame, *keys: str) -> DataFrame:
    """Contacts, registrations, conversions and first place of every group of leads."""
    return leads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("contacts"),
        F.count_if(_given(leads, "data_cadastro")).alias("registrations"),
        F.count_if(_given(leads, "data_conversao")).alias("conversions"),
        F.min("lead_ordinal").alias("first"),
    )


def _rate() -> Column:
    return share(F.col("registrations"), F.col("contacts"), 100.0)


def best_origin(leads: DataFrame) -> DataFrame:
    """The origin with the highest rate of registrations, the first seen of equals; none if all rates are 0."""
    groups = _by_group(leads, "origem").withColumn("rate", _rate()).where("rate > 0")
    return groups.orderBy(F.desc("rate"), "first").limit(1).select("origem", "contacts", "registrations", "conversions", "rate")


def best_origin_per_owner(leads: DataFrame) -> DataFrame:
    """The same for each owner; N/A and rate 0 if all its rates are 0."""
    groups = _by_group(leads, "responsavel", "origem").withColumn("rate", _rate())
    place = F.row_number().over(Window.partitionBy("responsavel").orderBy(F.desc("rate"), "first"))
    top = groups.withColumn("place", place).where("place = 1")
    name = F.when(F.col("rate") > 0, F.col("origem")).otherwise("N/A")
    return top.select("responsavel", name.alias("best_origin"), "rate")


def owner_best_origin(owner_scores: DataFrame, best: DataFrame) -> DataFrame:
    names = best.select(F.col("responsavel").alias("_owner"), F.col("best_origin").alias("_best"))
    joined = owner_scores.join(names, F.col("responsavel") == F.col("_owner"), "left")
    return joined.withColumn("best_origin", F.coalesce("_best", F.lit("N/A"))).drop("_owner", "_best")


def owner_cards(owner_scores: DataFrame, leads: DataFrame, bands: Iterable[tuple[float, str]] = SCORE_BANDS) -> DataFrame:
    score = zero("score_final") * 100
    rows = owner_best_origin(owner_scores, best_origin_per_owner(leads))
    return rows.select(
        "responsavel",
        score.alias("score"),
        banded(score, bands).alias("band"),
        F.coalesce("contatos", F.lit(0)).cast("long").alias("contacts"),
        F.coalesce("cadastros", F.lit(0)).cast("long").alias("registrations"),
        F.coalesce("conversoes", F.lit(0)).cast("long").alias("conversions"),
        "best_origin",
    )


def podium_by_origin(leads: DataFrame, k: int = 3) -> DataFrame:
    """The k owners of each origin with the highest whole-percent rates, the first seen of equals first."""
    groups = _by_group(leads, "origem", "responsavel").withColumn("rate", ratio(F.col("registrations"), F.col("contacts"), 0, 100))
    place = F.row_number().over(Window.partitionBy("origem").orderBy(F.desc("rate"), "first"))
    return groups.withColumn("place", place).where(F.col("place") <= k).select("origem", "place", "responsavel", "registrations", "contacts", "rate")


def filter_domains(partners: DataFrame, leads: DataFrame) -> DataFrame:
    """Distinct values to filter by; blanks are dropped for partners and kept for leads."""
    of = lambda df, field, column: df.select(F.lit(field).alias("field"), F.col(column).alias("value"))
    named = [of(partners.where(truthy(c)), f, c) for f, c in (("initiative", "hub_delivey_initiatives"), ("station", "delivery_station"))]
    named += [of(leads, f, c) for f, c in (("owner", "responsavel"), ("origin", "origem"))]
    out = named[0].distinct()
    for more in named[1:]:
        out = out.unionByName(more.distinct())
    return out.orderBy("field", F.asc_nulls_last("value"))


def cumulative_series(daily: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """``daily`` with its position and running sums in file order, of each series where ``by`` tells them apart.

    A series of any length is summed by many tasks, with or without ``by``.
    """
    sums = {"position": F.lit(1).cast("long"), "contacts_cum": zero("contatos"), "registrations_cum": zero("cadastros")}
    rows = scans.accumulate(scans.ranged(daily, by, ["day_ordinal"]), by, ["day_ordinal"], {n: ("sum", c) for n, c in sums.items()})
    return rows.withColumn("position", F.col("position").cast("int")).drop(scans.PART)


def trailing_mean(daily: DataFrame, window: int = WINDOW_ROWS, by: Iterable[str] = ()) -> DataFrame:
    """Means of the last rows of each series, 0 for an empty table without ``by``.

    Every task keeps its last rows of a series, and only these meet.
    """
    by = list(by)
    if by:  # Spark limits the groups of such a window before it deals them
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("day_ordinal")))
        last = daily.withColumn("_r", place).where(F.col("_r") <= window)
    else:
        last = daily.orderBy(F.desc("day_ordinal")).limit(window)
    return last.groupBy(*by).agg(
        F.coalesce(F.avg(zero("contatos")), F.lit(0.0)).alias("contacts_mean"),
        F.coalesce(F.avg(zero("cadastros")), F.lit(0.0)).alias("registrations_mean"),
    )


def days_left_in_month(as_of: date) -> Column:
    day = F.lit(as_of)
    return F.dayofmonth(F.last_day(day)) - F.dayofmonth(day)


def projected_series(daily: DataFrame, as_of: date, window: int = WINDOW_ROWS, by: Iterable[str] = ()) -> DataFrame:
    """A row for each day left in the month: the last sums plus so many means."""
    by = list(by)
    sums = daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum(zero("contatos")), F.lit(0.0)).alias("_contacts"),
        F.coalesce(F.sum(zero("cadastros")), F.lit(0.0)).alias("_registrations"),
    )
    means = trailing_mean(daily, window, by)
    row = sums.join(means, by) if by else sums.crossJoin(means)  # one row each
    left = days_left_in_month(as_of)
    steps = row.where(left > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(left, F.lit(1)))))
    return steps.select(
        *by,
        (F.col("_n") + F.col("_i")).cast("int").alias("position"),
        F.concat(F.lit("Proj+"), F.col("_i")).alias("label"),
        (F.col("_contacts") + F.col("_i") * F.col("contacts_mean")).alias("contacts_cum"),
        (F.col("_registrations") + F.col("_i") * F.col("registrations_mean")).alias("registrations_cum"),
    )


def cumulative_targets(series: DataFrame, targets: tuple[int, int] = DAILY_TARGETS) -> DataFrame:
    """``series`` with the targets reached at each position."""
    contacts, registrations = targets
    return series.withColumns(
        {"contacts_target": (F.col("position") * contacts).cast("long"), "registrations_target": (F.col("position") * registrations).cast("long")}
    )


def temporal_chart(
    daily: DataFrame, as_of: date, window: int = WINDOW_ROWS, targets: tuple[int, int] = DAILY_TARGETS, by: Iterable[str] = ()
) -> DataFrame:
    """Actual and projected sums with their targets, in order of position."""
    by = list(by)
    names = ["position", "label", "is_projection", "contacts_cum", "registrations_cum"]
    label = "label" if "label" in daily.columns else "data_contato"  # as written, where the reader keeps it
    actual = cumulative_series(daily, by).withColumns({"label": F.col(label).cast("string"), "is_projection": F.lit(False)})
    projected = projected_series(daily, as_of, window, by).withColumn("is_projection", F.lit(True))
    return cumulative_targets(actual.select(*by, *names).unionByName(projected.select(*by, *names)), targets)


def _header(column: str) -> str:
    return column.replace("_", " ").upper()


def lead_detail(leads: DataFrame) -> DataFrame:
    """All cells as text, missing ones as N/A, under headers in capitals with spaces.

    Leads from a document have the columns of the first one's keys, in their
    order, with what was written there; other leads have all of their columns.
    """
    if "as_written" not in leads.columns:
        return leads.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("N/A")).alias(_header(c)) for c in leads.columns))
    first = leads.select("lead_ordinal", "as_written").orderBy("lead_ordinal").head(1)
    keys = list(json.loads(first[0].as_written)) if first else []
    whole = leads.select(F.try_parse_json("as_written").alias("_lead"))
    cell = lambda key: F.try_variant_get("_lead", f"$[{json.dumps(key)}]", "string")
    return whole.select(*(F.coalesce(cell(k), F.lit("N/A")).alias(_header(k)) for k in keys))
