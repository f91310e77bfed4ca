"""Statistics of partners, regions and supply runs.

Missing numbers count as 0 and stay in denominators unless said otherwise.
``active`` is the status Active; ``onboarding`` is Onboarding or BG Checks in
region figures, but Onboarding alone on supply runs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_number, ratio, share, truthy, zero
from ..sources import constants as K
from . import scans

RATES = ("ead", "dea", "dcr", "fdds", "ftds")


def _active() -> Column:
    return F.coalesce(F.col("status") == "Active", F.lit(False))


def _onboarding() -> Column:
    return F.coalesce(F.col("status").isin("Onboarding", "BG Checks"), F.lit(False))


def _has(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def region_partners(regions: DataFrame, partners: DataFrame) -> DataFrame:
    """``regions`` with active, onboarding, partners and adv_sum of the partners that bear their name."""
    by_name = partners.groupBy(F.col("regiao").alias("_name")).agg(
        F.count_if(_active()).alias("active"),
        F.count_if(_onboarding()).alias("onboarding"),
        F.count(F.lit(1)).alias("partners"),
        F.sum(zero("ADV")).alias("adv_sum"),
    )
    joined = regions.join(by_name, F.col("cluster") == F.col("_name"), "left").drop("_name")
    return joined.fillna({"active": 0, "onboarding": 0, "partners": 0, "adv_sum": 0.0})


def _attainment() -> Column:
    return share(F.col("active") + F.col("onboarding"), zero("num_points"), 100.0)


def _rounded_attainment() -> Column:
    return ratio(F.col("active") + F.col("onboarding"), zero("num_points"), 1, 100)


def _ranked(rated: DataFrame, attainment: str, place: str) -> DataFrame:
    """``rated`` with its place in its station: least attainment, then most expected, then file order.

    Stations of any size, also what has none, are ranked by many tasks.
    """
    order = [F.col(attainment), F.desc(zero("num_points")), F.col("polygon_ordinal")]
    return scans.placed(rated, ["delivery_station"], order, place).withColumn(place, F.col(place).cast("int"))


def region_priority(regions: DataFrame, partners: DataFrame) -> DataFrame:
    """Place of every region name in its station: least attainment, then most expected, then file order."""
    rated = region_partners(regions, partners).select("polygon_ordinal", "delivery_station", "cluster", "num_points", _attainment().alias("attainment"))
    return _ranked(rated, "attainment", "priority").groupBy("delivery_station", "cluster").agg(F.min("priority").alias("priority"))


def region_summary(shown: DataFrame, regions: DataFrame, partners: DataFrame) -> DataFrame:
    """Figures of the shown ones among ``regions`` over all partners, with their place among all regions."""
    columns = ("polygon_ordinal", "delivery_station", "cluster", "num_points", "active", "onboarding", "partners", "adv_sum")
    rated = region_partners(regions, partners).select(*columns, _attainment().alias("attainment_pct"))
    ranked = _ranked(rated, "attainment_pct", "place")
    # regions of one name share the best place of theirs
    best = ranked.groupBy(F.col("delivery_station").alias("_s"), F.col("cluster").alias("_c")).agg(F.min("place").alias("priority"))
    rows = ranked.join(shown.select("polygon_ordinal"), "polygon_ordinal", "left_semi")
    return rows.join(best, F.col("delivery_station").eqNullSafe(F.col("_s")) & F.col("cluster").eqNullSafe(F.col("_c"))).select(
        "polygon_ordinal",
        "cluster",
        zero("num_points").alias("expected"),
        "active",
        "onboarding",
        "attainment_pct",
        "priority",
        ratio(F.col("adv_sum"), F.col("partners"), 1).alias("avg_adv"),
    )


def expansion_priority(df: DataFrame) -> DataFrame:
    """``df`` with its place in its station by the rounded attainment."""
    return _ranked(df, "attainment_pct", "priority")


def expansion_by_region(shown: DataFrame, visible: DataFrame) -> DataFrame:
    rated = region_partners(shown, visible).withColumn("attainment_pct", _rounded_attainment()).drop("geom")
    return expansion_priority(rated).select(
        "polygon_ordinal",
        F.col("cluster").alias("polygon"),
        "delivery_station",
        "active",
        "onboarding",
        zero("num_points").alias("expected"),
        "attainment_pct",
        "priority",
    )


def _with_status(table: DataFrame) -> DataFrame:
    """Adds status: whether ``shown``, the rounded value, meets the goal; null for a goal of 0 or none."""
    met = F.when(F.col("direction") == "at_most", F.col("shown") <= F.col("goal")).otherwise(F.col("shown") >= F.col("goal"))
    return table.withColumn("status", F.when(F.col("goal") > 0, F.when(met, "positive").otherwise("negative")))


def _cards(row: DataFrame, by: list[str], cards: list[tuple[str, Column, Column, Column, str]]) -> DataFrame:
    """A row per card (metric, value, shown value, goal, direction)."""
    cells = [
        F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), s.cast("double").alias("shown"), g.cast("double").alias("goal"), F.lit(d).alias("direction"))
        for m, v, s, g, d in cards
    ]
    return _with_status(row.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*"))


def expansion_totals(shown: DataFrame, visible: DataFrame, goals: dict[str, float] | None = None, by: Iterable[str] = ()) -> DataFrame:
    """Expected over the shown regions, active and onboarding over all visible partners: metric, value, goal, status."""
    goals, by = goals or K.EXPANSION_GOALS, list(by)
    people = visible.groupBy(*by).agg(F.count_if(_active()).alias("active"), F.count_if(_onboarding()).alias("onboarding"))
    area = shown.groupBy(*by).agg(F.coalesce(F.sum(zero("num_points")), F.lit(0.0)).alias("expected"))
    both = people.join(area, by, "full") if by else people.crossJoin(area)  # one row each
    both = both.fillna({"active": 0, "onboarding": 0, "expected": 0.0})
    reached = F.col("active") + F.col("onboarding")
    cards = [(m, F.col(m), F.col(m), F.lit(goals[m]), "at_least") for m in ("expected", "active", "onboarding")]
    cards.append(
        ("attainment_pct", share(reached, F.col("expected"), 100.0), ratio(reached, F.col("expected"), 1, 100), F.lit(goals["attainment_pct"]), "at_least")
    )
    return _cards(both, by, cards).select(*by, "metric", "value", "goal", "status")


def performance_kpis(visible: DataFrame, period: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    by = list(by)
    msd = lambda c: zero(f"main_store_data.{c}")
    when_active = lambda v: F.when(_active(), v)
    row = visible.groupBy(*by).agg(
        F.count_if(_active()).alias("active"),
        F.coalesce(F.avg(when_active(zero("ADV"))), F.lit(0.0)).alias("adv_mean"),
        F.coalesce(F.sum(msd("dispatched_packages")), F.lit(0.0)).alias("dispatched"),
        F.coalesce(F.sum(msd("delivered_packages")), F.lit(0.0)).alias("delivered"),
        *(F.coalesce(F.avg(when_active(msd(c))), F.lit(0.0)).alias(c) for c in RATES),
    )
    days = (F.abs(F.date_diff("end_date", "start_date")) + 1).cast("long")
    return row.crossJoin(F.broadcast(period.select(days.alias("period_days")).limit(1)))  # one row


def performance_goals(kpis: DataFrame, goals: dict[str, float] | None = None, by: Iterable[str] = ()) -> DataFrame:
    """KPIs as cards: metric, value, card_value, goal, direction, status.

    Rates are in percent; their cards show the mean rounded to one decimal
    before it is multiplied, and the status is that of the card.
    """
    goals, by = goals or K.PERFORMANCE_GOALS, list(by)
    per_day = F.col("active") * F.lit(K.PACKAGES_PER_PARTNER)
    cards = [
        ("active", F.col("active"), F.col("active"), F.lit(goals["active"]), "at_least"),
        ("adv_mean", F.col("adv_mean"), F.round("adv_mean", 0), F.lit(goals["adv_mean"]), "at_least"),
        ("dispatched", F.col("dispatched"), F.col("dispatched"), per_day * F.col("period_days"), "at_least"),
        ("delivered", F.col("delivered"), F.col("delivered"), per_day * K.DELIVERED_SHARE, "at_least"),
        *((c, F.col(c) * 100, F.round(c, 1) * 100, F.lit(goals[c]), "at_least") for c in RATES),
    ]
    return _cards(kpis, by, cards).select(*by, "metric", "value", F.col("shown").alias("card_value"), "goal", "direction", "status")


def station_average(partners: DataFrame) -> DataFrame:
    """store_id, station_adv: the mean ADV of the Active partners of its station, missing stations being one."""
    means = partners.where(_active()).groupBy(F.col("delivery_station").alias("_s")).agg(F.avg(zero("ADV")).alias("_mean"))
    joined = partners.select("store_id", "delivery_station").join(means, F.col("delivery_station").eqNullSafe(F.col("_s")), "left")
    return joined.select("store_id", F.coalesce("_mean", F.lit(0.0)).alias("station_adv"))


def partner_headline(partners: DataFrame) -> DataFrame:
    means = partners.where(_active()).groupBy(F.col("delivery_station").alias("_s")).agg(F.avg(zero("ADV")).alias("_mean"))
    joined = partners.join(means, F.col("delivery_station").eqNullSafe(F.col("_s")), "left")
    pct = lambda c: F.round(zero(f"main_store_data.{c}") * 100, 1).alias(f"{c}_pct")
    return joined.select(
        "store_id",
        "name",
        F.round(zero("ADV"), 0).alias("adv"),
        F.round(F.coalesce("_mean", F.lit(0.0)), 0).alias("station_adv"),
        pct("dcr"),
        pct("dea"),
        pct("ead"),
    )


def run_cost_lookup(df: DataFrame, station_cost: DataFrame, default: float = K.DEFAULT_COST) -> DataFrame:
    """``df`` with cost_per_run of its station; the default where the station is unknown or costs 0."""
    costs = station_cost.groupBy(F.col("delivery_station").alias("_s")).agg(F.first("cost").alias("_cost"))
    joined = df.join(costs, F.col("delivery_station") == F.col("_s"), "left")
    return joined.withColumn("cost_per_run", F.coalesce(F.nullif("_cost", F.lit(0.0)), F.lit(float(default)))).drop("_s", "_cost")


def routes_by_run(visible: DataFrame, station_cost: DataFrame) -> DataFrame:
    """A row per supply run; its station is that of its first partner in file order."""
    packages, days = zero("main_store_data.dispatched_packages"), zero("main_store_data.working_days")
    first = F.min_by(F.struct("delivery_station"), "partner_ordinal")["delivery_station"]
    runs = visible.where(truthy("supply_run")).groupBy(F.col("supply_run").alias("route")).agg(
        first.alias("delivery_station"),
        F.count_if(_active()).alias("active"),
        F.count_if(_has("status", "Onboarding")).alias("onboarding"),
        F.count_if(_has("hub_delivey_initiatives", K.HOST)).alias("hosts"),
        F.count_if(_has("hub_delivey_initiatives", K.PICKUP)).alias("pickups"),
        F.sum(packages).alias("_packages"),
        F.greatest(F.max(days), F.lit(1.0)).alias("_days"),
    )
    cost = F.col("cost_per_run") * F.col("_days")
    return run_cost_lookup(runs, station_cost).select(
        "route",
        "delivery_station",
        "active",
        "onboarding",
        "hosts",
        "pickups",
        ratio(F.col("_packages"), F.col("_days")).alias("spr"),
        ratio(cost, F.col("_packages"), 2).alias("cpp"),
    )


def routes_totals(runs: DataFrame, visible: DataFrame, goals: dict[str, float] | None = None, by: Iterable[str] = ()) -> DataFrame:
    """Run count, mean of the runs' rounded figures, and hosts and pick-ups on the first rate card."""
    goals, by = goals or K.ROUTE_GOALS, list(by)
    own = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.avg("spr"), F.lit(0.0)).alias("spr_mean"), F.coalesce(F.avg("cpp"), F.lit(0.0)).alias("cpp_mean")
    )
    tier = _active() & _has("HCP_rate_card", K.RATE_TIER)
    people = visible.groupBy(*by).agg(
        F.count_if(_active()).alias("active"),
        F.count_if(tier & _has("hub_delivey_initiatives", K.HOST)).alias("hosts"),
        F.count_if(tier & _has("hub_delivey_initiatives", K.PICKUP)).alias("pickups"),
    )
    hundredth = F.col("active") * round(K.HOST_SHARE * 100)
    per_host = ratio(F.col("pickups"), F.col("hosts"))
    cards = [
        ("runs", F.col("runs"), F.col("runs"), F.lit(0.0), "at_least"),
        ("spr_mean", F.col("spr_mean"), F.round("spr_mean", 0), F.lit(goals["spr_mean"]), "at_least"),
        ("cpp_mean", F.col("cpp_mean"), F.round("cpp_mean", 2), F.lit(goals["cpp_mean"]), "at_most"),
        ("hosts", F.col("hosts"), F.col("hosts"), ratio(hundredth, F.lit(100)), "at_least"),
        ("pickups", F.col("pickups"), F.col("pickups"), ratio(hundredth * K.PICKUPS_PER_HOST, F.lit(100)), "at_least"),
        ("pickups_per_host", per_host, per_host, F.lit(goals["pickups_per_host"]), "at_least"),
    ]
    if by:
        people = people.withColumnsRenamed({c: f"_{c}" for c in by})
        both = own.join(people, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "full")
        both = both.withColumns({c: F.coalesce(c, f"_{c}") for c in by}).fillna(0, ["runs", "spr_mean", "cpp_mean", "active", "hosts", "pickups"])
    else:
        both = own.crossJoin(people)  # one row each
    return _cards(both, by, cards).select(*by, "metric", "value", "goal", "direction", "status")


def flatten_main_store(partners: DataFrame) -> DataFrame:
    """Top-level and nested figures in one row; a nested value takes the place of the top-level one."""
    nested = [f.name for f in partners.schema["main_store_data"].dataType.fields]
    top = {c.lower() for c in partners.columns}
    names = {n.lower() for n in nested}
    kept = [c for c in partners.columns if c.lower() not in names and c not in ("main_store_data", "overlap_data")]
    own = [F.coalesce(F.col(f"main_store_data.{n}"), F.col(n)).alias(n) if n.lower() in top else F.col(f"main_store_data.{n}").alias(n) for n in nested]
    return partners.select(*kept, *own)


def performance_table(visible: DataFrame) -> DataFrame:
    return flatten_main_store(visible).select(
        "store_id", "name", "delivery_station", "ADV", "dispatched_packages", "delivered_packages", "dea", "ead", "dcr", "fdds", "ftds"
    )


def comparison_matrix(partners: DataFrame, metrics: dict[str, bool] | None = None, slots: int = 4, alone: bool = True) -> DataFrame:
    """Every partner's metrics beside those of its first overlapping partners, one row per cell.

    A partner without any has a row per metric with no slot; without ``alone`` it has none.
    """
    metrics = metrics or K.METRICS
    exploded = F.posexplode_outer if alone else F.posexplode
    near = partners.select("store_id", "main_store_data", exploded(F.slice("overlap_data", 1, slots)).alias("_at", "o"))
    cells = [
        F.struct(
            F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(f"main_store_data.{m}").alias("main_value"), F.col(f"o.{m}").alias("value")
        )
        for m, up in metrics.items()
    ]
    other = ("overlap_id", F.col("o.overlap_id")), ("overlap_store_id", F.col("o.store_id"))
    rows = near.select("store_id", (F.col("_at") + 1).alias("slot"), *(c.alias(n) for n, c in other), F.explode(F.array(*cells)).alias("c"))
    rows = rows.select("store_id", "slot", "overlap_id", "overlap_store_id", "c.*")
    more, less = F.col("value") > F.col("main_value"), F.col("value") < F.col("main_value")
    better, worse = F.when(F.col("up"), more).otherwise(less), F.when(F.col("up"), less).otherwise(more)
    kind = F.when(better, "better-value").when(worse, "worse-value").otherwise("")
    return rows.select("store_id", "metric", "main_value", "slot", "overlap_id", "overlap_store_id", "value", kind.alias("class"))


def resolve_route_endpoints(requests: DataFrame, partners: DataFrame) -> DataFrame:
    """Coordinates of both ends of each request (request_id, from_id, to_id), or why there are none."""
    ends = partners.groupBy("store_id").agg(F.min_by(F.struct("lat", "lon"), "partner_ordinal").alias("p"))
    side = lambda s: ends.select(F.col("store_id").alias(f"_{s}"), F.col("p.lat").alias(f"{s}_lat"), F.col("p.lon").alias(f"{s}_lon"))
    joined = requests.join(side("from"), F.col("from_id") == F.col("_from"), "left").join(side("to"), F.col("to_id") == F.col("_to"), "left")
    outcome = (
        F.when(~truthy("from_id") | ~truthy("to_id"), "missing_endpoint")
        .when(F.col("_from").isNull() | F.col("_to").isNull(), "invalid_partner")
        .otherwise("resolved")
    )
    rows = joined.withColumn("outcome", outcome)
    given = lambda c: F.when(F.col("outcome") == "resolved", F.col(c)).alias(c)
    return rows.select("request_id", "from_id", "to_id", given("from_lat"), given("from_lon"), given("to_lat"), given("to_lon"), "outcome")


def category_encoding(visible: DataFrame, field: str, palette: tuple[str, ...] = K.PALETTE) -> tuple[DataFrame, DataFrame]:
    """Legend (value, color) of a field's distinct values in order, and store_id, value, color of every row."""
    value = F.when(truthy(field), F.col(field).cast("string")).otherwise(F.lit("N/A"))
    rows = visible.select("store_id", value.alias("value"))
    place = (F.col("place") - 1) % len(palette)
    color = F.element_at(F.array(*(F.lit(c) for c in palette)), (place + 1).cast("int"))
    legend = scans.placed(rows.select("value").distinct(), [], ["value"]).select("value", color.alias("color"))
    # legends have as many rows as a field has values; Spark broadcasts them when they are small
    colored = rows.join(legend, "value", "left").select("store_id", "value", F.coalesce("color", F.lit(K.NO_COLOR)).alias("color"))
    return legend, colored


def numeric_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` with text columns that hold numbers as doubles."""
    return df.withColumns({c: as_number(c) for c in columns})
