"""Constant tables. The values are fixed by the business rules; callers may pass their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Cost of one supply run by station, and for any other station.
STATION_COST = {
    "DSP2": 590, "DSP3": 560, "DSP4": 600, "DSP5": 780, "DBH5": 850, "DRJ3": 680, "DGO2": 670, "DBS5": 550,
    "DES2": 1065, "DPE4": 700, "DPB3": 750, "DCE3": 820, "DSA8": 750, "DPR2": 1080, "DRS5": 1060,
}
DEFAULT_COST = 600.0

#: Goals that do not depend on the data, by metric.
PERFORMANCE_GOALS = {"active": 600.0, "adv_mean": 40.0, "ead": 98.5, "dea": 98.5, "dcr": 96.0, "fdds": 97.0, "ftds": 98.5}
PACKAGES_PER_PARTNER, DELIVERED_SHARE = 40.0, 0.985
EXPANSION_GOALS = {"expected": 0.0, "active": 85.0, "onboarding": 25.0, "attainment_pct": 80.0}
ROUTE_GOALS = {"spr_mean": 480.0, "cpp_mean": 2.5, "pickups_per_host": 4.0}
HOST_SHARE, PICKUPS_PER_HOST = 0.12, 4
DAILY_TARGETS = (580, 11)

#: Bands of a scale, from the highest on; the last one holds all that is below.
PROGRESS_BANDS = ((100.0, "success"), (70.0, "warning"), (0.0, "danger"))
SCORE_BANDS = ((80.0, "green"), (60.0, "gold"), (0.0, "red"))

#: Compared metrics in display order; True if more is better.
METRICS = {
    "radius": True,
    "total_packages_allocated": True,
    "ADV": True,
    "partner_capacity": True,
    "eligible_packages": True,
    "working_days": True,
    "capped_days": False,
    "overlapping_count": False,
}
#: Colours of categories in order, and of what has none.
PALETTE = ("#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00", "#ffff33", "#a65628", "#f781bf", "#999999")
NO_COLOR, REGION_COLOR, JURISDICTION_COLOR = "#808080", "#3388ff", "#6E00B3"

OUTSIDE = "Fora das Regiões"
HOST, PICKUP, RATE_TIER = "HCP Host Partner", "HCP Pick Up Partner", "Tier 1"


def reference_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The constant tables as DataFrames: station_cost, goals, bands, metrics, palette."""
    goals = [*(("performance", k, v, "at_least") for k, v in PERFORMANCE_GOALS.items()), *(("expansion", k, v, "at_least") for k, v in EXPANSION_GOALS.items())]
    goals += [("routes", k, v, "at_most" if k == "cpp_mean" else "at_least") for k, v in ROUTE_GOALS.items()]
    bands = [(scale, start, name) for scale, own in (("progress", PROGRESS_BANDS), ("score", SCORE_BANDS)) for start, name in own]
    return {
        "station_cost": spark.createDataFrame([(k, float(v)) for k, v in STATION_COST.items()], "delivery_station STRING, cost DOUBLE"),
        "goals": spark.createDataFrame(goals, "board STRING, metric STRING, goal DOUBLE, direction STRING"),
        "bands": spark.createDataFrame(bands, "scale STRING, from_value DOUBLE, band STRING"),
        "metrics": spark.createDataFrame(list(METRICS.items()), "metric STRING, higher_is_better BOOLEAN"),
        "palette": spark.createDataFrame(list(enumerate(PALETTE)), "place INT, color STRING"),
    }
