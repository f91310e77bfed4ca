"""One registered query per operator, over the mapped tables, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, partners, scorecard, spatial
from ..sources import constants as K
from ..sources import documents
from .tables import AS_OF, Tables, as_documents, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STATIONS = ("DSP2", "DSP3", "DSP4", "DBH5", "DXX10", "DXX11", "DXX12")
_IN = ", ".join(f"'{s}'" for s in STATIONS)

#: Common table expressions that only the SQL side uses: regions by point in polygon, and the filtered sets.
_EXTRA = {
    "rings": "SELECT polygon_ordinal, cluster, unnest(flatten(geom)) AS ring FROM regions",
    "corners": "SELECT polygon_ordinal, cluster, ring, unnest(range(1, len(ring))) AS i FROM rings",
    "edges": "SELECT polygon_ordinal, cluster, ring[i][1] AS ax, ring[i][2] AS ay, ring[i + 1][1] AS bx, ring[i + 1][2] AS by_ FROM corners",
    "sides": """SELECT fk, polygon_ordinal, cluster, lon, lat, ax, ay, bx, by_, (bx - ax) * (lat - ay) - (lon - ax) * (by_ - ay) AS side
                FROM partner_flat, edges WHERE lon IS NOT NULL AND lat IS NOT NULL""",
    "hits": """SELECT fk, polygon_ordinal, cluster FROM sides GROUP BY fk, polygon_ordinal, cluster
               HAVING count(*) FILTER ((ay > lat) <> (by_ > lat) AND (side > 0) = (by_ > ay)) % 2 = 1
               OR count(*) FILTER (side = 0 AND lon BETWEEN least(ax, bx) AND greatest(ax, bx) AND lat BETWEEN least(ay, by_) AND greatest(ay, by_)) > 0""",
    "firsts": "SELECT fk AS hk, arg_min(cluster, polygon_ordinal) AS hit FROM hits GROUP BY fk",
    "located": f"""SELECT partner_flat.* EXCLUDE (regiao), coalesce(nullif(hit, ''), '{K.OUTSIDE}') AS regiao, hk IS NOT NULL AS matched
                   FROM partner_flat LEFT JOIN firsts ON hk = fk""",
    "visible": f"SELECT * FROM located WHERE delivery_station IN ({_IN})",
    "shown": f"SELECT * FROM regions WHERE delivery_station IN ({_IN})",
}
_GEO = ("partner_flat", "regions")


def _query(name: str, tables: tuple[str, ...], sql: str, extra: tuple[str, ...] = ()):
    """Register a function of the mapped tables and the SQL over the same ones."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        ORACLE_SQL[name] = duckdb_sql(tables, "\n" + sql, {k: _EXTRA[k] for k in extra})
        return build

    return register


_ALL = tuple(_EXTRA)
_LOCATED = tuple(k for k in _EXTRA if k not in ("visible", "shown"))


def _located(t: Tables) -> DataFrame:
    return spatial.associate_regions(t.plain_partners, t.regions)


def _visible(t: Tables) -> DataFrame:
    return filters.filter_partners(_located(t), stations=STATIONS)


def _shown(t: Tables) -> DataFrame:
    return filters.filter_regions(t.regions, STATIONS)


def _at_stations(t: Tables) -> DataFrame:
    """Filtered partners for queries that need no region."""
    return filters.filter_partners(t.plain_partners, stations=STATIONS)


# --- filters ---------------------------------------------------------------


@_query(
    "f1_filter_partners",
    ("partner_flat",),
    f"""SELECT partner_ordinal, store_id, status, delivery_station FROM partner_flat
        WHERE status = 'Active' AND delivery_station IN ({_IN}) AND hub_delivey_initiatives = 'HCP Pick Up Partner' AND jurisdiction_type = 'Shared'""",
)
def _f1(t: Tables) -> DataFrame:
    found = filters.filter_partners(t.plain_partners, "Active", STATIONS, K.PICKUP, "Shared")
    return found.select("partner_ordinal", "store_id", "status", "delivery_station")


@_query("f3_filter_regions", ("regions",), f"SELECT polygon_ordinal, cluster, delivery_station, coalesce(nullif(cor, ''), '{K.REGION_COLOR}') AS color FROM regions WHERE delivery_station IN ({_IN})")
def _f3(t: Tables) -> DataFrame:
    return _shown(t).select("polygon_ordinal", "cluster", "delivery_station", "color")


@_query("f4_filter_jurisdictions", ("jurisdictions",), f"SELECT polygon_ordinal, delivery_station, coalesce(nullif(cor, ''), '{K.JURISDICTION_COLOR}') AS color FROM jurisdictions WHERE delivery_station IN ({_IN})")
def _f4(t: Tables) -> DataFrame:
    return filters.filter_jurisdictions(t.jurisdictions, STATIONS).select("polygon_ordinal", "delivery_station", "color")


@_query(
    "f5_highlight_partners",
    ("partner_flat",),
    f"""SELECT store_id FROM partner_flat WHERE delivery_station IN ({_IN})
        AND coalesce(eligible_packages, 0) > 100 AND coalesce(ADV, 0) < 60 AND abs(coalesce(overlapping_count, 0) - 3) < 0.001 AND status = 'Active'""",
)
def _f5(t: Tables) -> DataFrame:
    return filters.highlight_partners(_at_stations(t), ("gt", 100), ("lt", 60), ("eq", 3), "Active").select("store_id")


@_query("f6_filter_leads", ("leads",), "SELECT lead_ordinal, responsavel, origem FROM leads WHERE responsavel = 'P3' AND origem = 'click'")
def _f6(t: Tables) -> DataFrame:
    return filters.filter_leads(t.leads, "P3", "click").select("lead_ordinal", "responsavel", "origem")


@_query("f7_filter_owner_scores", ("leads", "owner_scores"), "SELECT responsavel, contatos, cadastros, conversoes FROM owner_scores WHERE responsavel = 'P3'")
def _f7(t: Tables) -> DataFrame:
    return filters.filter_owner_scores(t.owner_scores, "P3").select("responsavel", "contatos", "cadastros", "conversoes")


_LEAD_TEXT = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'N/A')" for c in ("lead_ordinal", "responsavel", "origem", "data_contato", "data_cadastro", "data_conversao"))


@_query("f8_search_rows", ("leads",), f"SELECT lead_ordinal, responsavel, origem FROM leads WHERE contains(lower(concat({_LEAD_TEXT})), 'p7click2024-01-1')")
def _f8(t: Tables) -> DataFrame:
    return filters.search_rows(t.leads, "P7Click2024-01-1").select("lead_ordinal", "responsavel", "origem")


#: Typed texts, one of each kind for every row of the region table: part of a name, part of an id, one character.
_TERMS = """SELECT CAST(r_regionkey AS BIGINT) AS term_id, concat('#', lpad(CAST(r_regionkey * 3 + 1 AS VARCHAR(5)), 2, '0')) AS term FROM region
            UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 100, concat('sT', CAST(r_regionkey * 11 AS VARCHAR(5))) FROM region
            UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 200, 'x' FROM region"""


def _terms(t: Tables) -> DataFrame:
    key = F.col("r_regionkey").cast("long")
    rows = [
        (key.alias("term_id"), F.concat(F.lit("#"), F.lpad((key * 3 + 1).cast("string"), 2, "0")).alias("term")),
        ((key + 100).alias("term_id"), F.concat(F.lit("sT"), (key * 11).cast("string")).alias("term")),
        ((key + 200).alias("term_id"), F.lit("x").alias("term")),
    ]
    out = t.region.select(*rows[0])
    return out.unionAll(t.region.select(*rows[1])).unionAll(t.region.select(*rows[2]))


@_query(
    "f9_autocomplete_partners",
    ("partner_flat",),
    f"""SELECT term_id, CAST(row_number() OVER (PARTITION BY term_id ORDER BY partner_ordinal) AS INTEGER) AS place, store_id, name,
          concat(name, ' (', store_id, ')') AS label
        FROM partner_flat JOIN ({_TERMS}) ON length(term) >= 2 AND (contains(lower(name), lower(term)) OR contains(lower(store_id), lower(term)))
        QUALIFY place <= 5""",
)
def _f9(t: Tables) -> DataFrame:
    return filters.autocomplete_partners(t.plain_partners, _terms(t))


_LOOKUP = f"""SELECT terms.term_id, store_id, name, lat, lon,
          CASE WHEN store_id IS NULL THEN 'not_found' WHEN delivery_station IN ({_IN}) THEN 'found' ELSE 'filtered_out' END AS outcome
        FROM ({_TERMS}) terms LEFT JOIN (
          SELECT term_id, partner_flat.* FROM partner_flat JOIN ({_TERMS}) ON lower(store_id) = lower(term) OR contains(lower(name), lower(term))
          QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY partner_ordinal) = 1) USING (term_id)"""


@_query("f10_lookup_partner", ("partner_flat",), _LOOKUP)
def _f10(t: Tables) -> DataFrame:
    return filters.lookup_partner(t.plain_partners, _at_stations(t), _terms(t))


# --- regions ---------------------------------------------------------------


@_query("g1_associate_regions", _GEO, "SELECT partner_ordinal, regiao, matched FROM located", _LOCATED)
def _g1(t: Tables) -> DataFrame:
    return _located(t).select("partner_ordinal", "regiao", "matched")


@_query("g2_association_counts", _GEO, "SELECT count(*) FILTER (matched) AS matched, count(*) AS total FROM located", _LOCATED)
def _g2(t: Tables) -> DataFrame:
    return spatial.association_counts(_located(t))


_BY_REGION = """SELECT r.*, coalesce(active, 0) AS active, coalesce(onboarding, 0) AS onboarding, coalesce(partners, 0) AS partners, coalesce(adv_sum, 0) AS adv_sum
  FROM {0} r LEFT JOIN (SELECT regiao, count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status IN ('Onboarding', 'BG Checks')) AS onboarding,
    count(*) AS partners, sum(coalesce(ADV, 0)) AS adv_sum FROM {1} GROUP BY regiao) ON regiao = cluster"""
_ATTAINED = "CASE WHEN coalesce(num_points, 0) > 0 THEN CAST(active + onboarding AS DOUBLE) / num_points * 100 ELSE 0 END"
_ATTAINED_1 = "CASE WHEN coalesce(num_points, 0) > 0 THEN floor(((active + onboarding) * 2000 + num_points) / (num_points * 2)) / 10 ELSE 0 END"


def _placed(attained: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY delivery_station ORDER BY {attained}, coalesce(num_points, 0) DESC, polygon_ordinal) AS INTEGER)"


_PRIORITY = f"""SELECT delivery_station, cluster, min(priority) AS priority
  FROM (SELECT *, {_placed(_ATTAINED)} AS priority FROM ({_BY_REGION.format("regions", "located")})) GROUP BY delivery_station, cluster"""


@_query("j1_region_partners", _GEO, f"SELECT polygon_ordinal, cluster, active, onboarding, partners, adv_sum FROM ({_BY_REGION.format('regions', 'visible')})", _ALL)
def _j1(t: Tables) -> DataFrame:
    return partners.region_partners(t.regions, _visible(t)).select("polygon_ordinal", "cluster", "active", "onboarding", "partners", "adv_sum")


_A1 = f"""SELECT r.polygon_ordinal, r.cluster, coalesce(num_points, 0) AS expected, active, onboarding, {_ATTAINED} AS attainment_pct, priority,
          CASE WHEN partners > 0 THEN floor((adv_sum * 20 + partners) / (partners * 2)) / 10 ELSE 0 END AS avg_adv
        FROM ({_BY_REGION.format("shown", "located")}) r LEFT JOIN ({_PRIORITY}) p
          ON r.delivery_station IS NOT DISTINCT FROM p.delivery_station AND r.cluster IS NOT DISTINCT FROM p.cluster"""


@_query("a1_region_summary", _GEO, _A1, _ALL)
def _a1(t: Tables) -> DataFrame:
    return partners.region_summary(_shown(t), t.regions, _located(t))


@_query("w1_region_priority", _GEO, _PRIORITY, _LOCATED)
def _w1(t: Tables) -> DataFrame:
    return partners.region_priority(t.regions, _located(t))


_EXPANSION = f"""SELECT polygon_ordinal, cluster AS polygon, delivery_station, active, onboarding, coalesce(num_points, 0) AS expected,
  {_ATTAINED_1} AS attainment_pct, {_placed(_ATTAINED_1)} AS priority FROM ({_BY_REGION.format("shown", "visible")})"""


@_query("a4_expansion_by_region", _GEO, _EXPANSION, _ALL)
def _a4(t: Tables) -> DataFrame:
    return partners.expansion_by_region(_shown(t), _visible(t))


@_query("w2_expansion_priority", _GEO, f"SELECT polygon_ordinal, delivery_station, attainment_pct, priority FROM ({_EXPANSION})", _ALL)
def _w2(t: Tables) -> DataFrame:
    rated = partners.region_partners(_shown(t), _visible(t)).withColumn("attainment_pct", partners._rounded_attainment()).drop("geom")
    return partners.expansion_priority(rated).select("polygon_ordinal", "delivery_station", "attainment_pct", "priority")


def _cards_sql(cards: list[tuple[str, str, str, str, str]], source: str, columns: str, by: str = "") -> str:
    """Cards as rows: (metric, value, shown, goal, direction) over a source of one row, or one for each ``by``."""
    rows = "\nUNION ALL ".join(
        f"SELECT {by and by + ', '}'{m}' AS metric, CAST({v} AS DOUBLE) AS value, CAST({s} AS DOUBLE) AS card_value, CAST({g} AS DOUBLE) AS goal, '{d}' AS direction FROM one"
        for m, v, s, g, d in cards
    )
    met = "CASE WHEN direction = 'at_most' THEN card_value <= goal ELSE card_value >= goal END"
    return f"SELECT {columns}, CASE WHEN goal > 0 THEN CASE WHEN {met} THEN 'positive' ELSE 'negative' END END AS status FROM (WITH one AS ({source}) {rows})"


_EXPANSION_CARDS = [
    ("expected", "expected", "expected", "0", "at_least"),
    ("active", "active", "active", "85", "at_least"),
    ("onboarding", "onboarding", "onboarding", "25", "at_least"),
    (
        "attainment_pct",
        "CASE WHEN expected > 0 THEN (active + onboarding) / expected * 100 ELSE 0 END",
        "CASE WHEN expected > 0 THEN floor(((active + onboarding) * 2000 + expected) / (expected * 2)) / 10 ELSE 0 END",
        "80",
        "at_least",
    ),
]
_PEOPLE = "count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status IN ('Onboarding', 'BG Checks')) AS onboarding"


@_query(
    "a5_expansion_totals",
    _GEO,
    _cards_sql(_EXPANSION_CARDS, f"SELECT {_PEOPLE}, (SELECT coalesce(sum(num_points), 0) FROM shown) AS expected FROM visible", "metric, value, goal"),
    _ALL,
)
def _a5(t: Tables) -> DataFrame:
    return partners.expansion_totals(_shown(t), _visible(t))


@_query(
    "a5_expansion_totals_by_station",
    _GEO,
    _cards_sql(
        _EXPANSION_CARDS,
        f"""SELECT coalesce(v.delivery_station, s.delivery_station) AS delivery_station, coalesce(active, 0) AS active, coalesce(onboarding, 0) AS onboarding,
              coalesce(expected, 0) AS expected
            FROM (SELECT delivery_station, {_PEOPLE} FROM visible GROUP BY delivery_station) v
            FULL JOIN (SELECT delivery_station, coalesce(sum(num_points), 0) AS expected FROM shown GROUP BY delivery_station) s ON v.delivery_station = s.delivery_station""",
        "delivery_station, metric, value, goal",
        "delivery_station",
    ),
    _ALL,
)
def _a5_by(t: Tables) -> DataFrame:
    return partners.expansion_totals(_shown(t), _visible(t), by=["delivery_station"])


@_query(
    "a16_extent",
    ("partner_flat",),
    f"""SELECT min(lat) - (max(lat) - min(lat)) * 0.1e0 AS min_lat, max(lat) + (max(lat) - min(lat)) * 0.1e0 AS max_lat,
          min(lon) - (max(lon) - min(lon)) * 0.1e0 AS min_lon, max(lon) + (max(lon) - min(lon)) * 0.1e0 AS max_lon
        FROM partner_flat WHERE delivery_station IN ({_IN}) HAVING count(lat) > 0""",
)
def _a16(t: Tables) -> DataFrame:
    return spatial.extent(_at_stations(t))


@_query(
    "a16_extent_of_highlighted",
    ("partner_flat",),
    """SELECT min(lat) - (max(lat) - min(lat)) * 0.1e0 AS min_lat, max(lat) + (max(lat) - min(lat)) * 0.1e0 AS max_lat,
         min(lon) - (max(lon) - min(lon)) * 0.1e0 AS min_lon, max(lon) + (max(lon) - min(lon)) * 0.1e0 AS max_lon
       FROM partner_flat WHERE coalesce(eligible_packages, 0) > 100 AND coalesce(ADV, 0) < 60 AND status = 'Active' HAVING count(lat) > 0""",
)
def _a16_highlighted(t: Tables) -> DataFrame:
    return spatial.extent(filters.highlight_partners(t.plain_partners, ("gt", 100), ("lt", 60), status="Active"))


# --- performance -----------------------------------------------------------

_KPIS = f"""SELECT (SELECT date_diff('day', min(data_contato), max(data_contato)) + 1 FROM leads) AS period_days,
  count(*) FILTER (status = 'Active') AS active, coalesce(avg(coalesce(ADV, 0)) FILTER (status = 'Active'), 0) AS adv_mean,
  coalesce(sum(dispatched_packages), 0) AS dispatched, coalesce(sum(delivered_packages), 0) AS delivered,
  {", ".join(f"coalesce(avg(coalesce({c}, 0)) FILTER (status = 'Active'), 0) AS {c}" for c in partners.RATES)}
  FROM partner_flat WHERE delivery_station IN ({_IN})"""


@_query("a2_performance_kpis", ("partner_flat", "leads"), _KPIS)
def _a2(t: Tables) -> DataFrame:
    return partners.performance_kpis(_at_stations(t), t.period)


@_query("a2_performance_kpis_by_station", ("partner_flat", "leads"), f"{_KPIS.replace('SELECT (SELECT', 'SELECT delivery_station, (SELECT', 1)} GROUP BY delivery_station")
def _a2_by(t: Tables) -> DataFrame:
    return partners.performance_kpis(_at_stations(t), t.period, by=["delivery_station"])


@_query(
    "a3_performance_goals",
    ("partner_flat", "leads"),
    _cards_sql(
        [
            ("active", "active", "active", "600", "at_least"),
            ("adv_mean", "adv_mean", "round(adv_mean)", "40", "at_least"),
            ("dispatched", "dispatched", "dispatched", "active * 40e0 * period_days", "at_least"),
            ("delivered", "delivered", "delivered", "active * 40e0 * 0.985e0", "at_least"),
            *((c, f"{c} * 100", f"round({c}, 1) * 100", str(K.PERFORMANCE_GOALS[c]), "at_least") for c in partners.RATES),
        ],
        _KPIS,
        "metric, value, card_value, goal, direction",
    ),
)
def _a3(t: Tables) -> DataFrame:
    return partners.performance_goals(partners.performance_kpis(_at_stations(t), t.period))


_STATION_MEAN = "SELECT delivery_station, avg(coalesce(ADV, 0)) AS m FROM partner_flat WHERE status = 'Active' GROUP BY delivery_station"


@_query("j2_station_average", ("partner_flat",), f"SELECT store_id, coalesce(m, 0) AS station_adv FROM partner_flat p LEFT JOIN ({_STATION_MEAN}) s ON p.delivery_station IS NOT DISTINCT FROM s.delivery_station")
def _j2(t: Tables) -> DataFrame:
    return partners.station_average(t.plain_partners)


@_query(
    "a8_partner_headline",
    ("partner_flat",),
    f"""SELECT store_id, name, round(coalesce(ADV, 0)) AS adv, round(coalesce(m, 0)) AS station_adv, round(coalesce(dcr, 0) * 100, 1) AS dcr_pct,
          round(coalesce(dea, 0) * 100, 1) AS dea_pct, round(coalesce(ead, 0) * 100, 1) AS ead_pct
        FROM partner_flat p LEFT JOIN ({_STATION_MEAN}) s ON p.delivery_station IS NOT DISTINCT FROM s.delivery_station""",
)
def _a8(t: Tables) -> DataFrame:
    return partners.partner_headline(t.plain_partners)


@_query(
    "j6_flatten_main_store",
    ("partner_flat",),
    "SELECT store_id, status, radius, ADV, eligible_packages, overlapping_count, partner_capacity, working_days, dispatched_packages, ead FROM partner_flat",
)
def _j6(t: Tables) -> DataFrame:
    names = "store_id status radius ADV eligible_packages overlapping_count partner_capacity working_days dispatched_packages ead"
    return partners.flatten_main_store(t.plain_partners).select(*names.split())


@_query("r2_performance_table", ("partner_flat",), f"SELECT store_id, name, delivery_station, ADV, dispatched_packages, delivered_packages, dea, ead, dcr, fdds, ftds FROM partner_flat WHERE delivery_station IN ({_IN})")
def _r2(t: Tables) -> DataFrame:
    return partners.performance_table(_at_stations(t))


_R1 = "\nUNION ALL ".join(
    f"SELECT store_id, '{m}' AS metric, p.{m} AS main_value, CAST(coalesce(k, 0) AS INTEGER) AS slot, coalesce(k, 0) AS overlap_id, "
    f"CASE WHEN k > 0 THEN concat('ST', CAST(other AS VARCHAR)) END AS overlap_store_id, o.{m} AS value, {up} AS up "
    "FROM partner_flat p LEFT JOIN (SELECT * FROM overlap_flat WHERE k <= 4) o ON p.fk = main"
    for m, up in K.METRICS.items()
)


@_query(
    "r1_comparison_matrix",
    ("partner_flat", "overlap_flat"),
    f"""SELECT store_id, metric, main_value, slot, overlap_id, overlap_store_id, value,
          CASE WHEN (up AND value > main_value) OR (NOT up AND value < main_value) THEN 'better-value'
               WHEN (up AND value < main_value) OR (NOT up AND value > main_value) THEN 'worse-value' ELSE '' END AS class
        FROM ({_R1})""",
)
def _r1(t: Tables) -> DataFrame:
    return partners.comparison_matrix(t.partners).fillna({"slot": 0, "overlap_id": 0})  # of partners alone


# --- supply runs -----------------------------------------------------------

_COST = f"coalesce(nullif(cost, 0), {K.DEFAULT_COST})"
_RUNS = f"""SELECT route, r.delivery_station, active, onboarding, hosts, pickups, floor((packages * 2 + days) / (days * 2)) AS spr,
    CASE WHEN packages > 0 THEN floor(({_COST} * days * 200 + packages) / (packages * 2)) / 100 ELSE 0 END AS cpp
  FROM (SELECT supply_run AS route, arg_min(ROW(delivery_station), partner_ordinal)[1] AS delivery_station, count(*) FILTER (status = 'Active') AS active,
      count(*) FILTER (status = 'Onboarding') AS onboarding, count(*) FILTER (hub_delivey_initiatives = 'HCP Host Partner') AS hosts,
      count(*) FILTER (hub_delivey_initiatives = 'HCP Pick Up Partner') AS pickups, sum(coalesce(dispatched_packages, 0)) AS packages,
      greatest(max(coalesce(working_days, 0)), 1) AS days
    FROM partner_flat WHERE delivery_station IN ({_IN}) AND supply_run <> '' GROUP BY supply_run) r
  LEFT JOIN station_cost c ON c.delivery_station = r.delivery_station"""


@_query("a6_routes_by_run", ("partner_flat", "station_cost"), _RUNS)
def _a6(t: Tables) -> DataFrame:
    return partners.routes_by_run(_at_stations(t), t.station_cost)


_PER_HOST = "CASE WHEN hosts > 0 THEN floor((pickups * 2 + hosts) / (hosts * 2e0)) ELSE 0 END"
_ROUTE_CARDS = [
    ("runs", "runs", "runs", "0", "at_least"),
    ("spr_mean", "spr_mean", "round(spr_mean)", "480", "at_least"),
    ("cpp_mean", "cpp_mean", "round(cpp_mean, 2)", "2.5", "at_most"),
    ("hosts", "hosts", "hosts", "floor((active * 24 + 100) / 200e0)", "at_least"),
    ("pickups", "pickups", "pickups", "floor((active * 96 + 100) / 200e0)", "at_least"),
    ("pickups_per_host", _PER_HOST, _PER_HOST, "4", "at_least"),
]
_TIER = """count(*) FILTER (status = 'Active') AS active,
  count(*) FILTER (status = 'Active' AND HCP_rate_card = 'Tier 1' AND hub_delivey_initiatives = 'HCP Host Partner') AS hosts,
  count(*) FILTER (status = 'Active' AND HCP_rate_card = 'Tier 1' AND hub_delivey_initiatives = 'HCP Pick Up Partner') AS pickups"""
_RUN_SUMS = "count(*) AS runs, coalesce(avg(spr), 0) AS spr_mean, coalesce(avg(cpp), 0) AS cpp_mean"


@_query(
    "a7_routes_totals",
    ("partner_flat", "station_cost"),
    _cards_sql(
        _ROUTE_CARDS,
        f"SELECT * FROM (SELECT {_RUN_SUMS} FROM ({_RUNS})), (SELECT {_TIER} FROM partner_flat WHERE delivery_station IN ({_IN}))",
        "metric, value, goal, direction",
    ),
)
def _a7(t: Tables) -> DataFrame:
    seen = _at_stations(t)
    return partners.routes_totals(partners.routes_by_run(seen, t.station_cost), seen)


@_query(
    "a7_routes_totals_by_station",
    ("partner_flat", "station_cost"),
    _cards_sql(
        _ROUTE_CARDS,
        f"""SELECT coalesce(r.delivery_station, v.delivery_station) AS delivery_station, coalesce(runs, 0) AS runs, coalesce(spr_mean, 0) AS spr_mean,
              coalesce(cpp_mean, 0) AS cpp_mean, coalesce(active, 0) AS active, coalesce(hosts, 0) AS hosts, coalesce(pickups, 0) AS pickups
            FROM (SELECT delivery_station, {_RUN_SUMS} FROM ({_RUNS}) GROUP BY delivery_station) r
            FULL JOIN (SELECT delivery_station, {_TIER} FROM partner_flat WHERE delivery_station IN ({_IN}) GROUP BY delivery_station) v
            ON r.delivery_station = v.delivery_station""",
        "delivery_station, metric, value, goal, direction",
        "delivery_station",
    ),
)
def _a7_by(t: Tables) -> DataFrame:
    seen = _at_stations(t)
    return partners.routes_totals(partners.routes_by_run(seen, t.station_cost), seen, by=["delivery_station"])


@_query("j3_run_cost_lookup", ("partner_flat", "station_cost"), f"SELECT store_id, {_COST} AS cost_per_run FROM partner_flat p LEFT JOIN station_cost c ON c.delivery_station = p.delivery_station")
def _j3(t: Tables) -> DataFrame:
    return partners.run_cost_lookup(t.plain_partners, t.station_cost).select("store_id", "cost_per_run")


def _requests(t: Tables) -> DataFrame:
    """Route requests from orders: some with an end missing or unknown."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    to = F.when(o % 7 == 0, "").when(o % 11 == 0, "ST-1").otherwise(F.concat(F.lit("ST"), (c * 3 % 1000).cast("string")))
    return t.orders.select(o.alias("request_id"), F.concat(F.lit("ST"), c.cast("string")).alias("from_id"), to.alias("to_id"))


@_query(
    "j5_resolve_route_endpoints",
    ("partner_flat",),
    """SELECT request_id, from_id, to_id, CASE WHEN ok THEN a.lat END AS from_lat, CASE WHEN ok THEN a.lon END AS from_lon,
         CASE WHEN ok THEN b.lat END AS to_lat, CASE WHEN ok THEN b.lon END AS to_lon,
         CASE WHEN to_id = '' THEN 'missing_endpoint' WHEN NOT ok THEN 'invalid_partner' ELSE 'resolved' END AS outcome
       FROM (SELECT o_orderkey AS request_id, concat('ST', CAST(o_custkey AS VARCHAR)) AS from_id,
               CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'ST-1' ELSE concat('ST', CAST(o_custkey * 3 % 1000 AS VARCHAR)) END AS to_id FROM orders) r
       LEFT JOIN partner_flat a ON a.store_id = from_id LEFT JOIN partner_flat b ON b.store_id = to_id,
       LATERAL (SELECT to_id <> '' AND a.store_id IS NOT NULL AND b.store_id IS NOT NULL AS ok)""",
)
def _j5(t: Tables) -> DataFrame:
    return partners.resolve_route_endpoints(_requests(t), t.plain_partners)


_COLORS = "CASE (row_number() OVER (ORDER BY value) - 1) % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(K.PALETTE)) + " END"
_VALUES = f"SELECT store_id, coalesce(nullif(hub_delivey_initiatives, ''), 'N/A') AS value FROM partner_flat WHERE delivery_station IN ({_IN})"


@_query(
    "r4_category_encoding",
    ("partner_flat",),
    f"""SELECT v.store_id, v.value, color FROM ({_VALUES}) v JOIN (SELECT value, {_COLORS} AS color FROM (SELECT DISTINCT value FROM ({_VALUES}))) l ON l.value = v.value""",
)
def _r4(t: Tables) -> DataFrame:
    return partners.category_encoding(_at_stations(t), "hub_delivey_initiatives")[1]


_RUN_VALUES = f"SELECT DISTINCT coalesce(nullif(supply_run, ''), 'N/A') AS value FROM partner_flat WHERE delivery_station IN ({_IN})"


@_query("r4_category_legend", ("partner_flat",), f"SELECT value, {_COLORS} AS color FROM ({_RUN_VALUES})")
def _r4_legend(t: Tables) -> DataFrame:
    return partners.category_encoding(_at_stations(t), "supply_run")[0]


# --- scorecard -------------------------------------------------------------


@_query(
    "a9_scorecard_kpis",
    ("leads", "totals"),
    """SELECT contacts, registrations, round(registrations * 100 / contacts, 2) AS registration_rate,
         round(least(1e0, registrations / greatest(contacts, 1) * 6) * 100) AS score
       FROM totals WHERE EXISTS (SELECT 1 FROM leads WHERE responsavel = 'P3')""",
)
def _a9(t: Tables) -> DataFrame:
    return scorecard.scorecard_kpis(t.goals_attained, filters.filter_owner_scores(t.owner_scores, "P3"))


_PROGRESS = """SELECT 'contacts' AS metric, contacts AS attained, contacts_goal AS goal, contacts * 100 / contacts_goal AS percent FROM totals
  UNION ALL SELECT 'registrations', registrations, registrations_goal, registrations * 100 / registrations_goal FROM totals"""


@_query("a10_goal_progress", ("leads", "totals"), f"SELECT *, CASE WHEN percent >= 100 THEN 'success' WHEN percent >= 70 THEN 'warning' ELSE 'danger' END AS band, least(percent, 100) AS bar FROM ({_PROGRESS})")
def _a10(t: Tables) -> DataFrame:
    return scorecard.goal_progress(t.goals_attained)


def _lead_groups(*keys: str) -> str:
    return f"""SELECT {", ".join(keys)}, count(*) AS contacts, count(data_cadastro) AS registrations, count(data_conversao) AS conversions,
      min(lead_ordinal) AS first, CAST(count(data_cadastro) AS DOUBLE) / count(*) * 100 AS rate FROM leads GROUP BY {", ".join(keys)}"""


@_query("a11_best_origin", ("leads",), f"SELECT origem, contacts, registrations, conversions, rate FROM ({_lead_groups('origem')}) WHERE rate > 0 ORDER BY rate DESC, first LIMIT 1")
def _a11(t: Tables) -> DataFrame:
    return scorecard.best_origin(t.leads)


_BEST = f"""SELECT responsavel, CASE WHEN rate > 0 THEN origem ELSE 'N/A' END AS best_origin, rate FROM ({_lead_groups("responsavel", "origem")})
  QUALIFY row_number() OVER (PARTITION BY responsavel ORDER BY rate DESC, first) = 1"""


@_query("a12_best_origin_per_owner", ("leads",), _BEST)
def _a12(t: Tables) -> DataFrame:
    return scorecard.best_origin_per_owner(t.leads)


@_query("j4_owner_best_origin", ("leads", "owner_scores"), f"SELECT responsavel, contatos, coalesce(best_origin, 'N/A') AS best_origin FROM owner_scores LEFT JOIN ({_BEST}) USING (responsavel)")
def _j4(t: Tables) -> DataFrame:
    return scorecard.owner_best_origin(t.owner_scores, scorecard.best_origin_per_owner(t.leads)).select("responsavel", "contatos", "best_origin")


@_query(
    "a13_owner_cards",
    ("leads", "owner_scores"),
    f"""SELECT responsavel, score_final * 100 AS score, CASE WHEN score_final * 100 >= 80 THEN 'green' WHEN score_final * 100 >= 60 THEN 'gold' ELSE 'red' END AS band,
          contatos AS contacts, cadastros AS registrations, conversoes AS conversions, coalesce(best_origin, 'N/A') AS best_origin
        FROM owner_scores LEFT JOIN ({_BEST}) USING (responsavel)""",
)
def _a13(t: Tables) -> DataFrame:
    return scorecard.owner_cards(t.owner_scores, t.leads)


@_query(
    "a14_podium_by_origin",
    ("leads",),
    f"""SELECT origem, CAST(row_number() OVER (PARTITION BY origem ORDER BY whole DESC, first) AS INTEGER) AS place, responsavel, registrations, contacts, whole AS rate
        FROM (SELECT *, floor((registrations * 200 + contacts) / (contacts * 2e0)) AS whole FROM ({_lead_groups("origem", "responsavel")})) QUALIFY place <= 3""",
)
def _a14(t: Tables) -> DataFrame:
    return scorecard.podium_by_origin(t.leads)


@_query(
    "a15_filter_domains",
    ("partner_flat", "leads"),
    """SELECT 'initiative' AS field, hub_delivey_initiatives AS value FROM partner_flat WHERE hub_delivey_initiatives <> ''
       UNION SELECT 'station', delivery_station FROM partner_flat WHERE delivery_station <> ''
       UNION SELECT 'owner', responsavel FROM leads UNION SELECT 'origin', origem FROM leads""",
)
def _a15(t: Tables) -> DataFrame:
    return scorecard.filter_domains(t.plain_partners, t.leads)


_CUMULATIVE = """SELECT day_ordinal, data_contato, CAST(row_number() OVER (ORDER BY day_ordinal) AS INTEGER) AS position,
  CAST(sum(contatos) OVER (ORDER BY day_ordinal) AS DOUBLE) AS contacts_cum, CAST(sum(cadastros) OVER (ORDER BY day_ordinal) AS DOUBLE) AS registrations_cum FROM daily"""
_MEANS = "SELECT avg(contatos) AS contacts_mean, avg(cadastros) AS registrations_mean FROM (SELECT * FROM daily ORDER BY day_ordinal DESC LIMIT 20)"
_LEFT = (AS_OF.replace(month=AS_OF.month + 1, day=1) - AS_OF).days - 1
_PROJECTED = f"""SELECT CAST(n + i AS INTEGER) AS position, concat('Proj+', CAST(i AS VARCHAR)) AS label, c + i * contacts_mean AS contacts_cum, r + i * registrations_mean AS registrations_cum
  FROM (SELECT count(*) AS n, sum(contatos) AS c, sum(cadastros) AS r FROM daily), ({_MEANS}), (SELECT unnest(range(1, {_LEFT + 1})) AS i)"""


@_query("w3_cumulative_series", ("leads", "daily"), f"SELECT position, contacts_cum, registrations_cum FROM ({_CUMULATIVE})")
def _w3(t: Tables) -> DataFrame:
    return scorecard.cumulative_series(t.daily).select("position", "contacts_cum", "registrations_cum")


@_query("w4_trailing_mean_20", ("leads", "daily"), _MEANS)
def _w4(t: Tables) -> DataFrame:
    return scorecard.trailing_mean(t.daily)


@_query("w5_projected_series", ("leads", "daily"), _PROJECTED)
def _w5(t: Tables) -> DataFrame:
    return scorecard.projected_series(t.daily, AS_OF)


_TARGETS = "CAST(position * 580 AS BIGINT) AS contacts_target, CAST(position * 11 AS BIGINT) AS registrations_target"


@_query("w6_cumulative_targets", ("leads", "daily"), f"SELECT position, {_TARGETS} FROM ({_CUMULATIVE})")
def _w6(t: Tables) -> DataFrame:
    return scorecard.cumulative_targets(scorecard.cumulative_series(t.daily)).select("position", "contacts_target", "registrations_target")


@_query(
    "w7_temporal_chart",
    ("leads", "daily"),
    f"""SELECT *, {_TARGETS} FROM (
          SELECT position, CAST(data_contato AS VARCHAR) AS label, FALSE AS is_projection, contacts_cum, registrations_cum FROM ({_CUMULATIVE})
          UNION ALL SELECT position, label, TRUE, contacts_cum, registrations_cum FROM ({_PROJECTED}))""",
)
def _w7(t: Tables) -> DataFrame:
    return scorecard.temporal_chart(t.daily, AS_OF)


@_query(
    "r3_lead_detail",
    ("leads",),
    "SELECT "
    + ", ".join(
        f"""coalesce(CAST({c} AS VARCHAR), 'N/A') AS "{c.replace("_", " ").upper()}" """
        for c in ("lead_ordinal", "responsavel", "origem", "data_contato", "data_cadastro", "data_conversao")
    )
    + " FROM leads WHERE responsavel = 'P3'",
)
def _r3(t: Tables) -> DataFrame:
    return scorecard.lead_detail(filters.filter_leads(t.leads, "P3"))


# --- sources ---------------------------------------------------------------
# The tables are written as the documents that the readers expect, with some odd values among them.


@_query(
    "s1_load_partners",
    ("partner_flat", "overlap_flat"),
    """SELECT row_number() OVER (ORDER BY fk) - 1 AS partner_ordinal, store_id, status, lat, ADV, ead,
         CASE WHEN fk % 13 > 0 THEN eligible_packages END AS eligible_packages, overlapping_count, coalesce(n, 0) AS overlaps, first_overlap
       FROM partner_flat LEFT JOIN (
         SELECT main, CAST(count(*) AS INTEGER) AS n, concat('ST', CAST(arg_min(other, k) AS VARCHAR)) AS first_overlap FROM overlap_flat GROUP BY main) o ON main = fk""",
)
def _s1(t: Tables) -> DataFrame:
    text = lambda c: F.when(F.col("partner_ordinal") % 13 > 0, F.col(c).cast("string")).otherwise("n/a")
    rows = t.partners.withColumns({"eligible_packages": text("eligible_packages"), "overlapping_count": F.col("overlapping_count").cast("string")})
    element = F.struct(*(c for c in rows.columns if c != "partner_ordinal"))
    read = documents.load_partners(t.spark, as_documents(rows, "allMarkerData", element, "partner_ordinal", 500))
    return read.select(
        "partner_ordinal", "store_id", "status", "lat", "ADV", F.col("main_store_data.ead").alias("ead"), "eligible_packages", "overlapping_count",
        F.size("overlap_data").alias("overlaps"), F.get("overlap_data", F.lit(0))["store_id"].alias("first_overlap"),
    )


_SHAPE = """CAST(len(flatten(geom)) AS INTEGER) AS rings, CAST(list_sum(list_transform(flatten(geom), lambda r: len(r))) AS BIGINT) AS corners"""


def _shape(read: DataFrame, *columns: str) -> DataFrame:
    rings = F.flatten("geom")
    corners = F.aggregate(rings, F.lit(0).cast("long"), lambda n, r: n + F.size(r))
    return read.select("polygon_ordinal", *columns, F.size(rings).alias("rings"), corners.alias("corners"))


def _features(rows: DataFrame, kind: str, coordinates: str, *properties: str) -> str:
    geometry = F.struct(F.lit(kind).alias("type"), F.expr(coordinates).alias("coordinates"))
    return as_documents(rows, "features", F.struct(F.struct(*properties).alias("properties"), geometry.alias("geometry")), "polygon_ordinal", 50)


@_query(
    "s2_load_regions",
    ("regions",),
    f"SELECT row_number() OVER (ORDER BY polygon_ordinal) - 1 AS polygon_ordinal, cluster, delivery_station, num_points, cor, {_SHAPE} FROM regions",
)
def _s2(t: Tables) -> DataFrame:
    columns = ("cluster", "delivery_station", "num_points", "cor")
    return _shape(documents.load_regions(t.spark, _features(t.regions, "MultiPolygon", "geom", *columns)), *columns)


@_query(
    "s3_load_jurisdictions",
    ("jurisdictions",),
    f"SELECT row_number() OVER (ORDER BY polygon_ordinal) - 1 AS polygon_ordinal, delivery_station, cor, {_SHAPE} FROM jurisdictions",
)
def _s3(t: Tables) -> DataFrame:
    columns = ("delivery_station", "cor")
    return _shape(documents.load_jurisdictions(t.spark, _features(t.jurisdictions, "Polygon", "geom[0]", *columns)), *columns)


_NULLS = "CAST(NULL AS VARCHAR)"
_WRITTEN_DAY = "CASE WHEN day_ordinal % 2 = 0 THEN strftime(data_contato, '%d/%m') ELSE CAST(data_contato AS VARCHAR) END"


def _odd(column: str) -> str:
    return f"CASE WHEN lead_ordinal % 3 = 0 THEN strftime({column}, '%d/%m/%Y') ELSE CAST({column} AS VARCHAR) END"


@_query(
    "s4_load_scorecard",
    ("leads", "daily", "owner_scores", "totals"),
    f"""SELECT 'lead' AS part, row_number() OVER (ORDER BY lead_ordinal) - 1 AS ordinal, responsavel AS name, origem AS a, CAST(data_contato AS VARCHAR) AS b,
          CASE WHEN lead_ordinal % 3 > 0 THEN CAST(data_cadastro AS VARCHAR) END AS c, CAST(data_cadastro IS NOT NULL AS DOUBLE) AS x, CAST(data_conversao IS NOT NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS z FROM leads
        UNION ALL SELECT 'owner', row_number() OVER (ORDER BY responsavel) - 1, responsavel, {_NULLS}, {_NULLS}, {_NULLS}, contatos, conversoes, score_final FROM owner_scores
        UNION ALL SELECT 'day', day_ordinal - 1, {_WRITTEN_DAY}, {_NULLS}, CASE WHEN day_ordinal % 2 > 0 THEN CAST(data_contato AS VARCHAR) END, {_NULLS}, contatos, cadastros, NULL FROM daily
        UNION ALL SELECT 'goal', NULL, 'contatos', {_NULLS}, {_NULLS}, {_NULLS}, contacts, contacts_goal, contacts * 100 / contacts_goal FROM totals
        UNION ALL SELECT 'goal', NULL, 'cadastros', {_NULLS}, {_NULLS}, {_NULLS}, registrations, registrations_goal, registrations * 100 / registrations_goal FROM totals
        UNION ALL SELECT 'period', NULL, concat(CAST(min(data_contato) AS VARCHAR), ' - ', CAST(max(data_contato) AS VARCHAR)), CAST(min(data_contato) AS VARCHAR), CAST(max(data_contato) AS VARCHAR), {_NULLS}, NULL, NULL, NULL FROM leads""",
)
def _s4(t: Tables) -> DataFrame:
    read = documents.load_scorecard(t.spark, t.scorecard_documents())
    names = {"ordinal": "long", "name": "string", "a": "string", "b": "string", "c": "string", "x": "double", "y": "double", "z": "double"}

    def rows(part: str, table: DataFrame, **columns: Column) -> DataFrame:
        return table.select(F.lit(part).alias("part"), *(columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names.items()))

    col, goals = F.col, read["goals_attained"]
    out = rows("lead", read["leads"], ordinal=col("lead_ordinal"), name=col("responsavel"), a=col("origem"), b=col("data_contato"), c=col("data_cadastro"), x=col("data_cadastro_given"), y=col("data_conversao_given"))
    out = out.unionByName(rows("owner", read["owner_scores"], ordinal=col("owner_ordinal"), name=col("responsavel"), x=col("contatos"), y=col("conversoes"), z=col("score_final")))
    out = out.unionByName(rows("day", read["daily"], ordinal=col("day_ordinal"), name=col("label"), b=col("data_contato"), x=col("contatos"), y=col("cadastros")))
    for g in ("contatos", "cadastros"):
        out = out.unionByName(rows("goal", goals, name=F.lit(g), x=col(f"{g}.atingido"), y=col(f"{g}.meta"), z=col(f"{g}.percentual")))
    return out.unionByName(rows("period", read["period"], name=col("label"), a=col("start_date"), b=col("end_date")))


@_query(
    "r3_detail_as_written",
    ("leads",),
    f"""SELECT responsavel AS "RESPONSAVEL", origem AS "ORIGEM", CAST(data_contato AS VARCHAR) AS "DATA CONTATO", coalesce({_odd("data_cadastro")}, '') AS "DATA CADASTRO",
          coalesce({_odd("data_conversao")}, ['N/A', '0', 'false', ''][lead_ordinal % 4 + 1]) AS "DATA CONVERSAO", concat('}}{{ "', CAST(lead_ordinal % 10 AS VARCHAR), '"') AS "NOTA"
        FROM leads WHERE responsavel = 'P3'""",
)
def _r3_as_written(t: Tables) -> DataFrame:
    read = documents.load_scorecard(t.spark, t.scorecard_documents())
    return scorecard.lead_detail(filters.filter_leads(read["leads"], "P3"))


@_query("a11_best_origin_as_written", ("leads",), f"SELECT origem, contacts, registrations, conversions, rate FROM ({_lead_groups('origem')}) WHERE rate > 0 ORDER BY rate DESC, first LIMIT 1")
def _a11_as_written(t: Tables) -> DataFrame:
    return scorecard.best_origin(documents.load_scorecard(t.spark, t.scorecard_documents())["leads"])


@_query(
    "w7_chart_as_written",
    ("leads", "daily"),
    f"""SELECT *, {_TARGETS} FROM (
          SELECT position, {_WRITTEN_DAY} AS label, FALSE AS is_projection, contacts_cum, registrations_cum FROM ({_CUMULATIVE})
          UNION ALL SELECT position, label, TRUE, contacts_cum, registrations_cum FROM ({_PROJECTED}))""",
)
def _w7_as_written(t: Tables) -> DataFrame:
    return scorecard.temporal_chart(documents.load_scorecard(t.spark, t.scorecard_documents())["daily"], AS_OF)


def _region_folder(t: Tables) -> DataFrame:
    """The regions, in file order, out of a folder of documents."""
    return documents.load_regions(t.spark, _features(t.regions, "MultiPolygon", "geom", "cluster", "delivery_station", "num_points", "cor"))


def _partner_folder(t: Tables) -> DataFrame:
    rows = t.partners
    return documents.load_partners(t.spark, as_documents(rows, "allMarkerData", F.struct(*(c for c in rows.columns if c != "partner_ordinal")), "partner_ordinal", 500))


@_query("a1_summary_of_folder", _GEO, _A1, _ALL)
def _a1_of_folder(t: Tables) -> DataFrame:
    regions = _region_folder(t)
    return partners.region_summary(filters.filter_regions(regions, STATIONS), regions, spatial.associate_regions(t.plain_partners, regions))


@_query("w1_priority_of_folder", _GEO, _PRIORITY, _LOCATED)
def _w1_of_folder(t: Tables) -> DataFrame:
    regions = _region_folder(t)
    return partners.region_priority(regions, spatial.associate_regions(t.plain_partners, regions))


@_query("f10_lookup_in_folder", ("partner_flat",), _LOOKUP)
def _f10_in_folder(t: Tables) -> DataFrame:
    read = _partner_folder(t)
    return filters.lookup_partner(read, filters.filter_partners(read, stations=STATIONS), _terms(t))


@_query(
    "s5_load_period",
    ("leads",),
    """SELECT CAST(min(data_contato) AS VARCHAR) AS start_date, CAST(max(data_contato) AS VARCHAR) AS end_date,
         concat(CAST(min(data_contato) AS VARCHAR), ' - ', CAST(max(data_contato) AS VARCHAR)) AS label FROM leads""",
)
def _s5(t: Tables) -> DataFrame:
    row = documents.load_period(t.spark, t.period_document())
    return row.select(F.col("start_date").cast("string"), F.col("end_date").cast("string"), "label")


@_query(
    "s6_reference_tables",
    ("partner_flat", "station_cost"),
    """SELECT p.delivery_station, count(*) AS partners, coalesce(max(cost), 0) AS cost, (SELECT count(*) FROM (VALUES ('active'), ('adv_mean'), ('ead'), ('dea'), ('dcr'), ('fdds'), ('ftds'))) AS goals
       FROM partner_flat p LEFT JOIN station_cost c ON c.delivery_station = p.delivery_station WHERE p.delivery_station IS NOT NULL GROUP BY p.delivery_station""",
)
def _s6(t: Tables) -> DataFrame:
    tables = K.reference_tables(t.spark)
    goals = tables["goals"].where("board = 'performance'").agg(F.count(F.lit(1)).alias("goals"))  # one row
    costs = tables["station_cost"].select(F.col("delivery_station").alias("_s"), "cost")
    known = t.plain_partners.where("delivery_station is not null").groupBy("delivery_station").agg(F.count(F.lit(1)).alias("partners"))
    joined = known.join(costs, F.col("delivery_station") == F.col("_s"), "left")
    return joined.select("delivery_station", "partners", F.coalesce("cost", F.lit(0.0)).alias("cost")).crossJoin(goals)


_PARTNER_METRICS = ("radius", "total_packages_allocated", "ADV", "partner_capacity", "eligible_packages", "working_days", "capped_days", "overlapping_count")


@_query(
    "s6_reference_values",
    ("partner_flat", "leads", "owner_scores", "totals"),
    f"""SELECT * FROM (WITH scores AS (SELECT CASE WHEN score_final * 100 >= 80 THEN 'green' WHEN score_final * 100 >= 60 THEN 'gold' ELSE 'red' END AS band, count(*) AS n FROM owner_scores GROUP BY 1),
        steps AS (SELECT CASE WHEN percent >= 100 THEN 'success' WHEN percent >= 70 THEN 'warning' ELSE 'danger' END AS band, count(*) AS n FROM ({_PROGRESS}) GROUP BY 1),
        stations AS (SELECT (row_number() OVER (ORDER BY v) - 1) % 9 AS place FROM (SELECT DISTINCT coalesce(nullif(delivery_station, ''), 'N/A') AS v FROM partner_flat)),
        people AS (SELECT count(*) AS n, {", ".join(f"count({m}) AS {m}" for m in _PARTNER_METRICS)} FROM partner_flat)
        SELECT 'score' AS kind, v.band AS name, CAST(start AS DOUBLE) AS value, coalesce(n, 0) AS uses FROM (VALUES ('green', 80), ('gold', 60), ('red', 0)) v(band, start) LEFT JOIN scores USING (band)
        UNION ALL SELECT 'progress', v.band, start, coalesce(n, 0) FROM (VALUES ('success', 100), ('warning', 70), ('danger', 0)) v(band, start) LEFT JOIN steps USING (band)
        UNION ALL SELECT 'palette', color, v.place, (SELECT count(*) FROM stations WHERE stations.place = v.place)
          FROM (VALUES (0, '#e41a1c'), (1, '#377eb8'), (2, '#4daf4a'), (3, '#984ea3'), (4, '#ff7f00'), (5, '#ffff33'), (6, '#a65628'), (7, '#f781bf'), (8, '#999999')) v(place, color)
        {" ".join(f"UNION ALL SELECT 'metric', '{m}', {int(m not in ('capped_days', 'overlapping_count'))}, {m} FROM people" for m in _PARTNER_METRICS)}
        UNION ALL SELECT 'goal', name, goal, n FROM people, (VALUES
          ('performance active', 600), ('performance adv_mean', 40), ('performance ead', 98.5), ('performance dea', 98.5), ('performance dcr', 96), ('performance fdds', 97), ('performance ftds', 98.5),
          ('expansion expected', 0), ('expansion active', 85), ('expansion onboarding', 25), ('expansion attainment_pct', 80),
          ('routes spr_mean', 480), ('routes cpp_mean', 2.5), ('routes pickups_per_host', 4)) v(name, goal))""",
)
def _s6_values(t: Tables) -> DataFrame:
    """Every constant with how many rows of the tables it is used for."""
    tables = K.reference_tables(t.spark)
    row = lambda df, kind, name, value, uses: df.select(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"), F.coalesce(uses, F.lit(0)).cast("long").alias("uses"))
    col = F.col
    out = []
    banded_rows = {
        "score": scorecard.owner_cards(t.owner_scores, t.leads).select("band"),
        "progress": scorecard.goal_progress(t.goals_attained).select("band"),
    }
    for scale, rows in banded_rows.items():
        own = tables["bands"].where(col("scale") == scale).join(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "band", "left")
        out.append(row(own, scale, col("band"), col("from_value"), col("n")))
    legend, _ = partners.category_encoding(t.plain_partners, "delivery_station")
    out.append(row(tables["palette"].join(legend.groupBy("color").agg(F.count(F.lit(1)).alias("n")), "color", "left"), "palette", col("color"), col("place"), col("n")))
    counts = t.plain_partners.agg(F.count(F.lit(1)).alias("n"), *(F.count(f"main_store_data.{m}").alias(m) for m in K.METRICS))  # one row
    known = counts.select("n", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), col(m).alias("known")) for m in K.METRICS))).alias("m")).select("n", "m.*")
    out.append(row(tables["metrics"].join(known, "metric"), "metric", col("metric"), col("higher_is_better").cast("int"), col("known")))
    out.append(row(tables["goals"].crossJoin(counts.select("n")), "goal", F.concat_ws(" ", "board", "metric"), col("goal"), col("n")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
