"""The package's input tables, derived from the driver's tables.

Each mapping is one SQL text in the dialect that Spark and DuckDB share, so a
query and its oracle read the same rows. ``ARRAY_OF`` stands for the function
that makes an array, which the two spell differently.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.constants import STATION_COST
from ..storage import new_folder

AS_OF = date(2024, 1, 20)

_STATION = """CASE {0} WHEN 0 THEN 'DSP2' WHEN 1 THEN 'DSP3' WHEN 2 THEN 'DSP4' WHEN 3 THEN 'DSP5' WHEN 4 THEN 'DBH5'
  WHEN 5 THEN 'DRJ3' WHEN 6 THEN 'DGO2' WHEN 7 THEN 'DBS5' WHEN 24 THEN NULL ELSE concat('DXX', CAST({0} AS VARCHAR(10))) END"""


def _rate(shift: int) -> str:
    return f"CASE WHEN (fk + {shift}) % 17 = 0 THEN NULL ELSE CAST(90 + (fk + {shift}) % 11 AS DOUBLE) / 100 END"


_METRICS = ("radius", "total_packages_allocated", "ADV", "partner_capacity", "eligible_packages", "working_days", "capped_days", "overlapping_count")

#: Name -> (tables it reads, SQL). Later ones may read earlier ones.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "partner_flat": (
        ("customer", "orders", "lineitem"),
        f"""
WITH days AS (SELECT o_custkey AS dk, count(DISTINCT CAST(o_orderdate AS DATE)) AS working_days FROM orders GROUP BY o_custkey),
sums AS (
  SELECT o_custkey AS sk, sum(l_quantity) AS dispatched, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS delivered
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
base AS (SELECT c_custkey AS fk, c_name, c_nationkey, c_acctbal FROM customer)
SELECT fk, fk AS partner_ordinal, concat('ST', CAST(fk AS VARCHAR(20))) AS store_id, c_name AS name,
  CAST(fk * 53 % 77 AS DOUBLE) / 2 - 33 AS lat, CAST(fk * 37 % 71 AS DOUBLE) / 2 - 70 AS lon,
  CAST(500 + (fk % 20) * 250 AS DOUBLE) AS radius,
  CASE WHEN fk % 10 <= 5 THEN 'Active' WHEN fk % 10 = 6 THEN 'Onboarding' WHEN fk % 10 = 7 THEN 'BG Checks' WHEN fk % 10 = 8 THEN 'Inactive' END AS status,
  {_STATION.format("c_nationkey")} AS delivery_station,
  CASE fk % 6 WHEN 0 THEN 'HCP Host Partner' WHEN 1 THEN 'HCP Pick Up Partner' WHEN 2 THEN 'HCP Pick Up Partner' WHEN 3 THEN 'Other' WHEN 4 THEN '' END AS hub_delivey_initiatives,
  CASE fk % 3 WHEN 0 THEN 'Exclusive' WHEN 1 THEN 'Shared' END AS jurisdiction_type,
  CASE WHEN fk % 11 = 0 THEN NULL WHEN fk % 13 = 0 THEN '' ELSE concat('SR', CAST(fk % 40 AS VARCHAR(10))) END AS supply_run,
  CASE WHEN fk % 7 < 4 THEN 'Tier 1' ELSE 'Tier 2' END AS HCP_rate_card,
  CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS DOUBLE) END AS ADV,
  CAST(fk * 7 % 500 AS DOUBLE) AS eligible_packages, CAST(fk % 6 AS DOUBLE) AS overlapping_count,
  CAST(NULL AS VARCHAR(10)) AS popup, CAST(NULL AS VARCHAR(10)) AS regiao,
  CAST(dispatched AS DOUBLE) AS dispatched_packages, CAST(delivered AS DOUBLE) AS delivered_packages, CAST(working_days AS DOUBLE) AS working_days,
  CAST(dispatched AS DOUBLE) AS total_packages_allocated, CAST(50 + fk % 60 AS DOUBLE) AS partner_capacity, CAST(fk % 5 AS DOUBLE) AS capped_days,
  {_rate(1)} AS ead, {_rate(2)} AS dea, {_rate(0)} AS dcr, {_rate(3)} AS fdds, {_rate(4)} AS ftds
FROM base LEFT JOIN sums ON sk = fk LEFT JOIN days ON dk = fk""",
    ),
    "regions": (
        ("nation",),
        f"""
WITH r AS (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7),
o AS (SELECT CAST(n_nationkey AS BIGINT) * 8 + r AS o, n_nationkey AS nk FROM nation CROSS JOIN r),
c AS (SELECT o, nk, CAST(o % 20 AS DOUBLE) * 2 - 70 AS x, CAST(floor(o / 20) AS DOUBLE) * 4 - 33 AS y FROM o)
SELECT o AS polygon_ordinal, concat('R', CAST(CASE WHEN o % 25 = 24 THEN o - 1 ELSE o END AS VARCHAR(10))) AS cluster,
  {_STATION.format("nk")} AS delivery_station,
  CASE WHEN o % 9 = 0 THEN CAST(0 AS DOUBLE) WHEN o % 10 = 0 THEN NULL ELSE CAST(o % 14 + 1 AS DOUBLE) END AS num_points,
  CASE WHEN o % 4 = 0 THEN '#112233' WHEN o % 4 = 1 THEN '' END AS cor,
  CASE o % 3
    WHEN 1 THEN ARRAY_OF(ARRAY_OF(ARRAY_OF(ARRAY_OF(x, y), ARRAY_OF(x + 2.5e0, y), ARRAY_OF(x, y + 4), ARRAY_OF(x, y))))
    WHEN 0 THEN ARRAY_OF(ARRAY_OF(ARRAY_OF(ARRAY_OF(x, y), ARRAY_OF(x + 2.5e0, y), ARRAY_OF(x + 2.5e0, y + 4.5e0), ARRAY_OF(x, y + 4.5e0), ARRAY_OF(x, y))))
    ELSE ARRAY_OF(ARRAY_OF(
      ARRAY_OF(ARRAY_OF(x, y), ARRAY_OF(x + 2.5e0, y), ARRAY_OF(x + 2.5e0, y + 4.5e0), ARRAY_OF(x, y + 4.5e0), ARRAY_OF(x, y)),
      ARRAY_OF(ARRAY_OF(x + 0.5e0, y + 1), ARRAY_OF(x + 1.5e0, y + 1), ARRAY_OF(x + 1.5e0, y + 3), ARRAY_OF(x + 0.5e0, y + 3), ARRAY_OF(x + 0.5e0, y + 1)))) END AS geom
FROM c""",
    ),
    "jurisdictions": (
        ("nation",),
        f"""
WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS o, CAST(n_nationkey AS DOUBLE) * 2 - 70 AS x FROM nation)
SELECT o AS polygon_ordinal, {_STATION.format("o")} AS delivery_station, CASE WHEN o % 2 = 0 THEN '#445566' END AS cor,
  ARRAY_OF(ARRAY_OF(ARRAY_OF(ARRAY_OF(x, CAST(-33 AS DOUBLE)), ARRAY_OF(x + 2, CAST(-33 AS DOUBLE)), ARRAY_OF(x + 2, CAST(5 AS DOUBLE)), ARRAY_OF(x, CAST(5 AS DOUBLE)), ARRAY_OF(x, CAST(-33 AS DOUBLE))))) AS geom
FROM c""",
    ),
    "leads": (
        ("events",),
        """
SELECT event_id AS lead_ordinal, concat('P', CAST(user_id % 12 AS VARCHAR(10))) AS responsavel, event_type AS origem,
  CAST(ts AS DATE) AS data_contato,
  CASE WHEN event_type <> 'error' AND value > 100 THEN CAST(ts AS DATE) END AS data_cadastro,
  CASE WHEN event_type <> 'error' AND value > 200 THEN CAST(ts AS DATE) END AS data_conversao
FROM events""",
    ),
    "daily": (
        ("leads",),
        """
WITH d AS (SELECT data_contato, count(*) AS contatos, count(data_cadastro) AS cadastros FROM leads GROUP BY data_contato)
SELECT CAST(row_number() OVER (ORDER BY data_contato) AS BIGINT) AS day_ordinal, data_contato, contatos, cadastros FROM d""",
    ),
    "owner_scores": (
        ("leads",),
        """
SELECT responsavel, least(CAST(1 AS DOUBLE), CAST(6 * count(data_cadastro) AS DOUBLE) / count(*)) AS score_final,
  count(*) AS contatos, count(data_cadastro) AS cadastros, count(data_conversao) AS conversoes
FROM leads GROUP BY responsavel""",
    ),
    "totals": (
        ("leads",),
        """
SELECT CAST(count(*) AS DOUBLE) AS contacts, CAST(count(data_cadastro) AS DOUBLE) AS registrations,
  CAST(580 * 30 AS DOUBLE) AS contacts_goal, CAST(11 * 30 AS DOUBLE) AS registrations_goal
FROM leads""",
    ),
    "station_cost": (
        (),
        " UNION ALL ".join(f"SELECT '{s}' AS delivery_station, CAST({c} AS DOUBLE) AS cost" for s, c in STATION_COST.items()),
    ),
    "overlap_flat": (
        ("partner_flat", "numbers"),
        f"""
WITH size AS (SELECT count(*) AS n FROM partner_flat),
near AS (SELECT fk AS main, k, (fk + 7 * k) % n AS other FROM partner_flat CROSS JOIN size JOIN numbers ON k <= fk % 7)
SELECT main, k, other, {", ".join(f"p.{m} AS {m}" for m in _METRICS)}
FROM near LEFT JOIN partner_flat p ON p.fk = other""",
    ),
    "numbers": ((), " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k" for k in range(1, 7))),
}


def _with_parts(name: str, seen: dict[str, str]) -> None:
    reads, sql = SQL[name]
    for other in reads:
        if other in SQL and other not in seen:
            _with_parts(other, seen)
    seen[name] = sql


def duckdb_sql(names: tuple[str, ...], body: str, extra: dict[str, str] | None = None) -> str:
    """A DuckDB query over mapped tables, which become its first common table expressions."""
    parts: dict[str, str] = {}
    for name in names:
        _with_parts(name, parts)
    parts = {k: v.replace("ARRAY_OF", "list_value") for k, v in parts.items()} | (extra or {})
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + body


def _saved(documents: DataFrame) -> str:
    """Write (name, text) as a document each, in the order of their names; return the folder."""
    folder = new_folder(documents.sparkSession, "documents")
    documents.select(F.col("text"), F.lpad(F.col("name").cast("string"), 12, "0").alias("document")).write.partitionBy("document").text(folder)
    return folder


def _in_documents(rows: DataFrame, key: str, element: Column, order: str, size: int) -> DataFrame:
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), element.alias("e")))), lambda x: x["e"])
    documents = rows.groupBy(F.floor(F.col(order) / size).alias("name")).agg(own.alias(key))
    return documents.select("name", F.to_json(F.struct(key), {"ignoreNullFields": "false"}).alias("text"))


def as_documents(rows: DataFrame, key: str, element: Column, order: str, size: int) -> str:
    """Write elements as JSON documents of at most ``size`` of them in ``order``, a file each; return their folder."""
    return _saved(_in_documents(rows, key, element, order, size))


class Tables:
    """The mapped tables of one directory as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self._dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in SQL:
                reads, sql = SQL[name]
                sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(reads) or 'none'})\b", r"\1 {\2}", sql)
                sql = sql.replace("ARRAY_OF", "array")
                self._made[name] = self.spark.sql(sql, **{r: getattr(self, r) for r in reads})
            else:
                self._made[name] = self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]

    @property
    def plain_partners(self) -> DataFrame:
        """Partners with their nested figures; overlaps are only put together where a query asks for them."""
        nested = (*_METRICS, "dispatched_packages", "delivered_packages", "ead", "dea", "dcr", "fdds", "ftds")
        top = (
            "partner_ordinal store_id name lat lon radius status delivery_station hub_delivey_initiatives jurisdiction_type supply_run "
            "HCP_rate_card ADV eligible_packages overlapping_count popup regiao"
        ).split()
        return self.partner_flat.select(*top, F.struct(*nested).alias("main_store_data"))

    @property
    def partners(self) -> DataFrame:
        """Partners with the list of their overlapping partners."""
        one = F.struct(F.col("k").alias("overlap_id"), F.concat(F.lit("ST"), F.col("other")).alias("store_id"), *_METRICS)
        lists = self.overlap_flat.groupBy(F.col("main").alias("_main")).agg(F.array_sort(F.collect_list(one)).alias("overlap_data"))
        return self.plain_partners.join(lists, F.col("partner_ordinal") == F.col("_main"), "left").drop("_main")

    @property
    def goals_attained(self) -> DataFrame:
        goal = lambda c: F.struct(
            F.col(c).alias("atingido"), F.col(f"{c}_goal").alias("meta"), (F.col(c) * 100 / F.col(f"{c}_goal")).alias("percentual")
        )
        whole = F.col("registrations") / F.greatest("contacts", F.lit(1.0))
        return self.totals.select(goal("contacts").alias("contatos"), goal("registrations").alias("cadastros"), F.least(F.lit(1.0), whole * 6).alias("scorecard_geral"))

    @property
    def period(self) -> DataFrame:
        """First and last day of the contacts."""
        return self.leads.agg(F.min("data_contato").alias("start_date"), F.max("data_contato").alias("end_date"))

    def period_document(self) -> str:
        """The folder of a document with that period."""
        period = F.struct(F.col("start_date").alias("start"), F.col("end_date").alias("end"))
        return _saved(self.period.select(F.lit(0).alias("name"), F.to_json(F.struct(period.alias("period"))).alias("text")))

    def scorecard_documents(self) -> str:
        """The folder of the scorecard's documents: leads by 2,000, and one with all else.

        A third of the dates is written by day, month and year; what is missing
        is nothing, an empty text, 0 or false; leads have one more key.
        """
        at = F.col("lead_ordinal")
        odd = lambda c: F.when(at % 3 == 0, F.date_format(c, "dd/MM/yyyy")).otherwise(F.col(c).cast("string"))
        element = F.concat(
            F.substring_index(F.to_json(F.struct("responsavel", "origem", "data_contato", F.coalesce(odd("data_cadastro"), F.lit("")).alias("data_cadastro"))), "}", 1),
            F.lit(',"data_conversao":'),
            F.coalesce(F.concat(F.lit('"'), odd("data_conversao"), F.lit('"')), F.element_at(F.array(F.lit("null"), F.lit("0"), F.lit("false"), F.lit('""')), (at % 4 + 1).cast("int"))),
            F.concat(F.lit(',"nota":"}{ \\"'), at % 10, F.lit('\\""}')),
        )
        texts = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), element.alias("e")))), lambda x: x["e"])
        leads = self.leads.groupBy(F.floor(at / 2000).alias("name")).agg(F.concat(F.lit('{"summary": [\n'), F.array_join(texts, ",\n"), F.lit("\n]}")).alias("text"))
        listed = lambda df, key, order: df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*df.columns).alias("e")))).alias(key)).select(F.transform(key, lambda x: x["e"]).alias(key))
        day = F.when(F.col("day_ordinal") % 2 == 0, F.date_format("data_contato", "dd/MM")).otherwise(F.col("data_contato").cast("string"))
        days = listed(self.daily.withColumn("data_contato", day), "daily_data", "day_ordinal")
        period = F.struct("start_date", "end_date").alias("period_info")
        rest = self.goals_attained.select(F.struct("*").alias("atingimento_metas_gerais")).crossJoin(listed(self.owner_scores, "per_responsavel", "responsavel"))
        rest = rest.crossJoin(days).crossJoin(self.period.select(period))  # one row each
        return _saved(leads.unionByName(rest.select(F.lit(10**9).alias("name"), F.to_json(F.struct("*")).alias("text"))))
