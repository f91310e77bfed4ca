"""Explicit schemas of all inputs; nothing is inferred."""

from __future__ import annotations

METRICS = (
    "radius DOUBLE, total_packages_allocated DOUBLE, ADV DOUBLE, partner_capacity DOUBLE, "
    "eligible_packages DOUBLE, working_days DOUBLE, capped_days DOUBLE, overlapping_count DOUBLE"
)
_METRIC_FIELDS = METRICS.replace(" DOUBLE", ":DOUBLE")

MAIN_STORE = (
    f"STRUCT<{_METRIC_FIELDS}, dispatched_packages:DOUBLE, delivered_packages:DOUBLE, "
    "ead:DOUBLE, dea:DOUBLE, dcr:DOUBLE, fdds:DOUBLE, ftds:DOUBLE>"
)
OVERLAPS = f"ARRAY<STRUCT<overlap_id:BIGINT, store_id:STRING, {_METRIC_FIELDS}>>"

PARTNER = (
    "store_id STRING, name STRING, lat DOUBLE, lon DOUBLE, radius DOUBLE, status STRING, delivery_station STRING, "
    "hub_delivey_initiatives STRING, jurisdiction_type STRING, supply_run STRING, HCP_rate_card STRING, ADV DOUBLE, "
    "eligible_packages DOUBLE, overlapping_count DOUBLE, popup STRING, regiao STRING, "
    f"main_store_data {MAIN_STORE}, overlap_data {OVERLAPS}"
)
GEOMETRY = "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
LEAD = "responsavel STRING, origem STRING, data_contato DATE, data_cadastro DATE, data_conversao DATE"
OWNER_SCORE = "responsavel STRING, score_final DOUBLE, contatos BIGINT, cadastros BIGINT, conversoes BIGINT"
DAILY = "data_contato DATE, contatos BIGINT, cadastros BIGINT"
_GOAL = "STRUCT<atingido:DOUBLE, meta:DOUBLE, percentual:DOUBLE>"
GOALS = f"contatos {_GOAL}, cadastros {_GOAL}, scorecard_geral DOUBLE"
