"""Filters, highlighting and searches. Every operator takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_number, chosen, truthy, within
from ..sources.constants import JURISDICTION_COLOR, REGION_COLOR
from .search import contain


def filter_partners(
    partners: DataFrame, status: str = "all", stations: Iterable[str] = ("all",), initiative: str = "all", jurisdiction: str = "all"
) -> DataFrame:
    return partners.where(
        chosen("status", status)
        & within("delivery_station", stations)
        & chosen("hub_delivey_initiatives", initiative)
        & chosen("jurisdiction_type", jurisdiction)
    )


def _colored(areas: DataFrame, stations: Iterable[str], default: str) -> DataFrame:
    color = F.when(truthy("cor"), F.col("cor")).otherwise(default)
    return areas.where(within("delivery_station", stations)).withColumn("color", color)


def filter_regions(regions: DataFrame, stations: Iterable[str] = ("all",)) -> DataFrame:
    return _colored(regions, stations, REGION_COLOR)


def filter_jurisdictions(jurisdictions: DataFrame, stations: Iterable[str] = ("all",)) -> DataFrame:
    return _colored(jurisdictions, stations, JURISDICTION_COLOR)


def _compared(value: Column, op: str, threshold: float) -> Column:
    return value > threshold if op == "gt" else value < threshold


def highlight_partners(
    partners: DataFrame,
    eligible: tuple[str, float] = ("gt", 0),
    allocated: tuple[str, float] = ("gt", 0),
    overlapping: tuple[str, float] = ("gt", 0),
    status: str = "all",
) -> DataFrame:
    """Partners that meet all active criteria.

    A threshold of 0 or less switches a criterion off, except the count of
    overlaps ``eq`` a number, which holds within a thousandth.
    """
    number = lambda c: F.coalesce(as_number(c), F.lit(0.0))
    test = chosen("status", status)
    for column, (op, threshold) in (("eligible_packages", eligible), ("ADV", allocated)):
        if threshold > 0:
            test &= _compared(number(column), op, threshold)
    op, threshold = overlapping
    if op == "eq":
        test &= F.abs(number("overlapping_count") - threshold) < 0.001
    elif threshold > 0:
        test &= _compared(number("overlapping_count"), op, threshold)
    return partners.where(test)


def filter_leads(leads: DataFrame, owner: str = "all", origin: str = "all") -> DataFrame:
    return leads.where(chosen("responsavel", owner) & chosen("origem", origin))


def filter_owner_scores(owner_scores: DataFrame, owner: str = "all") -> DataFrame:
    return owner_scores.where(chosen("responsavel", owner))


def row_text(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """All cells of a row as one text, without separators; a missing cell reads N/A."""
    return F.concat(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("N/A")) for c in columns or df.columns))


def search_rows(df: DataFrame, text: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows whose cells, joined, contain ``text`` in any case."""
    return df.where(F.contains(F.lower(row_text(df, columns)), F.lit(text.lower()))) if text else df


def autocomplete_partners(partners: DataFrame, terms: DataFrame, most: int = 5) -> DataFrame:
    """The first partners in file order whose name or id contains a term of two characters or more.

    ``terms`` (term_id, term) are typed texts; they meet partners by character
    grams (``search``). The rank limit is taken before the shuffle, so a frequent
    term moves few rows.
    """
    typed = terms.where(F.length("term") >= 2).select("term_id", F.lower("term").alias("_term"))
    known = partners.select("partner_ordinal", "store_id", "name")
    found = contain(known, [F.lower("name"), F.lower("store_id")], typed, 2)
    by_term = Window.partitionBy("term_id").orderBy("partner_ordinal")
    placed = found.withColumn("place", F.row_number().over(by_term)).where(F.col("place") <= most)
    label = F.concat(F.col("name"), F.lit(" ("), F.col("store_id"), F.lit(")"))
    return placed.select("term_id", "place", "store_id", "name", label.alias("label"))


def lookup_partner(partners: DataFrame, visible: DataFrame, terms: DataFrame) -> DataFrame:
    """For each term the first partner whose id it is or whose name contains it, and whether it is visible.

    Ids are met by equality, names by character grams; the first of both is the partner.
    """
    typed = terms.where(truthy("term")).select("term_id", F.lower("term").alias("_term"))
    known = partners.select("partner_ordinal", "store_id", "name", "lat", "lon")
    first = F.min(F.struct("partner_ordinal", "store_id", "name", "lat", "lon")).alias("p")
    by_id = known.withColumn("_term", F.lower("store_id")).join(typed, "_term")
    by_name = contain(known, [F.lower("name")], typed)
    found = by_id.unionByName(by_name).groupBy("term_id").agg(first).select(F.col("term_id").alias("_id"), "p.*")
    seen = visible.select(F.col("store_id").alias("_seen")).distinct().withColumn("_shown", F.lit(True))
    found = found.join(seen, F.col("store_id").eqNullSafe(F.col("_seen")), "left")  # by id: what is shown need not come from the same reading
    outcome = F.when(F.col("partner_ordinal").isNull(), "not_found").when(F.col("_shown").isNull(), "filtered_out").otherwise("found")
    asked = terms.where(truthy("term")).select("term_id")
    return asked.join(found, F.col("term_id") == F.col("_id"), "left").select("term_id", "store_id", "name", "lat", "lon", outcome.alias("outcome"))
