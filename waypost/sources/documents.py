"""Readers of the published JSON and GeoJSON documents.

A path may be a document or a folder of them. Documents are read by blocks and
their elements numbered in file order over all documents (``elements``), so an
ordinal is unique, and a folder gives what one document with the same elements
would. The elements are kept as a table below the shared folder; partners and
areas, which most queries read several times, as typed rows, so that their JSON is
parsed once and a query reads the columns that it uses.

Plain values are read as text and turned into dates and numbers where they are.
Leads and daily rows also keep what was written: whether a date was given at all
does not depend on its form, and a table of leads shows every key that they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..storage import written
from .elements import read_elements


def _texts(kind: T.DataType) -> T.DataType:
    """The same shape with text in place of all plain values."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _texts(f.dataType)) for f in kind])
    return T.ArrayType(_texts(kind.elementType)) if isinstance(kind, T.ArrayType) else T.StringType()


def _typed(column: Column, kind: T.DataType) -> Column:
    """Texts as what they should be; a value that is none of its kind is null."""
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_typed(column[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _typed(x, kind.elementType))
    return column if isinstance(kind, T.StringType) else column.try_cast(kind)


def _struct(fields: str) -> str:
    """A field list as the inside of a STRUCT type."""
    out, depth = [], 0
    for part in fields.split(","):
        out.append(part if depth else part.strip().replace(" ", ":", 1))
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def _elements(found: DataFrame, key: str, fields: str, ordinal: str) -> DataFrame:
    """The objects under a key with their fields, ``ordinal``, and their own text ``as_written``.

    Odd dates and numbers become null; only broken JSON is an error.
    """
    kind = T.StructType.fromDDL(fields)
    parsed = F.from_json("text", _texts(kind), {"mode": "FAILFAST"}).alias("_e")
    rows = found.where(F.col("key") == key).select(F.col("ordinal").alias(ordinal), parsed, F.col("text").alias("as_written"))
    return rows.select(ordinal, *(_typed(F.col(f"_e.{f.name}"), f.dataType).alias(f.name) for f in kind), "as_written")


def load_partners(spark: SparkSession, path: str) -> DataFrame:
    """Partners in file order; numbers that arrive as text become numbers, a missing overlap list is empty."""
    rows = _elements(read_elements(spark, path), "allMarkerData", schemas.PARTNER, "partner_ordinal").drop("as_written")
    return written(rows.withColumn("overlap_data", F.coalesce("overlap_data", F.array().cast(schemas.OVERLAPS))), "partners")


def _geometry() -> Column:
    """Coordinates of a Polygon or MultiPolygon as those of a MultiPolygon."""
    many = F.from_json("geometry.coordinates", schemas.GEOMETRY)
    one = F.array(F.from_json("geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>"))
    return F.when(F.col("geometry.type") == "MultiPolygon", many).otherwise(one)


def _features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    feature = f"properties STRUCT<{properties}>, geometry STRUCT<type:STRING,coordinates:STRING>"
    rows = _elements(read_elements(spark, path), "features", feature, "polygon_ordinal")
    return written(rows.select("polygon_ordinal", "properties.*", _geometry().alias("geom")), "features")


def load_regions(spark: SparkSession, path: str) -> DataFrame:
    return _features(spark, path, "cluster:STRING,delivery_station:STRING,num_points:DOUBLE,cor:STRING")


def load_jurisdictions(spark: SparkSession, path: str) -> DataFrame:
    return _features(spark, path, "delivery_station:STRING,cor:STRING")


def load_period(spark: SparkSession, path: str, key: str = "period") -> DataFrame:
    """A row per document: start_date, end_date and a label, ``unspecified`` if either is missing."""
    return _period(read_elements(spark, path), key)


def _period(found: DataFrame, key: str) -> DataFrame:
    row = _elements(found, key, "start STRING, end STRING, start_date STRING, end_date STRING", "_document")
    day = lambda a, b: F.try_to_timestamp(F.coalesce(F.col(a), F.col(b))).cast("date")
    return period_label(row.select(day("start", "start_date").alias("start_date"), day("end", "end_date").alias("end_date")))


def period_label(period: DataFrame) -> DataFrame:
    missing = F.col("start_date").isNull() | F.col("end_date").isNull()
    label = F.concat_ws(" - ", F.col("start_date").cast("string"), F.col("end_date").cast("string"))
    return period.withColumn("label", F.when(missing, "unspecified").otherwise(label))


def given(row: Column, key: str) -> Column:
    """Whether a JSON object holds something under a key: neither nothing, an empty text, 0 nor false."""
    value = F.try_variant_get(F.try_parse_json(row), f"$.{key}", "variant")
    kind, text = F.schema_of_variant(value), value.try_cast("string")
    number = F.coalesce(text.try_cast("double") != 0, F.lit(True))
    truth = F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(kind == "VOID", False)
    return F.coalesce(truth.when(kind.rlike("^(OBJECT|ARRAY)"), True).otherwise(number), F.lit(False))


def load_scorecard(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The document's tables: leads, owner_scores, daily, goals_attained, period; missing ones are empty.

    Leads have ``data_cadastro_given`` and ``data_conversao_given``, which tell
    whether anything was written there, whether or not it is a date, and their
    whole text ``as_written``. Daily rows have their day as written, ``label``.
    """
    found = read_elements(spark, path)
    leads = _elements(found, "summary", schemas.LEAD, "lead_ordinal")
    daily = _elements(found, "daily_data", schemas.DAILY, "day_ordinal")
    day = F.try_variant_get(F.try_parse_json("as_written"), "$.data_contato", "string")
    return {
        "leads": leads.withColumns({f"{c}_given": given(F.col("as_written"), c) for c in ("data_cadastro", "data_conversao")}),
        "owner_scores": _elements(found, "per_responsavel", schemas.OWNER_SCORE, "owner_ordinal").drop("as_written"),
        "daily": daily.withColumn("label", day).drop("as_written"),
        "goals_attained": _elements(found, "atingimento_metas_gerais", schemas.GOALS, "_document").drop("_document", "as_written"),
        "period": _period(found, "period_info"),
    }
