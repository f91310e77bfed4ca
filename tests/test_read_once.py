import json

from pyspark.sql import functions as F

from waypost.operators import filters
from waypost.sources import documents


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_json_is_parsed_once(spark, tmp_path):
    """Partners and areas are typed rows when they are read, whichever queries follow."""
    (tmp_path / "p.json").write_text(json.dumps({"allMarkerData": [{"store_id": "A", "ADV": "2"}, {"store_id": "B"}]}))
    read = documents.load_partners(spark, f"file://{tmp_path}/p.json")
    assert "from_json" not in plan_of(read) and [(r.partner_ordinal, r.store_id, r.ADV, r.overlap_data) for r in read.orderBy("partner_ordinal").collect()] == [(0, "A", 2.0, []), (1, "B", None, [])]
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "r.json").write_text(json.dumps({"features": [{"properties": {"cluster": "R"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    read = documents.load_regions(spark, f"file://{tmp_path}/r.json")
    assert "from_json" not in plan_of(read) and [(r.cluster, r.geom) for r in read.collect()] == [("R", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]])]


def test_grams_of_texts_are_not_broadcast(spark, tmp_path):
    """A table that looks small, as Parquet does, has many grams; terms are the side that goes to all tasks."""
    path = f"file://{tmp_path}/partners"
    spark.range(5000).select(F.col("id").alias("partner_ordinal"), F.concat(F.lit("ST"), "id").alias("store_id"), F.concat(F.lit("name "), "id").alias("name")).write.parquet(path)
    terms = spark.range(5).select(F.col("id").alias("term_id"), F.concat(F.lit("e 1"), "id").alias("term"))
    found = filters.autocomplete_partners(spark.read.parquet(path), terms)
    assert "BuildLeft" not in plan_of(found) and "BuildRight" in plan_of(found)
    assert {(r.term_id, r.place, r.name) for r in found.collect() if r.place < 3} == {(k, 1, f"name 1{k}") for k in range(5)} | {(k, 2, f"name 1{k}0") for k in range(5)}
