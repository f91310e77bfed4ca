import json
from datetime import date

from waypost.sources import documents
from waypost.sources.constants import reference_tables


def save(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(json.dumps(value, indent=1, ensure_ascii=False))
    return f"file://{path}"


def test_partners(spark, tmp_path):
    rows = [
        {"store_id": "B", "eligible_packages": "12", "overlapping_count": 3, "main_store_data": {"ADV": 1, "ead": 0.5}, "overlap_data": [{"overlap_id": 1, "store_id": "A", "radius": 2}]},
        {"store_id": "A", "eligible_packages": "x", "lat": 1.5, "lon": -2},
    ]
    got = documents.load_partners(spark, save(tmp_path, "p.json", {"allMarkerData": rows})).orderBy("partner_ordinal").collect()
    assert [r.store_id for r in got] == ["B", "A"]
    assert (got[0].eligible_packages, got[0].overlapping_count, got[0].main_store_data.ead) == (12.0, 3.0, 0.5)
    assert (got[1].eligible_packages, got[1].overlap_data, got[1].lat) == (None, [], 1.5)
    assert got[0].overlap_data[0].radius == 2.0


def test_geometries(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [
        {"properties": {"cluster": "A", "delivery_station": "S", "num_points": 3, "cor": "#1"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"cluster": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
    ]
    path = save(tmp_path, "r.geojson", {"type": "FeatureCollection", "features": features})
    got = documents.load_regions(spark, path).orderBy("polygon_ordinal").collect()
    assert [(r.cluster, r.num_points, len(r.geom)) for r in got] == [("A", 3.0, 1), ("B", None, 2)]
    assert got[0].geom[0][0][1] == [1.0, 0.0]
    assert documents.load_jurisdictions(spark, path).columns == ["polygon_ordinal", "delivery_station", "cor", "geom"]


def test_scorecard(spark, tmp_path):
    lead = {"responsavel": "p", "origem": "o", "data_cadastro": "2024-01-02"}
    path = save(tmp_path, "s.json", {"summary": [lead], "atingimento_metas_gerais": {"contatos": {"atingido": 5}}, "period_info": {"start_date": "2024-01-01"}})
    got = documents.load_scorecard(spark, path)
    assert got["leads"].collect()[0].data_cadastro == date(2024, 1, 2)
    assert got["daily"].count() == 0 and got["owner_scores"].count() == 0
    assert got["goals_attained"].collect()[0].contatos.atingido == 5.0
    assert got["period"].collect()[0].label == "unspecified"


def test_odd_values(spark, tmp_path):
    """Dates and numbers that are none become null; the rest of the document is read."""
    leads = [{"responsavel": "p", "data_cadastro": "", "data_contato": "2024-01-05T10:00:00"}, {"responsavel": 7, "data_cadastro": "x"}, {"data_conversao": None, "data_cadastro": "2024-02-30"}]
    scores = [{"responsavel": "p", "score_final": "0.5", "contatos": "12"}, {"score_final": "n/a", "contatos": "many"}]
    path = save(tmp_path, "s.json", {"summary": leads, "per_responsavel": scores, "daily_data": [{"data_contato": "?", "contatos": 3}]})
    got = documents.load_scorecard(spark, path)
    rows = got["leads"].orderBy("lead_ordinal").collect()
    assert [r.data_cadastro for r in rows] == [None, None, None] and rows[0].data_contato == date(2024, 1, 5) and rows[1].responsavel == "7"
    assert [(r.score_final, r.contatos) for r in got["owner_scores"].orderBy("owner_ordinal").collect()] == [(0.5, 12), (None, None)]
    assert [(r.data_contato, r.contatos) for r in got["daily"].collect()] == [(None, 3)]
    partners = [{"store_id": "A", "lat": "1.5", "ADV": "x", "main_store_data": {"ead": "0.5", "dea": ""}, "overlap_data": [{"overlap_id": "1", "radius": "far"}]}]
    row = documents.load_partners(spark, save(tmp_path, "p.json", {"allMarkerData": partners})).collect()[0]
    assert (row.lat, row.ADV, row.main_store_data.ead, row.main_store_data.dea) == (1.5, None, 0.5, None)
    assert (row.overlap_data[0].overlap_id, row.overlap_data[0].radius) == (1, None)


def test_period(spark, tmp_path):
    path = save(tmp_path, "p.json", {"period": {"start": "2024-01-01", "end": "2024-01-30"}})
    row = documents.load_period(spark, path).collect()[0]
    assert (row.start_date, row.end_date, row.label) == (date(2024, 1, 1), date(2024, 1, 30), "2024-01-01 - 2024-01-30")


def test_reference_tables(spark):
    got = {k: v.count() for k, v in reference_tables(spark).items()}
    assert got == {"station_cost": 15, "goals": 14, "bands": 6, "metrics": 8, "palette": 9}
