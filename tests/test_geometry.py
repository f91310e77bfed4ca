"""Exact edges and cells that split, against rational numbers and against testing all regions."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from waypost.functions import geometry
from waypost.operators import spatial

REGION = "polygon_ordinal long, cluster string, geom array<array<array<array<double>>>>"
POINT = "partner_ordinal long, lon double, lat double, regiao string"


def sign(ax, ay, bx, by, px, py):
    ax, ay, bx, by, px, py = map(Fraction, (ax, ay, bx, by, px, py))
    det = (bx - ax) * (py - ay) - (px - ax) * (by - ay)
    return (det > 0) - (det < 0)


def on_a_line(rng):
    """Two ends and a point that lies exactly on their line or next to it, in doubles that take all 53 bits."""
    ax, ay, dx, dy = (rng.randint(-(2**44), 2**44) for _ in range(4))
    k = rng.choice([1, 2, 3])
    a, b, p = (ax, ay), (ax + 4 * dx, ay + 4 * dy), (ax + k * dx, ay + k * dy)
    (ax, ay), (bx, by), (px, py) = (tuple(math.ldexp(v, -38) for v in q) for q in (a, b, p))
    moved = rng.randint(0, 3)
    if moved == 1:
        px = math.nextafter(px, math.inf)
    elif moved == 2:
        py = math.nextafter(py, -math.inf)
    return ax, ay, bx, by, px, py


def test_orientation_has_the_exact_sign(spark):
    rng = random.Random(1)
    rows = [on_a_line(rng) for _ in range(400)] + [tuple(rng.uniform(-180, 180) for _ in range(6)) for _ in range(200)]
    rows += [(-46.63, -23.55, -46.61, -23.53, -46.62, -23.54), (0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (0.1, 0.1, 0.7, 0.7, 0.3, 0.3), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, px double, py double")
    got = df.select("*", geometry.orientation(*map(F.col, df.columns)).alias("d")).collect()
    assert all(((r.d > 0) - (r.d < 0)) == sign(*r[:6]) for r in got)
    assert {sign(*r) for r in rows} == {-1, 0, 1}
    naive = [(r[2] - r[0]) * (r[5] - r[1]) - (r[4] - r[0]) * (r[3] - r[1]) for r in rows]
    assert any(((d > 0) - (d < 0)) != sign(*r) for d, r in zip(naive, rows, strict=True))  # doubles alone are wrong on some


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
        s = sign(ax, ay, bx, by, x, y)
        if s == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        odd ^= ((ay > y) != (by > y)) and ((s > 0) == (by > ay))
    return odd


def test_points_on_slanted_edges(spark):
    rng = random.Random(2)
    regions, points = [], []
    for k in range(40):
        ax, ay, bx, by, px, py = (v / 1000 for v in on_a_line(rng))
        ring = [[ax, ay], [bx, by], [ax + 40.0, by - 31.7], [ax, ay]]
        regions.append((k, f"R{k}", [[ring]]))
        points += [(3 * k, px, py, None), (3 * k + 1, math.nextafter(px, 999), py, None), (3 * k + 2, (ax + bx) / 2, (ay + by) / 2, None)]
    got = spatial.associate_regions(spark.createDataFrame(points, POINT), spark.createDataFrame(regions, REGION)).collect()
    want = {i: next((n for _, n, ((ring,),) in regions if inside(ring, x, y)), "Fora das Regiões") for i, x, y, _ in points}
    assert {r.partner_ordinal: r.regiao for r in got} == want


def test_small_regions_of_one_city(spark):
    """2,000 regions in one degree share a cell of level 0; cells split until few edges are left in each."""
    rng = random.Random(4)
    regions = []
    for k in range(2000):
        x, y, s = rng.uniform(10.1, 11.0), rng.uniform(20.1, 21.0), rng.uniform(0.002, 0.02)
        regions.append((k, f"R{k}", [[[[x, y], [x + s, y + s / 3], [x + s / 2, y + s], [x, y]]]]))
    regions.append((2000, "wide", [[[[-20.0, -20.0], [50.0, -20.0], [50.0, 20.5], [-20.0, 20.4], [-20.0, -20.0]]]]))
    spread = [(i, rng.uniform(10.0, 11.1), rng.uniform(20.0, 21.1), None) for i in range(1500)]
    points = spread + [(1500 + i, rng.uniform(-30, 60), rng.uniform(-30, 60), None) for i in range(200)] + [(1700, None, 1.0, None)]
    areas = spark.createDataFrame(regions, REGION)
    cells, depths = spatial.cell_index(areas, 2.0)
    sizes = cells.select("level", F.aggregate("shapes", F.lit(0), lambda n, s: n + F.size(s["edges"])).alias("n")).collect()
    assert max(r.n or 0 for r in sizes) <= spatial.MOST_EDGES and max(r.level for r in sizes) >= 3
    assert depths.count() == 1
    got = spatial.associate_regions(spark.createDataFrame(points, POINT), areas).collect()
    want = {i: "Fora das Regiões" for i, *_ in points}
    boxes = [(n, ring, min(p[0] for p in ring), max(p[0] for p in ring), min(p[1] for p in ring), max(p[1] for p in ring)) for _, n, ((ring,),) in regions]
    for i, x, y, _ in points:
        if x is not None:
            want[i] = next((n for n, ring, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1 and inside(ring, x, y)), want[i])
    assert {r.partner_ordinal: r.regiao for r in got} == want and len(got) == len(points) and len(set(want.values())) > 100


def test_every_split_equals_no_split(spark):
    rng = random.Random(6)
    ring = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]
    regions = [(k, f"R{k}", [[ring(rng.randint(-9, 9) / 2, rng.randint(-9, 9) / 2, rng.randint(1, 6) / 2, rng.randint(1, 6) / 2)]]) for k in range(30)]
    points = [(i, rng.randint(-12, 18) / 2, rng.randint(-12, 18) / 2, None) for i in range(300)] + [(300, float("nan"), 0.0, None)]
    areas, places = spark.createDataFrame(regions, REGION), spark.createDataFrame(points, POINT)
    of = lambda **more: {(r.partner_ordinal, r.regiao, r.matched) for r in spatial.associate_regions(places, areas, **more).collect()}
    whole = of(most_edges=10**9)
    assert len(whole) == 301
    for most, size in ((4, 2.0), (12, 1.3), (30, 50.0)):
        assert of(most_edges=most, cell_size=size) == whole
