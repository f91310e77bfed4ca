import math
import random

import pytest

from waypost.operators import spatial

REGION = "polygon_ordinal long, cluster string, geom array<array<array<array<double>>>>"
POINT = "partner_ordinal long, lon double, lat double, regiao string"


def square(x, y, size, hole=None):
    ring = lambda a, b, s: [[a, b], [a + s, b], [a + s, b + s], [a, b + s], [a, b]]
    return [[ring(x, y, size)] + ([ring(*hole)] if hole else [])]


def located(spark, regions, points, **more):
    r, p = spark.createDataFrame(regions, REGION), spark.createDataFrame(points, POINT)
    return {x.partner_ordinal: (x.regiao, x.matched) for x in spatial.associate_regions(p, r, **more).collect()}


def test_rules(spark):
    regions = [(0, "A", square(0.0, 0.0, 4.0, (1.0, 1.0, 2.0))), (1, "B", square(3.0, 3.0, 4.0)), (2, "", square(20.0, 20.0, 2.0))]
    points = [
        (0, 0.5, 0.5, None),  # inside A
        (1, 2.0, 2.0, None),  # in A's hole
        (2, 3.5, 3.5, None),  # in both
        (3, 0.0, 2.0, None),  # on A's edge
        (4, 1.0, 1.5, None),  # on the edge of A's hole
        (5, 7.0, 7.0, None),  # B's corner
        (6, 50.0, 50.0, "kept"),
        (7, None, 1.0, None),
        (8, float("nan"), 1.0, ""),
        (9, 21.0, 21.0, "gone"),  # a region without a name
    ]
    for size in (0.7, 2.0, 50.0):
        assert located(spark, regions, points, cell_size=size) == {
            0: ("A", True), 1: ("Fora das Regiões", False), 2: ("A", True), 3: ("A", True), 4: ("A", True), 5: ("B", True),
            6: ("kept", False), 7: ("Fora das Regiões", False), 8: ("Fora das Regiões", False), 9: ("Fora das Regiões", True),
        }


def test_cells_equal_brute_force(spark):
    rng = random.Random(3)
    regions = [(i, f"R{i}", square(rng.randint(0, 30) / 2, rng.randint(0, 30) / 2, rng.randint(1, 8) / 2)) for i in range(40)]
    points = [(i, rng.randint(-2, 40) / 2, rng.randint(-2, 40) / 2, None) for i in range(300)]

    def first(x, y):
        for _, name, geom in regions:
            (x0, y0), (x1, y1) = geom[0][0][0], geom[0][0][2]
            if x0 <= x <= x1 and y0 <= y <= y1:
                return name
        return "Fora das Regiões"

    expected = {i: first(x, y) for i, x, y, _ in points}
    assert {k: v[0] for k, v in located(spark, regions, points, cell_size=1.3).items()} == expected


def test_extent(spark):
    df = spark.createDataFrame([(0.0, 10.0), (10.0, 30.0), (None, 99.0)], "lat double, lon double")
    row = spatial.extent(df).collect()[0]
    assert (row.min_lat, row.max_lat, row.min_lon, row.max_lon) == pytest.approx((-1, 11, 8, 32))
    assert spatial.extent(df.where("lat > 99")).count() == 0


def test_no_regions(spark):
    assert located(spark, [], [(0, 1.0, 1.0, None)]) == {0: ("Fora das Regiões", False)}


def test_odd_shapes_equal_ray_counting(spark):
    """Stars and combs over many cells: a cell's own edges decide as all edges do."""
    rng = random.Random(8)
    rings = []
    for i in range(12):
        cx, cy = rng.uniform(-5, 25), rng.uniform(-5, 25)
        ring = [[cx + r * math.cos(a * math.pi / 15), cy + r * math.sin(a * math.pi / 15)] for a in range(30) for r in [rng.uniform(1, 9)]]
        rings.append((i, f"R{i}", [*ring, ring[0]]))
    points = [(i, rng.uniform(-15, 35), rng.uniform(-15, 35), None) for i in range(400)]

    def inside(ring, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    expected = {i: next((n for _, n, ring in rings if inside(ring, x, y)), "Fora das Regiões") for i, x, y, _ in points}
    assert len(set(expected.values())) > 5
    for size in (0.7, 3.0):
        got = located(spark, [(i, n, [[ring]]) for i, n, ring in rings], points, cell_size=size)
        assert {k: v[0] for k, v in got.items()} == expected
