"""Assigning points to polygons by a join on cells that fit the polygons, and bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.columns import truthy
from ..sources.constants import OUTSIDE
from ..storage import drop, written

#: A cell with more candidate edges is split in four, but not more than so many times.
MOST_EDGES, DEEPEST = 128, 14


def _cell(value: str | Column, size: float) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.floor(c / F.lit(float(size)))


def _candidates(shapes: DataFrame, size: float) -> DataFrame:
    """``shapes`` in cells (cell_x, cell_y) of a size with the edges that matter there, if any do.

    A test counts the edges to the right of a point, so a cell needs those at its
    height that reach its left side or lie beyond, not all of a region's.
    """
    left, low, slack = F.col("cell_x") * size, F.col("cell_y") * size, size * 1e-6  # of rounding to cells

    def matters(e: Column) -> Column:
        at_height = (F.least(e["ay"], e["by"]) <= low + size + slack) & (F.greatest(e["ay"], e["by"]) >= low - slack)
        return at_height & (F.greatest(e["ax"], e["bx"]) >= left - slack)

    return shapes.withColumn("edges", F.filter("edges", matters)).where(F.size("edges") > 0)


def _halved(cells: DataFrame) -> DataFrame:
    """The four quarters of each cell."""
    quarters = F.array(*(F.struct((F.col("cell_x") * 2 + i).alias("x"), (F.col("cell_y") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)))
    rest = [c for c in cells.columns if c not in ("cell_x", "cell_y")]
    return cells.select(*rest, F.explode(quarters).alias("_q")).select(*rest, F.col("_q.x").alias("cell_x"), F.col("_q.y").alias("cell_y"))


def _gathered(rows: DataFrame) -> DataFrame:
    shape = F.struct("polygon_ordinal", "cluster", "box", "edges")
    return rows.groupBy("cell_x", "cell_y").agg(F.array_sort(F.collect_list(shape)).alias("shapes"))


def cell_index(regions: DataFrame, cell_size: float, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame | None]:
    """Cells (level, cell_x, cell_y) with their candidate regions ``shapes``, in file order, and how deep cells are split.

    A quadtree: a cell holds the regions whose bounding box meets it, and is
    split while they have more than ``most_edges`` edges that matter there. A row
    per cell keeps the join with points one to one. The second table has the
    deepest ``level`` below each split cell of level 0, null if none is split;
    where it is split, a point's cell is a leaf of one of the levels up to there,
    so leaves without regions are rows too, and the split cell is none.
    """
    shapes = regions.select("polygon_ordinal", "cluster", geometry.edges("geom").alias("edges")).where(F.size("edges") > 0)
    shapes = shapes.withColumn("box", geometry.bounds(F.col("edges")))
    rows = shapes.withColumn("cell_x", F.explode(F.sequence(_cell("box.x0", cell_size), _cell("box.x1", cell_size))))
    rows = rows.withColumn("cell_y", F.explode(F.sequence(_cell("box.y0", cell_size), _cell("box.y1", cell_size))))
    rows = _candidates(rows, cell_size)
    key = ["cell_x", "cell_y"]
    leaves, splits, kept, tree = [], [], [], None  # ``tree``: all cells of the level, with or without regions
    for level in range(DEEPEST + 1):
        full = rows.groupBy(*key).agg(F.sum(F.size("edges")).alias("n")).where(F.col("n") > most_edges).drop("n")
        last = level == DEEPEST or full.isEmpty()
        here = _gathered(rows if last else rows.join(full, key, "left_anti"))
        if tree is not None:
            here = (tree if last else tree.join(full, key, "left_anti")).join(here, key, "left")
        leaves.append(here.select(F.lit(level).alias("level"), *key, "shapes"))
        if last:
            break
        full = written(full, "split-cells")
        size = cell_size / 2 ** (level + 1)
        splits.append(full.select(*(F.floor(F.col(c) / 2**level).alias(c) for c in key), F.lit(level + 1).alias("deepest")))
        tree = _halved(full)
        met = F.col("cell_x").between(_cell("box.x0", size), _cell("box.x1", size)) & F.col("cell_y").between(_cell("box.y0", size), _cell("box.y1", size))
        rows = written(_candidates(_halved(rows.join(full, key)).where(met), size), "cells")
        kept += [full, rows]
    whole = leaves[0]
    for more in leaves[1:]:
        whole = whole.unionByName(more)
    if not splits:
        return whole, None
    depths = splits[0]
    for more in splits[1:]:
        depths = depths.unionByName(more)
    whole, depths = written(whole, "cells"), written(depths.groupBy(*key).agg(F.max("deepest").alias("deepest")), "depths")
    drop(*kept)
    return whole, depths


def associate_regions(partners: DataFrame, regions: DataFrame, cell_size: float = 2.0, outside: str = OUTSIDE, most_edges: int = MOST_EDGES) -> DataFrame:
    """``partners`` with ``regiao`` set to the first region that contains them, and ``matched``.

    Edges count as inside, exactly. Without a match a name that was there before
    stays. Missing coordinates match nothing. A point looks up its cell of level
    0, and one cell of each further level where that is split.
    """
    lon, lat = F.col("lon"), F.col("lat")
    cells, depths = cell_index(regions, cell_size, most_edges)
    cells = cells.select(F.col("level").alias("_l"), F.col("cell_x").alias("_x"), F.col("cell_y").alias("_y"), "shapes")
    known = partners.withColumns({"_px": F.when(~F.isnan("lon"), _cell("lon", cell_size)), "_py": F.when(~F.isnan("lat"), _cell("lat", cell_size))})
    same = (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y"))
    if depths is None:
        met = known.join(cells, same, "left")
    else:
        depths = depths.select(F.col("cell_x").alias("_dx"), F.col("cell_y").alias("_dy"), "deepest")
        known = known.join(depths, (F.col("_px") == F.col("_dx")) & (F.col("_py") == F.col("_dy")), "left")
        known = known.withColumn("_level", F.explode(F.when(F.col("deepest").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("deepest")))))
        times = F.pow(F.lit(2.0), F.col("_level"))
        known = known.withColumns({"_px": F.when(~F.isnan("lon"), F.floor(lon / F.lit(cell_size) * times)), "_py": F.when(~F.isnan("lat"), F.floor(lat / F.lit(cell_size) * times))})
        met = known.join(cells, same & (F.col("_level") == F.col("_l")), "left").where(F.col("deepest").isNull() | F.col("_l").isNotNull())
    hits = F.filter("shapes", lambda s: geometry.in_bounds(s["box"], lon, lat) & geometry.contains(s["edges"], lon, lat))
    met = met.withColumn("_hit", F.get(hits, 0))
    matched = F.col("_hit").isNotNull()
    region = F.when(matched, F.col("_hit.cluster")).otherwise(F.col("regiao"))
    named = F.when(truthy(region), region).otherwise(F.lit(outside))
    columns = [named.alias("regiao") if c == "regiao" else F.col(c) for c in partners.columns]
    return met.select(*columns, matched.alias("matched"))


def association_counts(partners: DataFrame) -> DataFrame:
    return partners.agg(F.count_if("matched").alias("matched"), F.count(F.lit(1)).alias("total"))


def extent(df: DataFrame, pad: float = 0.1) -> DataFrame:
    """Bounding box of the points, widened on each side by a share of its size; no row without points."""
    points = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    box = points.agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))))
    out = []
    for c in ("lat", "lon"):
        by = (F.col(f"max_{c}") - F.col(f"min_{c}")) * pad
        out += [(F.col(f"min_{c}") - by).alias(f"min_{c}"), (F.col(f"max_{c}") + by).alias(f"max_{c}")]
    return box.where("min_lat is not null").select(*out)
