"""Connected components of an edge table, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import drop, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a long, b long) -> (node, component), component = smallest node.

    Every round each node points at one of its neighbours or itself, pointers
    are followed once more, and the edges are contracted along them. Rounds
    alternate between the smallest neighbour, which folds stars at once, and
    the neighbour of smallest hash, which shrinks chains by a constant factor.
    Rows with a null end and loops are ignored.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = written(edges.distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select("b", "a"))
        if k % 2 == 0:
            point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
            point = point.select("node", F.least("node", "to").alias("to"))
        else:
            key = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
            point = both.groupBy(F.col("a").alias("node")).agg(F.min(key("b")).alias("to"))
            point = point.select("node", F.least(key("node"), F.col("to"))["v"].alias("to"))
        point = written(point, "point")
        onward = point.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jump = written(point.join(onward, "to").select("node", F.col("further").alias("to")), "jump")
        moved = labels.join(jump.withColumnRenamed("node", "label"), "label", "left")
        moved = written(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = edges.join(jump.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(jump.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = written(left, "edges")
        drop(edges, point, jump, labels)
        edges, labels = left, moved
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
