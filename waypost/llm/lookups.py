"""Looking up a value by a key that many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import fresh

#: A key is hot from this share of all rows on; so at most as many keys are.
HOT_SHARE = 1000


def look_up(rows: DataFrame, counts: DataFrame, total: int, on: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined to ``counts``, which has a row per key with its values and ``uses``, how many rows bear it.

    Keys borne by a thousandth of ``total`` rows or more are at most 1,000, so
    they are broadcast; any other is too rare to fill a task. ``how`` is inner
    or left. Keys are compared by equality, null finds nothing. The columns of
    the result are those of ``rows`` and the values; ``rows`` is read twice.
    """
    (mark,) = fresh([*rows.columns, *counts.columns], "_hot")
    hot = counts.where(F.col("uses") * HOT_SHARE >= total).drop("uses")
    rest = counts.where(F.col("uses") * HOT_SHARE < total).drop("uses")
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), on, "left")
    found = marked.where(mark).drop(mark)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return found.unionByName(cold)
