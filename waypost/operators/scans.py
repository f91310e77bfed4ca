"""Running aggregates and places that no single task has to work out.

A window over a long series, or over a group that holds much of a table, is one
task. Here rows are dealt to range partitions of (key, order), so that a long
series lies in many of them, one after the other. Each partition is aggregated
by itself, these few figures are carried onward from partition to partition,
and every row gets what stands before its partition and a window within it.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from itertools import accumulate as running

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: The column that numbers a row's range partition; later rows of a key never have a smaller number.
PART = "_part"
#: Kind of aggregate -> over rows, of two figures as columns, of two figures.
_KINDS = {
    "sum": (F.sum, operator.add, operator.add),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), operator.xor),
    "max": (F.max, F.greatest, max),
}
Aggregates = dict[str, tuple[str, Column]]


def ranged(df: DataFrame, by: Iterable[str], order: Iterable[Column | str]) -> DataFrame:
    """``df`` written in range partitions of (by, order), with ``_part``.

    Rows that agree in all of these would have to share a partition, so a
    number of their own comes last; their order among themselves is any.
    """
    numbered = df.withColumn("_own", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*by, *order, "_own").withColumn(PART, F.spark_partition_id())
    return written(dealt.drop("_own"), "ranged")


def accumulate(rows: DataFrame, by: Iterable[str], order: Iterable[Column | str], aggregates: Aggregates) -> DataFrame:
    """``rows``, which have ``_part``, with running aggregates in order, a row's own value included.

    ``aggregates`` maps a new column to ``sum``, ``xor`` or ``max`` and what it runs over,
    which must not be null. Without ``by`` a figure for each partition passes
    through the driver; these are as many as there are tasks, whatever the rows.
    """
    by, names = list(by), list(aggregates)
    pieces = rows.groupBy(*by, PART).agg(*(_KINDS[kind][0](c).alias(n) for n, (kind, c) in aggregates.items()))
    keys = {k: f"_of_{k}" for k in (*by, PART)}
    if by:  # a row for each key and partition that has some of it
        earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        ahead = [_KINDS[kind][0](n).over(earlier).alias(f"_ahead_{n}") for n, (kind, _) in aggregates.items()]
        before = pieces.select(*(F.col(k).alias(v) for k, v in keys.items()), *ahead)
    else:
        figures = sorted(map(tuple, pieces.select(PART, *names).collect()))
        shifted = [running([f[1 + i] for f in figures[:-1]], _KINDS[aggregates[n][0]][2]) for i, n in enumerate(names)]
        schema = ", ".join([f"{keys[PART]} int", *(f"_ahead_{n} {pieces.schema[n].dataType.simpleString()}" for n in names)])
        before = rows.sparkSession.createDataFrame([(f[0], *a) for f, a in zip(figures[1:], zip(*shifted, strict=True), strict=True)], schema)
    upto = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumns({n: _KINDS[kind][0](c).over(upto) for n, (kind, c) in aggregates.items()})
    met = here.join(before, [F.col(k).eqNullSafe(F.col(v)) for k, v in keys.items()], "left")
    both = {n: F.coalesce(_KINDS[kind][1](F.col(f"_ahead_{n}"), F.col(n)), F.col(n)) for n, (kind, _) in aggregates.items()}
    return met.withColumns(both).select(*here.columns)


def placed(df: DataFrame, by: Iterable[str], order: Iterable[Column | str], place: str = "place") -> DataFrame:
    """``df`` with each row's place (long, from 1) in its group; a group may span many tasks."""
    by, order = list(by), list(order)
    return accumulate(ranged(df, by, order), by, order, {place: ("sum", F.lit(1).cast("long"))}).drop(PART)
