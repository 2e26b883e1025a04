"""Joins of rows with one row per key where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than one in so many rows are hot; there are at most so many of them.
HEAVY_SHARE = 1000
#: So many rows are no load for one task, whatever their keys; up to here nothing is split.
PLAIN_ROWS = 500_000


def meet(rows: DataFrame, targets: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to ``targets``, which has one row per key ``on`` and in ``weight`` the
    number of rows of the key; ``total`` is the number of rows.

    Targets of over 1/1000 of the rows, of which there are at most 1000, are broadcast, so no task
    gets all rows of a hot key; the others meet in a shuffle.  ``targets`` should be staged: it is
    read once more to see whether a key is hot.
    """
    if total <= PLAIN_ROWS:
        return rows.join(targets.drop(weight), on, how)
    heavy = F.col(weight) * HEAVY_SHARE > total
    hot = targets.where(heavy).drop(weight)
    if hot.isEmpty():
        return rows.join(targets.drop(weight), on, how)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    cold = targets.where(~heavy).drop(weight)
    a = marked.where("_hot").drop("_hot")
    b = marked.where("_hot is null").select(*rows.columns).join(cold, on, how)
    return a.unionByName(b)
