"""Joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1 / HOT_SHARE of the rows, and at least
#: HOT_ROWS: so there are at most HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 1000
HOT_ROWS = 1000


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Left join ``left`` to ``right`` (one row a key, of one column or more; ``count`` = rows of left).

    Hot keys are at most HOT_SHARE rows of ``right``, so they are broadcast and
    their left rows stay where they are; all other keys are joined by a shuffle.
    A null key finds nothing.  ``left`` is read twice, so it should be narrow or
    staged.
    """
    key = [key] if isinstance(key, str) else key
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = right.filter(F.col(count) > limit).drop(count)
    cold = right.filter(F.col(count) <= limit).drop(count)
    names = [*left.columns, *(c for c in hot.columns if c not in key)]
    at_hot = left.join(F.broadcast(hot), key).select(*names)
    rest = left.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return at_hot.unionByName(rest.join(cold, key, "left").select(*names))
