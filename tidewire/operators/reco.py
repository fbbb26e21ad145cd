"""Collaborative filtering: what those who shared my items had besides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import MATCH_ALL, Filter, build
from ..plans.stream import Stream


def recommend(s: Stream, mine: Filter, field1: str, field2: str, field3: str, k: int, scorable: Filter = MATCH_ALL, remove: DataFrame | None = None, authz: list[str] | None = None) -> DataFrame:
    """(value, score): the ``k`` best values of ``field3``.

    Items are field1, people field2.  The k people with most rows on items of
    ``mine`` count by those rows; each adds its count to every value of field3 it
    has, but for items of mine and values of ``remove`` (value).  With field2 =
    field3 the people themselves are the answer.  Ties are taken by value.
    """
    ok = s.visible(authz)
    ok = ok.where(build(scorable, ok))
    own = build(mine, ok)
    parents = ok.df.filter(own).select(F.explode(ok.values(field1)).alias("value")).distinct()
    others = ok.df.filter(~own)
    rows = others.select("id", F.explode(ok.values(field1)).alias("value"), ok.first(field2).alias("who"))
    touched = rows.join(parents, "value", "left_semi").select("id", "who").distinct()
    contrib = touched.filter("who is not null").groupBy("who").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "who").limit(k)
    if field2 == field3:
        return contrib.select(F.col("who").alias("value"), F.col("n").alias("score"))
    excluded = parents if remove is None else parents.union(remove.select("value")).distinct()
    pairs = ok.df.select(ok.first(field2).alias("who"), F.explode(ok.values(field3)).alias("value"))
    pairs = pairs.join(F.broadcast(contrib), "who").distinct()  # contrib has k rows
    score = pairs.join(excluded, "value", "left_anti").groupBy("value").agg(F.sum("n").alias("score"))
    return score.orderBy(F.desc("score"), "value").limit(k)
