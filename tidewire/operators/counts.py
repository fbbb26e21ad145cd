"""Distinct values of a field: the values, how many, and counts in order of recency."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import MATCH_ALL, NO_FILTER, Filter, build, compose, prefix_of
from ..plans.stream import ALL_TIME, SEPARATOR, Stream, within


@dataclass(frozen=True)
class Constraint:
    """What one answer of aggregate_counts is about."""

    around: str
    filter: Filter = NO_FILTER
    start: int = 0
    desired: int = 10
    gather: tuple[str, ...] = field(default=())


def _scope(s: Stream, flt: Filter, authz: list[str] | None, bounds, unread: DataFrame | None, unread_only: bool) -> Stream:
    out = s.visible(authz).where(within(bounds) & build(flt, s))
    if unread is not None:
        marks = unread.select("id").distinct().withColumn("unread", F.lit(True))
        out = Stream(out.df.join(marks, "id", "left_semi" if unread_only else "left"), s.schema)
        out = Stream(out.df.withColumn("unread", F.lit(True) if unread_only else F.coalesce("unread", F.lit(False))), s.schema)
    elif unread_only:
        out = out.where(F.lit(False))
    return out


def aggregate_counts(
    s: Stream, constraints: dict[str, Constraint], stream_filter: Filter = MATCH_ALL, answer=ALL_TIME, collect=ALL_TIME, count=ALL_TIME,
    authz: list[str] | None = None, unread: DataFrame | None = None, include_unread: bool = False, unread_only: bool = False, inbox: DataFrame | None = None,
) -> DataFrame:
    """For each named constraint, values of a field from the newest on, with counts and what their newest and oldest rows hold.

    A field of many values counts a row once for each different value.  A value
    counts its rows within ``count``; it is listed if its newest row lies
    in ``collect`` (both ends included), the first ``start`` are skipped and
    ``desired`` kept.  With ``inbox`` (ids) only those rows are read and only
    unread ones counted.  ``unread`` holds the ids a reader has not read.
    """
    base = _scope(s, stream_filter, authz, answer, unread, unread_only)
    if inbox is not None:
        base = Stream(base.df.join(inbox.select("id").distinct(), "id", "left_semi"), s.schema)
    flags = include_unread and unread is not None
    out = None
    for name, c in constraints.items():
        own = base if c.filter == NO_FILTER else base.where(build(c.filter, base))
        got = F.struct("time", "mono_ts", "id", *(base.values(g).alias(f"g_{g}") for g in c.gather), *(["unread"] if flags else []))
        counts = within(count)
        if inbox is not None:
            counts = counts & (F.col("unread") if unread is not None else F.lit(False))
        g = own.each(c.around).groupBy("value").agg(
            F.count_if(counts).alias("n"), F.max_by(got, F.col("id")).alias("latest"), F.min_by(got, F.col("id")).alias("oldest"),
            *([F.bool_or("unread").alias("any_unread")] if flags else []),
        )
        if tuple(collect) != ALL_TIME:
            g = g.filter(F.col("latest.mono_ts").between(*collect))
        # only start + desired rows pass through the window
        top = g.orderBy(F.desc("latest.id"), "value").limit(c.start + c.desired)
        rn = F.row_number().over(Window.orderBy(F.desc("latest.id"), "value"))
        top = top.withColumn("rank", rn).filter(F.col("rank") > c.start)
        cols = [F.lit(name).alias("constraint"), "rank", "value", "n", F.col("latest.time").alias("latest_time"), F.col("oldest.time").alias("oldest_time")]
        cols += [F.col(f"{side}.g_{g_}").alias(f"{side}_{g_}") for side in ("latest", "oldest") for g_ in c.gather]
        cols += ["any_unread", F.col("latest.unread").alias("latest_unread"), F.col("oldest.unread").alias("oldest_unread")] if flags else []
        top = top.select(*cols)
        out = top if out is None else out.unionByName(top, allowMissingColumns=True)
    return out


def distinct_count(
    s: Stream, around: str, constraints: Filter = NO_FILTER, stream_filter: Filter = MATCH_ALL, bounds=ALL_TIME, desired: int | None = None,
    authz: list[str] | None = None, unread: DataFrame | None = None, unread_only: bool = False, inbox: DataFrame | None = None, approximate: bool = False,
) -> DataFrame:
    """How many different values a field has: one row; counting stops at ``desired`` + 1."""
    own = _scope(s, MATCH_ALL if inbox is not None else stream_filter, authz, bounds, unread, unread_only)
    if constraints != NO_FILTER:
        own = own.where(build(constraints, own))
    df = own.df if inbox is None else own.df.join(inbox.select("id").distinct(), "id", "left_semi")
    df, v = Stream(df, s.schema).each(around), F.col("value")
    n = F.approx_count_distinct(v) if approximate else F.count_distinct(v)
    return df.agg((n if desired is None else F.least(n, F.lit(desired + 1))).cast("bigint").alias("n"))


def distincts(
    s: Stream, gather: str, bounds=ALL_TIME, constraints: Filter = NO_FILTER, prefixes: tuple[tuple[str, ...], ...] = (),
    parts: tuple[int, ...] = (), restrict: list[tuple[Filter, ...]] | None = None, ignore_time: bool = False,
) -> DataFrame:
    """The different terms of a field, of those with a prefix if any are given, as (value).

    ``parts`` picks parts of composite terms.  ``restrict`` is a list of
    alternatives whose results must all hold a term.  Neither authorisation nor
    removal is looked at.  With ``ignore_time`` a query without filter reads all.
    """
    f = s.field(gather)
    d = s.df if ignore_time and constraints == NO_FILTER else s.df.filter(within(bounds))
    if constraints != NO_FILTER:
        d = d.filter(build(constraints, s))
    t = d.select(F.explode(s.values(gather)).alias("value"))
    if prefixes:
        heads = [prefix_of(f, (*p, "*")) for p in prefixes]
        cond = F.lit(False)
        for h in heads:
            cond = cond | F.col("value").startswith(h)
        t = t.filter(cond)
    sep = SEPARATOR if f.parts else f.separator
    if parts:
        pieces = F.split("value", sep.replace("\\", "\\\\") if sep.strip() else sep)
        picked = F.array_join(F.array(*(F.get(pieces, F.lit(k)) for k in parts)), sep)
        t = t.withColumn("value", F.when((F.size(pieces) <= 1) & F.lit(len(parts) == 1), F.col("value")).otherwise(picked))
    t = t.distinct()
    for group in restrict or []:
        allowed = None
        for flt in group:
            own = distincts(s, gather, bounds, flt, parts=parts)
            allowed = own if allowed is None else allowed.union(own).distinct()
        t = t.join(allowed, "value", "left_semi")
    return t


def uniques(s: Stream, gather: str, **how) -> DataFrame:
    """How many terms distincts() finds: one row."""
    return distincts(s, gather, **how).agg(F.count("*").alias("n"))


def composite_value(s: Stream, name: str, *parts: str) -> str:
    return compose(s.field(name), parts)


def first_term_wins(s: Stream, field_name: str) -> DataFrame:
    """Counts for a field of many values where each row belongs to one term only.

    From the newest row on, the first value of the newest row left is taken, and
    all rows that hold that value go with it.  Each round needs the one before,
    so this is for the terms of one answer: it runs over a single group.
    """
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ascending=False)
        holders: dict[str, list[int]] = {}
        values = frame["v"].tolist()
        for k, vs in enumerate(values):
            for v in set(vs):
                holders.setdefault(v, []).append(k)
        gone, out = [False] * len(values), []
        for k, vs in enumerate(values):
            if gone[k]:
                continue
            n = 0
            for j in holders[vs[0]]:
                n += not gone[j]
                gone[j] = True
            out.append((vs[0], n, int(frame["id"].iloc[k])))
        return pd.DataFrame(out, columns=["value", "n", "latest_id"])

    rows = s.df.select("id", s.values(field_name).alias("v")).filter(F.size("v") > 0).withColumn("g", F.lit(1))
    return rows.groupBy("g").applyInPandas(lambda f: run(f[["id", "v"]]), "value string, n bigint, latest_id bigint")
