"""Histograms over equal segments of time: counts, averages, newest rows, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.waves import LARGEST, interpolate, peaks, segment, segment_length, slope, spread, to_wave
from ..plans.filters import MATCH_ALL, NO_FILTER, FieldFilter, Filter, build
from ..plans.stream import Stream, bounded, within


def keyed(s: Stream, named: dict[str, Filter]) -> DataFrame:
    """Each row once for every named filter that it matches, with ``key``: one scan for all of them."""
    hits = F.array(*(F.when(build(f, s), F.lit(name)) for name, f in named.items()))
    return s.df.withColumn("key", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def _keys(s: Stream, named: dict[str, Filter]) -> DataFrame:
    return s.df.sparkSession.createDataFrame([(k,) for k in named], "key string")


def _base(s: Stream, constraints: Filter, bounds, authz) -> Stream:
    out = s.visible(authz).where(within(bounds))
    return out if constraints == NO_FILTER else out.where(build(constraints, s))


def analytics(s: Stream, named: dict[str, Filter], score_sets: dict[str, tuple[tuple[int, int], int]], constraints: Filter = NO_FILTER, authz: list[str] | None = None) -> DataFrame:
    """(score_set, key, bucket, n): rows of each named filter in each of N segments.

    All score sets are counted in one scan.  Filters without a match have zeros;
    a score set without both bounds has no rows.
    """
    sets = {k: v for k, v in score_sets.items() if bounded(v[0])}
    spark = s.df.sparkSession
    for (low, high), n in sets.values():
        segment_length(low, high, n)
    if not sets:
        return spark.createDataFrame([], "score_set string, key string, bucket int, n bigint")
    inside = F.lit(False)
    for bounds, _ in sets.values():
        inside = inside | within(bounds)
    base = _base(s, constraints, None, authz).where(inside)
    marks = F.array(*(F.struct(F.lit(k).alias("score_set"), segment(F.col("mono_ts"), *b, n).alias("bucket")) for k, (b, n) in sets.items()))
    hits = keyed(base, named).select("key", F.explode(F.filter(marks, lambda x: x["bucket"].isNotNull())).alias("m")).groupBy("m.score_set", "key", "m.bucket").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(k, name, b) for k, (_, n) in sets.items() for name in named for b in range(n)], "score_set string, key string, bucket int")
    return grid.join(hits, ["score_set", "key", "bucket"], "left").select("score_set", "key", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def _total(c: Column) -> Column:
    """A sum that stops at the largest and smallest long."""
    whole = F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.greatest(F.least(whole, F.lit(LARGEST).cast("decimal(38,0)")), F.lit(-LARGEST - 1).cast("decimal(38,0)")).cast("bigint")


def metrics(s: Stream, value: str, named: dict[str, Filter], bounds: tuple[int, int], n: int, constraints: Filter = NO_FILTER, authz: list[str] | None = None) -> DataFrame:
    """(key, bucket, n, sum, avg, min, max) of a whole-number column; an empty segment has average 0, sums stop at the longs' ends."""
    hits = keyed(_base(s, constraints, bounds, authz), named).withColumn("bucket", segment(F.col("mono_ts"), *bounds, n)).filter("bucket is not null")
    g = hits.groupBy("key", "bucket").agg(F.count("*").alias("n"), _total(F.col(value)).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    j = spread(_keys(s, named), n).join(g, ["key", "bucket"], "left")
    return j.select("key", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sum", F.lit(0)).alias("sum"), F.coalesce(F.expr("sum div n"), F.lit(0)).alias("avg"), "min", "max")


def expand_filters(s: Stream, named: dict[str, Filter], field: str, values: list[str], limit: int = 101) -> dict[str, Filter]:
    """Each filter once for every value of a field, named ``filter-value``; ``a*`` stands for values that begin so.

    The value joins the filter's own operation, so an ``or`` becomes wider.  At
    most ``limit`` values of a prefix are taken.  Without any value the filters stay.
    """
    found: list[str] = []
    for v in values:
        if v.endswith("*"):
            terms = s.df.select(F.explode(s.values(field)).alias("t")).filter(F.col("t").startswith(v[:-1])).distinct().orderBy("t").limit(limit)
            found += [r.t for r in terms.collect()]
        else:
            found.append(v)
    found = list(dict.fromkeys(found))[:limit]
    if not found:
        return named
    return {f"{k}-{v}": Filter(f.op, (*f.fields, FieldFilter(field, ((v,),))), f.subs, f.inclusive) for k, f in named.items() for v in found}


def anomaly(
    s: Stream, value: str, named: dict[str, Filter], bounds: tuple[int, int], n: int, constraints: Filter = NO_FILTER,
    expansion: tuple[str, list[str]] | None = None, limit: int = 101, authz: list[str] | None = None,
) -> DataFrame:
    """(key, bucket, value): average of a signed column in each segment, gaps filled along lines.

    Positive and negative sums are divided each by the number of all rows of the
    segment and cut to whole numbers before they are put together; sums stop at
    the largest long.  Keys without a row are left out.
    """
    if expansion:
        named = expand_filters(s, named, *expansion, limit)
    hits = keyed(_base(s, constraints, bounds, authz), named).withColumn("bucket", segment(F.col("mono_ts"), *bounds, n)).filter("bucket is not null")

    g = hits.groupBy("key", "bucket").agg(F.count("*").alias("n"), _total(F.when(F.col(value) > 0, F.col(value))).alias("p"), _total(F.when(F.col(value) < 0, -F.col(value).cast("decimal(38,0)"))).alias("q"))
    g = g.select("key", "bucket", F.expr("p div n").alias("p"), F.expr("q div n").alias("q"))
    full = spread(g.select("key").distinct(), n).join(g, ["key", "bucket"], "left")
    for c in ("p", "q"):
        full = interpolate(full, ["key"], c)
    return full.select("key", "bucket", (F.col("p") - F.col("q")).alias("value"))


def newest_matches(s: Stream, named: dict[str, Filter], bounds: tuple[int, int], k: int, constraints: Filter = NO_FILTER, authz: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, rank, id, time, version): the newest ``k`` rows of each named filter."""
    hits = keyed(_base(s, constraints, bounds, authz), named)
    # each task keeps k rows a key before anything is shuffled
    rn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("id")))
    return hits.withColumn("rank", rn).filter(F.col("rank") <= k).select("key", "rank", "id", "time", "version", *carry)


def log_search(s: Stream, named: dict[str, Filter], bounds: tuple[int, int], n: int, k: int, constraints: Filter = NO_FILTER, authz: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Histogram of each named filter, and its newest ``k`` rows."""
    return analytics(s, named, {"all": (bounds, n)}, constraints, authz).drop("score_set"), newest_matches(s, named, bounds, k, constraints, authz)


def value_waves(s: Stream, field: str, bounds: tuple[int, int], n: int, constraints: Filter = NO_FILTER, authz: list[str] | None = None) -> DataFrame:
    """(value, waveform): a histogram for each value of a field that occurs within the segments."""
    base = _base(s, constraints, bounds, authz)
    rows = base.df.withColumn("value", F.explode(base.values(field))).withColumn("bucket", segment(F.col("mono_ts"), *bounds, n)).filter("bucket is not null")
    # one pass: counts of all segments side by side, summed in each task before the shuffle
    g = rows.groupBy("value", "bucket").agg(F.count("*").alias("n")).groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    wave = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)))
    return g.select("value", wave.alias("waveform"))


STRATEGIES = ("LINEAR_REGRESSION", "LEADER", "PEAKS", "HIGHEST_PEAK")


def _ranks(waves: DataFrame, strategies: tuple[str, ...], percentile: float) -> DataFrame:
    w = F.col("waveform")
    top = F.array_max(w)
    cols = {}
    if "PEAKS" in strategies:
        # of every value's maximum, in order x_1 .. x_n, the point at percentile * (n + 1), x_1 before and x_n behind them;
        # percentile() counts from 0 to n - 1
        n = waves.count()
        share = min(1.0, max(0.0, (percentile * (n + 1) - 1) / max(1, n - 1)))
        p = waves.agg(F.expr(f"percentile(array_max(waveform), {share!r}D)").alias("p"))
        waves = waves.withColumn("p", F.lit(p.first()[0] or 0.0))
        cols["PEAKS"] = peaks(w, top / 6 + F.col("p") / 100).cast("double")
    cols |= {"LINEAR_REGRESSION": slope(w), "LEADER": F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double"), "HIGHEST_PEAK": top.cast("double")}
    return waves.filter(top > 0).select("value", "waveform", *(cols[k].alias(k) for k in strategies))


def trending(
    s: Stream, field: str, score_sets: list[tuple[str, tuple[str, ...], tuple[int, int], int, int]], constraints: Filter = NO_FILTER,
    among: DataFrame | None = None, authz: list[str] | None = None, percentile: float = 0.0095,
) -> DataFrame:
    """(score_set, strategy, rank, value, score): values of a field ranked by how their waveforms move.

    Score sets are (name, strategies, bounds, N, desired), in order; a value that
    an earlier one lists is left out of later ones.  ``among`` (value) restricts
    the values.  Unknown scores come last, ties are taken by value.
    """
    out, taken = None, None
    for name, strategies, bounds, n, desired in score_sets:
        if not bounded(bounds):
            continue
        w = value_waves(s, field, bounds, n, constraints, authz)
        if among is not None:
            w = w.join(among.select("value").distinct(), "value", "left_semi")
        if taken is not None:
            w = w.join(taken, "value", "left_anti")
        scored = _ranks(w, strategies, percentile)
        sets = None
        for k in strategies:
            best = scored.select("value", F.col(k).alias("score")).orderBy(F.desc_nulls_last("score"), "value").limit(desired)
            rn = F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "value"))
            best = best.withColumn("rank", rn).select(F.lit(name).alias("score_set"), F.lit(k).alias("strategy"), "rank", "value", "score")
            sets = best if sets is None else sets.union(best)
        out = sets if out is None else out.union(sets)
        listed = sets.select("value").distinct()
        taken = listed if taken is None else taken.union(listed).distinct()
    return out


def live_waves(s: Stream, field1: str, terms1: list[str], field2: str, terms2: list[str], width: int, n: int, now: int, constraints: Filter = MATCH_ALL) -> DataFrame:
    """analytics() for every pair of terms of two fields over the newest ``n`` buckets of ``width``, the last one ending at a multiple of it."""
    right = (now // width + 1) * width
    named = {f"{a}/{b}": Filter("and", (FieldFilter(field1, ((a,),)), FieldFilter(field2, ((b,),)))) for a in terms1 for b in terms2}
    return analytics(s, named, {"live": ((right - n * width, right), n)}, constraints).drop("score_set")


__all__ = ["analytics", "anomaly", "expand_filters", "keyed", "live_waves", "log_search", "metrics", "newest_matches", "to_wave", "trending", "value_waves"]
