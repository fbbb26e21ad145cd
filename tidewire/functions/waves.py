"""Arithmetic on segments of time and on waveforms (arrays of one value a segment)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST = (1 << 63) - 1


def segment_length(low: int, high: int, n: int) -> int:
    """(high - low) div n; it has to be 1 at least."""
    d = (high - low) // n if n > 0 else 0
    if d < 1:
        raise ValueError(f"{n} segments do not fit between {low} and {high}")
    return d


def segment(time: Column, low: int, high: int, n: int) -> Column:
    """The segment [low + i d, low + (i + 1) d) of a time in (low, high], or null: ``low`` itself and the rest after n d are in none."""
    d = segment_length(low, high, n)
    offset = time - F.lit(low).cast("bigint")
    return F.when((time > low) & (time < low + n * d), ((offset - F.pmod(offset, F.lit(d))) / d).cast("int"))


def spread(keys: DataFrame, n: int) -> DataFrame:
    """Every row of ``keys`` once for each segment."""
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket"))


def to_wave(long: DataFrame, keys: list[str], value: str, name: str = "waveform") -> DataFrame:
    """Rows (keys, bucket, value) as one array a key, in order of bucket."""
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", value))), lambda x: x[value]).alias(name))


def merge_waves(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def slope(wave: Column) -> Column:
    """Least-squares slope of w[i] on i / (n - 1), of whole numbers; null for a single segment.

    The sums are whole numbers up to the last division, so equal slopes are equal.
    """
    n = F.size(wave)
    xy = F.aggregate(F.transform(wave, lambda y, i: ((2 * i - (n - 1)) * y).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(n > 1, 6 * xy / (n * (n + 1)))


def peaks(wave: Column, delta: Column) -> Column:
    """How many peaks a waveform has: a maximum counts once the values fall more than ``delta`` below it."""
    start = F.struct(F.lit(float("inf")).alias("mn"), F.lit(float("-inf")).alias("mx"), F.lit(True).alias("up"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        v = x.cast("double")
        mx, mn = F.greatest(s["mx"], v), F.least(s["mn"], v)
        fell, rose = s["up"] & (v < mx - delta), ~s["up"] & (v > mn + delta)
        return F.struct(
            F.when(fell, v).otherwise(mn).alias("mn"), F.when(rose, v).otherwise(mx).alias("mx"),
            F.when(fell, False).when(rose, True).otherwise(s["up"]).alias("up"), (s["n"] + F.when(fell, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(wave, start, step, lambda s: s["n"])


def interpolate(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fills null values of (keys, bucket): on the line between the neighbours, cut to whole numbers; flat beyond the ends."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("bucket"))
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    b0, b1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    f = long.withColumns({"_v0": v0, "_v1": v1, "_b0": b0, "_b1": b1})
    line = F.expr(f"_v0 + cast((_v1 - _v0) * cast(bucket - _b0 as double) / (_b1 - _b0) as bigint)")
    return f.withColumn(value, F.coalesce(value, F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(line))).drop("_v0", "_v1", "_b0", "_b1")


def ring_bucket(time: Column, width: int, offset: int = 0) -> Column:
    """Number of the ring bucket of a time: time div width, one less before the offset."""
    t = F.floor(time / F.lit(width)).cast("bigint")
    return t - F.when(F.pmod(time, F.lit(width)) < offset, 1).otherwise(0)


def ring(df: DataFrame, keys: list[str], time: str, width: int, n: int, offset: int = 0) -> DataFrame:
    """(keys, bucket, n): hits of the newest ``n`` buckets of each key, zero where there are none; older hits are dropped."""
    hits = df.groupBy(*keys, ring_bucket(F.col(time), width, offset).alias("bucket")).agg(F.count("*").alias("n"))
    top = hits.groupBy(*keys).agg(F.max("bucket").alias("_top"))
    all_buckets = top.select(*keys, F.explode(F.sequence(F.col("_top") - (n - 1), F.col("_top"))).alias("bucket"))
    return all_buckets.join(hits, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def pack_order_id(ms: Column, worker: int = 0, sequence: int = 0, epoch: int = 0) -> Column:
    """A time-ordered 63-bit number: 42 bits of milliseconds since ``epoch``, 9 of the worker, 12 of the sequence."""
    return F.shiftleft(ms - F.lit(epoch), 21).bitwiseOR(F.lit((worker << 12) | sequence).cast("bigint"))


def unpack_order_id(number: Column, epoch: int = 0) -> Column:
    """The milliseconds of such a number."""
    return F.shiftright(number, 21) + F.lit(epoch)
