"""A stream: activities as rows, with the schema of their fields.

Columns are id (arrival order), time, mono_ts, version, removed, authz and one
column per field: STRING for a field of one value, so that filters on it reach the
Parquet scan, and ARRAY<STRING> for one of many.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schema import LONGEST_VALUE, Field, Schema

ALL_TIME = (0, (1 << 63) - 1)
SEPARATOR = "\x1f"


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    schema: Schema

    def field(self, name: str) -> Field | None:
        return self.schema.field(name)

    def col(self, name: str) -> Column:
        return self.df[self.schema.field(name).column]

    def values(self, name: str) -> Column:
        """A field's values as an array, whatever its kind."""
        f = self.schema.field(name)
        c = F.col(f.column)
        return c if f.multi else F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))

    def each(self, name: str) -> DataFrame:
        """Each row once for every different value of a field, in ``value``; rows without one go."""
        f = self.schema.field(name)
        v = F.explode(F.array_distinct(F.col(f.column))) if f.multi else F.col(f.column)
        return self.df.withColumn("value", v).filter("value is not null")

    def first(self, name: str) -> Column:
        """A field's first value, or null."""
        f = self.schema.field(name)
        return F.get(F.col(f.column), F.lit(0)) if f.multi else F.col(f.column)

    def where(self, condition: Column) -> Stream:
        return replace(self, df=self.df.filter(condition))

    def visible(self, authz: list[str] | None = None) -> Stream:
        """Rows not removed, and if ``authz`` is given those that list any of it."""
        s = self.where(~F.col("removed"))
        return s if authz is None else s.where(F.arrays_overlap("authz", F.array(*(F.lit(a) for a in authz)).cast("array<string>")))


def within(bounds: tuple[int, int] | None) -> Column:
    """Monotonic time in (low, high]; no condition for ALL_TIME."""
    if bounds is None or tuple(bounds) == ALL_TIME:
        return F.lit(True)
    return (F.col("mono_ts") > bounds[0]) & (F.col("mono_ts") <= bounds[1])


def bounded(bounds: tuple[int, int] | None) -> bool:
    return bounds is not None and bounds[0] != 0 and bounds[1] != ALL_TIME[1]


def clean_values(values: Column) -> Column:
    """Values that count: not null, not empty and not too long."""
    return F.filter(values, lambda x: x.isNotNull() & (F.length(x).between(1, LONGEST_VALUE)))


def composite(*parts: Column) -> Column:
    """All combinations of the parts' values (arrays), each joined to one term."""
    def pairs(left: Column, right: Column) -> Column:
        return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit(SEPARATOR), b))))

    return reduce(pairs, parts)


def make_stream(
    df: DataFrame, schema: Schema, id: str, time: Column, fields: dict[str, Column], version: Column | None = None,
    removed: Column | None = None, authz: Column | None = None, mono: Column | None = None, properties: dict[str, Column] | None = None,
) -> Stream:
    """A stream over a table in arrival order ``id``; times that rise with it are monotonic as they are."""
    cols = [
        F.col(id).cast("bigint").alias("id"), time.cast("bigint").alias("time"), (time if mono is None else mono).cast("bigint").alias("mono_ts"),
        (F.lit(0) if version is None else version).cast("bigint").alias("version"), (F.lit(False) if removed is None else removed).alias("removed"),
        (F.array() if authz is None else authz).cast("array<string>").alias("authz"),
    ]
    for f in schema.fields:
        if f.parts:
            continue
        v = fields[f.name]
        cols.append((clean_values(v.cast("array<string>")) if f.multi else F.when(F.length(v.cast("string")).between(1, LONGEST_VALUE), v.cast("string"))).alias(f.column))
    for name, v in (properties or {}).items():
        cols.append(v.alias(f"p_{name}"))
    out = Stream(df.select(*cols), schema)
    made = {f.column: composite(*(out.values(p) for p in f.parts)) for f in schema.fields if f.parts}
    return replace(out, df=out.df.withColumns(made)) if made else out


def mark_latest(s: Stream, field: str) -> Stream:
    """Adds latest_<field>: the row is the newest with its value."""
    f = s.field(field)
    if f.multi:
        raise ValueError("a latest index has one value a row")
    top = s.df.filter(F.col(f.column).isNotNull()).groupBy(f.column).agg(F.max("id").alias("id")).select("id", F.lit(True).alias(f"latest_{field}"))
    return replace(s, df=s.df.join(top, "id", "left").withColumn(f"latest_{field}", F.coalesce(f"latest_{field}", F.lit(False))))


def mark_first(s: Stream, field: str) -> Stream:
    """Adds first_<field>, which a field with a first index is matched by: the values whose earliest row, removed or not, this is."""
    f = s.field(field)
    if "first" not in f.features:
        raise ValueError(f"{field} has no first index")
    low = s.each(field).groupBy("value").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_list("value").alias(f.first_column))
    return replace(s, df=s.df.join(low, "id", "left"))


def newest_per_value(s: Stream, field: str, first: bool = False) -> DataFrame:
    """The newest (or first) row of each value of a field."""
    rows = s.df.withColumn("value", F.explode(s.values(field)))
    pick = F.min_by if first else F.max_by
    return rows.groupBy("value").agg(pick(F.struct("id", "time"), F.col("id")).alias("d")).select("value", "d.id", "d.time")


def monotonic_time(df: DataFrame, order: str, time: str, block: int = 1 << 20) -> DataFrame:
    """Adds mono_ts: max(last + 1, time) in order of arrival (``order``: dense, from any number).

    m_i = i + max over j <= i of (t_j - j).  Blocks of arrivals are summed up
    first, so that only one row a block passes through a window without key.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / block)).withColumn("_d", F.col(time) - F.col(order))
    sums = b.groupBy("_b").agg(F.max("_d").alias("_m"))
    before = sums.select(F.col("_b").alias("_k"), F.max("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_p"))
    own = F.max("_d").over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    j = b.join(before, b["_b"] == before["_k"])
    return j.withColumn("mono_ts", F.col(order) + F.greatest(own, F.coalesce("_p", own))).drop("_b", "_d", "_k", "_p")
