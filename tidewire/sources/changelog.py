"""The change log: ingest of activities, versions, removal, siphons, copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADD, REMOVE = "ADD", "REMOVE"


def resolve(log: DataFrame, payload: list[str], recover: bool = False) -> DataFrame:
    """(tenant, time, version, removed, payload...): the state after a log of (tenant, time, version, op, seq, payload...).

    In order of seq: an unknown key is added, a known one updated or hidden only
    by a newer version; what is unknown cannot be removed, and what is removed
    comes back only with ``recover``.
    """
    # each key's changes are few; they are folded in order, keys are independent
    row = F.struct("seq", "version", "op", *payload)
    g = log.groupBy("tenant", "time").agg(F.sort_array(F.collect_list(row)).alias("changes"))
    empty = F.struct(
        F.lit(-1).cast("bigint").alias("version"), F.lit(False).alias("removed"), F.lit(False).alias("known"),
        *(F.lit(None).cast(log.schema[p].dataType).alias(p) for p in payload),
    )

    def step(s: Column, c: Column) -> Column:
        newer = ~s["known"] | (c["version"] > s["version"])
        add = (c["op"] == ADD) & newer & (~s["removed"] | F.lit(recover))
        drop = (c["op"] == REMOVE) & s["known"] & (c["version"] > s["version"])
        return F.struct(
            F.when(add | drop, c["version"]).otherwise(s["version"]).alias("version"), F.when(drop, True).when(add, False).otherwise(s["removed"]).alias("removed"),
            (s["known"] | add).alias("known"), *(F.when(add, c[p]).otherwise(s[p]).alias(p) for p in payload),
        )

    folded = g.select("tenant", "time", F.aggregate("changes", empty, step).alias("s")).filter("s.known")
    return folded.select("tenant", "time", "s.version", "s.removed", *(f"s.{p}" for p in payload))


def upsert(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def append(log: DataFrame, path: str) -> None:
    """Write changes to the log at ``path``, by tenant."""
    log.write.mode("append").partitionBy("tenant").parquet(path)


def scan(spark: SparkSession, path: str, tenant: str | None = None, since: int | None = None) -> DataFrame:
    """Read the log, of one tenant and after a cursor if asked; both reach the scan."""
    df = spark.read.parquet(path)
    df = df if tenant is None else df.filter(F.col("tenant") == tenant)
    return df if since is None else df.filter(F.col("seq") > since)


def partition_ids(log: DataFrame, capacity: int, order: str = "seq") -> DataFrame:
    """Adds partition_id: a tenant's arrivals in runs of ``capacity`` (``order`` is dense within the tenant)."""
    return log.withColumn("partition_id", F.floor(F.col(order) / capacity).cast("int"))


def siphon(rows: DataFrame, function: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Turn rows of any source into activities and append them; for streams see tidewire.streaming."""
    append(function(rows), path)


def edges(rows: DataFrame) -> DataFrame:
    """Activities of records (tenant, user, name, origin, destination, tags, latency, time); empty values are left out."""
    def given(c: str) -> Column:
        return F.when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))

    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    return rows.select("tenant", "time", *(given(c).alias(f"f_{c}") for c in ("user", "name", "origin", "destination")), tags.alias("f_tags"), F.col("latency").cast("string").alias("latency"))


def copy(log: DataFrame, tenant: str, target: str, start: int | None = None, shift: int = 0, step: tuple[int, int] | None = None, rows: int | None = None, reverse: bool = False) -> DataFrame:
    """A tenant's activities under another one.

    In order of arrival (``seq``), the first with time > ``start`` begins the copy
    and all that come after it belong to it, late ones too; with ``reverse`` those
    before it are copied.  Times move by ``shift``, or with ``step`` = (from, to)
    are dealt over that interval by their distance from the first one copied;
    ``rows`` is the number of arrivals that fill it, all that are copied if None.
    """
    own = log.filter(F.col("tenant") == tenant)
    if start is not None:
        begin = own.filter(F.col("time") > start).agg(F.min("seq").alias("_begin"))  # one row
        keep = F.col("seq") < F.col("_begin") if reverse else F.col("seq") >= F.col("_begin")
        own = own.join(F.broadcast(begin), keep if not reverse else F.coalesce(keep, F.lit(True))).drop("_begin")
    if step is not None:
        ends = own.agg(F.min("seq").alias("_low"), (F.lit(rows) if rows else F.max("seq") - F.min("seq") + 1).alias("_n"))
        time = F.lit(step[0]) + F.expr(f"((seq - _low) * {step[1] - step[0]}) div _n")
        return own.crossJoin(F.broadcast(ends)).withColumn("time", time).withColumn("tenant", F.lit(target)).drop("_low", "_n")
    return own.withColumn("time", F.col("time") + shift).withColumn("tenant", F.lit(target))


def bits_of(value: Column) -> Column:
    """The sign and set bits of a whole number as terms, as metric intake files them."""
    a = F.abs(value)
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("getbit", a, k) == 1)
    return F.concat(F.array(F.when(value < 0, "-").otherwise("+")), F.transform(bits, lambda k: k.cast("string")))


def value_of(terms: Column) -> Column:
    """The number of such terms."""
    digits = F.filter(terms, lambda x: ~x.isin("+", "-"))
    total = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, x: a + F.expr("1L") * F.pow(F.lit(2.0), x.cast("int")).cast("bigint"))
    return F.when(F.array_contains(terms, "-"), -total).otherwise(total)
