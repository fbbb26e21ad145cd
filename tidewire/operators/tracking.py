"""What a reader has not read, and what is in an inbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import NO_FILTER, Filter, build
from ..plans.stream import Stream

#: (operation, filter, time), in the order they came.
ReadEvent = tuple[str, Filter | None, int]


def _state(s: Stream, events: list[ReadEvent], start) -> DataFrame:
    """The last event that covers a row decides: READ, UNREAD, or MARK_ALL_READ for all up to its time."""
    state = start
    for op, flt, time in events:
        hit = F.col("time") <= time
        if op == "MARK_ALL_READ":
            state = F.when(hit, F.lit(False)).otherwise(state)
        elif op in ("READ", "UNREAD"):
            state = F.when(hit & build(flt, s), F.lit(op == "UNREAD")).otherwise(state)
        else:
            raise ValueError(f"no read event {op}")
    return s.df.withColumn("unread", state)


def unread(s: Stream, events: list[ReadEvent], suppress: Filter = NO_FILTER) -> DataFrame:
    """(id): rows that are unread once the events have been replayed; rows of ``suppress`` never become so by themselves."""
    return _state(s, events, ~build(suppress, s)).filter("unread").select("id")


def inbox(s: Stream, stream_filter: Filter, after: int = -1) -> DataFrame:
    """(id): rows after the last one that was filed that belong to the inbox."""
    return s.df.filter((F.col("id") > after) & build(stream_filter, s)).select("id")


def inbox_unread(s: Stream, stream_filter: Filter, stream_id: str, events: list[ReadEvent]) -> DataFrame:
    """(id): unread rows of the inbox; rows whose readStreamIds name the stream come in as read."""
    own = s.where(build(stream_filter, s))
    start = ~F.array_contains(F.coalesce("p_readStreamIds", F.array().cast("array<string>")), stream_id) if "p_readStreamIds" in s.df.columns else F.lit(True)
    return _state(own, events, start).filter("unread").select("id")


def replay(readers: DataFrame, s: Stream, filters: dict[str, Filter]) -> DataFrame:
    """(stream_id, id, unread) for a table of read events (stream_id, seq, time, op, filter).

    Each different filter is one condition; of all events that cover a row the
    last one holds.  MARK_ALL_READ covers all rows up to its time.  Rows that no
    event covers are not listed (they are unread).
    """
    hits = F.array(*(F.when(build(f, s), F.lit(k)) for k, f in filters.items()))
    rows = s.df.select("id", "time", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("filter"))
    named = readers.filter("op <> 'MARK_ALL_READ'").withColumnRenamed("time", "until").join(rows, "filter").filter("time <= until")
    out = named.groupBy("stream_id", "id").agg(F.max(F.struct("seq", "op")).alias("last"))
    whole = readers.filter("op = 'MARK_ALL_READ'").groupBy("stream_id").agg(F.collect_list(F.struct("seq", "time")).alias("marks"))
    j = out.join(whole, "stream_id", "left").join(s.df.select("id", "time"), "id")
    later = F.exists(F.coalesce("marks", F.expr("cast(array() as array<struct<seq:bigint,time:bigint>>)")), lambda m: (m["seq"] > F.col("last.seq")) & (m["time"] >= F.col("time")))
    listed = j.select("stream_id", "id", ((F.col("last.op") == "UNREAD") & ~later).alias("unread"))
    marked = readers.filter("op = 'MARK_ALL_READ'").groupBy("stream_id").agg(F.max("time").alias("until"))
    rest = s.df.select("id", "time").join(marked, F.col("time") <= F.col("until")).join(out, ["stream_id", "id"], "left_anti")
    return listed.unionByName(rest.select("stream_id", "id", F.lit(False).alias("unread")))
