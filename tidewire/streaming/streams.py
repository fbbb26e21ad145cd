"""Structured Streaming: tailing the log, upserts, rings, arrival time, deliveries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.waves import ring_bucket


def tail(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New files of the log, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def into(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``function`` on each micro-batch; the cursor is the checkpoint and moves after it returns."""
    w = stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def siphon_stream(stream: DataFrame, function: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Records of a stream to activities, appended to the log at ``path``: a batch that is run again replaces its own files."""
    def write(batch: DataFrame, number: int) -> None:
        function(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return into(stream, write, checkpoint)


def deliver(stream: DataFrame, send: Callable[[list[int]], None], checkpoint: str, after: int = 0, most: int = 10_000) -> StreamingQuery:
    """Hand the times of realtime activities after a time to ``send``, in lots of at most ``most``."""
    def give(batch: DataFrame, _: int) -> None:
        lot: list[int] = []
        for r in batch.filter(F.col("realtime") & (F.col("time") > after)).select("time").toLocalIterator():
            lot.append(r.time)
            if len(lot) == most:
                send(lot)
                lot = []
        if lot:
            send(lot)

    return into(stream, give, checkpoint)


def deduplicated(stream: DataFrame, delay: str = "1 hour", event_time: str = "ts") -> DataFrame:
    """Each (time, version) once within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["time", "version"])


def histogram(stream: DataFrame, width: str, keys: list[str], event_time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Counts of aligned windows."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))


def arrival_times(stream: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """(key, order, time, mono_ts): max(last + 1, time) of each key in order of arrival, kept across batches."""
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        f = pd.concat(list(frames)).sort_values(order)
        # out_i - i = max(last + 1, t_j - j for j <= i), counted from 0
        at = np.arange(len(f))
        out = at + np.maximum(np.maximum.accumulate(f[time].to_numpy(np.int64) - at), last + 1)
        state.update((int(out[-1]),))
        yield pd.DataFrame({key: k[0], order: f[order].to_numpy(), time: f[time].to_numpy(), "mono_ts": out})

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {time} bigint, mono_ts bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def ring_counts(stream: DataFrame, key: str, time: str, width: int, n: int, offset: int = 0) -> DataFrame:
    """(key, newest, counts): hits of the newest ``n`` buckets of each key; a hit older than they are is dropped."""
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, counts = (state.get[0], list(state.get[1])) if state.exists else (None, [0] * n)
        for f in frames:
            for b in sorted(f["bucket"].tolist()):
                if newest is None:
                    newest = b
                if b > newest:
                    gone = min(n, b - newest)
                    counts, newest = counts[gone:] + [0] * gone, b
                if b > newest - n:
                    counts[n - 1 - (newest - b)] += 1
        state.update((newest, counts))
        yield pd.DataFrame({key: [k[0]], "newest": [newest], "counts": [counts]})

    kinds = dict(stream.dtypes)
    rows = stream.select(key, ring_bucket(F.col(time), width, offset).alias("bucket"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, newest bigint, counts array<bigint>", "newest bigint, counts array<bigint>", "update", GroupStateTimeout.NoTimeout)
