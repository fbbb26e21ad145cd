"""Streams, run to their end over files."""

from pyspark.sql import functions as F

from tidewire.streaming import streams


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_arrival_and_ring(spark, tmp_path):
    rows = [("a", i, t) for i, t in enumerate([10, 20, 30, 40, 35, 45])] + [("b", 9, 5)]
    schema = "k string, seq bigint, t bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = streams.tail(spark, str(tmp_path / "in"), schema)
    got = run(streams.arrival_times(live, "k", "t", "seq"), "append", "arrived")
    assert [r.mono_ts for r in got.filter("k = 'a'").orderBy("seq").collect()] == [10, 20, 30, 40, 41, 45]
    more = [("a", k, t) for k, t in enumerate([7, 7, 3, 50, 50, 49, 2, 90])]
    spark.createDataFrame(more[:4], schema).coalesce(1).write.parquet(str(tmp_path / "two"))
    spark.createDataFrame(more[4:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "two"))
    last, want = -1, []
    for _, _, t in more:
        last = max(last + 1, t)
        want.append(last)
    again = run(streams.arrival_times(streams.tail(spark, str(tmp_path / "two"), schema, 2), "k", "t", "seq"), "append", "again")
    assert [r.mono_ts for r in again.orderBy("seq").collect()] == want
    rings = run(streams.ring_counts(live, "k", "t", 10, 3), "update", "rings").filter("k = 'a'").first()
    assert rings.newest == 4 and list(rings.counts) == [1, 2, 2]


def test_siphon(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "time bigint, v string").write.parquet(str(tmp_path / "in"))
    live = streams.tail(spark, str(tmp_path / "in"), "time bigint, v string")
    streams.siphon_stream(live, lambda b: b.withColumn("tenant", F.lit("t")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.time, r.tenant) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "t"), (2, "t")]


def test_histogram_and_dedup(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "2024-01-01 00:00:01"), (1, 1, "2024-01-01 00:00:01"), (2, 1, "2024-01-01 00:11:00")], "time bigint, version bigint, ts string")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = streams.tail(spark, str(tmp_path / "in"), "time bigint, version bigint, ts timestamp")
    assert run(streams.deduplicated(live), "append", "once").count() == 2
    got = run(streams.histogram(live, "10 minutes", []), "complete", "hist").orderBy("window").collect()
    assert [r.n for r in got] == [2, 1]
