"""Streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.schema import Field, Schema
from ..plans.stream import Stream, make_stream

EVENTS = Schema("events", 1, (
    Field("user"), Field("type", prefix="wildcard"), Field("hour"), Field("level", prefix="raw", width=1, separator=" "),
    Field("userType", "multiTerm", prefix="wildcard", parts=("user", "type")),
))
DOCUMENTS = Schema("documents", 1, (Field("text", "multiTermCardinality", prefix="wildcard"), Field("lang"), Field("source", prefix="wildcard")))
ORDERS = Schema("orders", 1, (Field("customer"), Field("part", "multiTerm"), Field("priority")))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> Stream:
    """Events by event_id, which is their arrival; the type stands for authorisation too, and one in 97 is removed."""
    df = load(spark, sf_dir, "events")
    fields = {
        "user": F.col("user_id"), "type": F.col("event_type"), "hour": F.hour(F.col("ts").cast("timestamp")),
        "level": F.concat_ws(" ", F.floor(F.col("value") / 50).cast("string"), F.col("event_type")),
    }
    return make_stream(df, EVENTS, "event_id", micros("ts"), fields, removed=F.col("event_id") % 97 == 5, authz=F.array("event_type"), properties={"value": F.floor("value").cast("bigint")})


def documents(spark: SparkSession, sf_dir: str) -> Stream:
    df = load(spark, sf_dir, "documents")
    return make_stream(df, DOCUMENTS, "doc_id", F.col("doc_id") * 1000, {"text": tokens(F.col("text")), "lang": F.col("lang"), "source": F.col("source")})


def orders(spark: SparkSession, sf_dir: str) -> Stream:
    """An activity for each order, with all its parts."""
    o, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    parts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))).alias("parts"))
    fields = {"customer": F.col("o_custkey"), "part": F.col("parts"), "priority": F.col("o_orderpriority")}
    return make_stream(o.join(parts, "o_orderkey", "left"), ORDERS, "o_orderkey", micros("o_orderdate"), fields)
