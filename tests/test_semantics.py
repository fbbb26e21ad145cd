"""Golden cases and edges of the stream operators."""

import pytest
from pyspark.sql import functions as F

from tidewire import plugins
from tidewire.functions.waves import merge_waves, peaks, segment, slope
from tidewire.operators import counts, model, reco, tracking, waves
from tidewire.operators.counts import Constraint
from tidewire.plans.filters import MATCH_ALL, NO_FILTER, Filter, QueryError, all_of, build, but_not, from_json, parse_filters, parse_query, term, to_json
from tidewire.plans.schema import Field, Schema
from tidewire.plans.stream import make_stream, mark_first, monotonic_time
from tidewire.sources import changelog


def stream(spark, rows, fields, **more):
    """Rows (id, time, values...), a list for a field of many values."""
    schema = Schema("t", 1, tuple(fields))
    kinds = ", ".join(f"{f.name} {'array<string>' if f.multi else 'string'}" for f in fields)
    df = spark.createDataFrame(rows, f"id bigint, time bigint, {kinds}")
    return make_stream(df, schema, "id", F.col("time"), {f.name: F.col(f.name) for f in fields}, **more)


@pytest.fixture(scope="module")
def colours(spark):
    a = {"red": "02468", "green": "13579", "blue": "014589", "yellow": "2367"}
    b = {"red": "13579", "green": "014589", "blue": "2367", "yellow": "02468"}
    rows = [(i, i, [c for c in a if str(i) in a[c]], [c for c in b if str(i) in b[c]]) for i in range(10)]
    return stream(spark, rows, [Field("a", "multiTerm", prefix="wildcard"), Field("b", "multiTerm", prefix="wildcard")])


def ids(s, flt):
    return sorted(r.id for r in s.df.filter(build(flt, s)).select("id").collect())


@pytest.mark.parametrize("query", ["(red AND b:blue) OR (b:yellow NOT yellow)", "(re* AND b:bl*) OR (b:ye* NOT ye*)"])
def test_query_strings(colours, query):
    assert ids(colours, parse_query(query, "a")) == [0, 2, 4, 6, 8]


@pytest.mark.parametrize("query", ['"a phrase"', "[a TO b]", "re~", "r*d", "(red", "red)", "", "red OR"])
def test_query_strings_refused(query):
    with pytest.raises(QueryError):
        parse_query(query, "a")


def test_filter_edges(colours):
    assert ids(colours, NO_FILTER) == []
    assert ids(colours, Filter("and", (term("a"), term("a", "red")))) == []
    assert ids(colours, Filter("or", (term("a"), term("a", "red")))) == [0, 2, 4, 6, 8]
    with pytest.warns(UserWarning):
        assert ids(colours, all_of(term("a", "red"), term("nosuch", "1"))) == [0, 2, 4, 6, 8]
    assert ids(colours, but_not(term("a", "red"), inclusive=True)) == [1, 3, 5, 7, 9]
    with pytest.raises(NotImplementedError):
        build(Filter("xor", (term("a", "red"),)), colours)
    flt = parse_filters("a:red|blue, b:yellow")
    assert from_json(to_json(flt)) == flt and ids(colours, flt) == [0, 2, 4, 6, 8]


def test_monotonic_time(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([10, 20, 30, 40, 35, 45])], "id bigint, t bigint")
    for block in (1, 2, 100):
        assert [r.mono_ts for r in monotonic_time(df, "id", "t", block).orderBy("id").collect()] == [10, 20, 30, 40, 41, 45]


def test_segments(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1, 3, 9, 10)], "t bigint")
    assert [r.b for r in df.select(segment(F.col("t"), 0, 10, 3).alias("b")).collect()] == [None, 0, 1, None, None]
    with pytest.raises(ValueError):
        segment(F.col("t"), 0, 2, 3)


def test_wave_functions(spark):
    w = [0, 1, 2, 3, 4, 5, 1, 2, 3, 4, 8, 7, 6, 5, 4, 3, 2, 1]
    df = spark.createDataFrame([(w, [1], [1, 2, 3])], "w array<bigint>, one array<bigint>, up array<bigint>")
    r = df.select(peaks(F.col("w"), F.lit(1.0)).alias("p"), slope(F.col("one")).alias("s1"), slope(F.col("up")).alias("s3"), merge_waves(F.col("one"), F.col("up")).alias("m")).first()
    assert (r.p, r.s1, r.s3, r.m) == (2, None, 2.0, [2, 2, 3])


def test_interpolation(spark):
    rows = [(0, 1, "x", "2"), (1, 31, "x", "8")]
    s = stream(spark, rows, [Field("u"), Field("v")])
    s = type(s)(s.df.withColumn("n", F.col("f_v").cast("bigint")), s.schema)
    got = waves.anomaly(s, "n", {"x": all_of(term("u", "x")), "no": all_of(term("u", "y"))}, (0, 50), 5).orderBy("bucket").collect()
    assert [(r.key, r.value) for r in got] == [("x", v) for v in (2, 4, 6, 8, 8)]


REC = {"bob0": "1 2 3 4 9", "frank": "1 2 3 4 10", "jane": "2 3 4 11", "liz": "3 4 12 12"}


def test_recommendations(spark):
    rows, k = [], 0
    for user, docs in REC.items():
        for d in docs.split():
            rows.append((k, k, user, d))
            k += 1
    s = stream(spark, rows, [Field("user"), Field("doc")])
    mine = all_of(term("user", "bob0"))
    got = [(r.value, r.score) for r in reco.recommend(s, mine, "doc", "user", "doc", 10).collect()]
    assert got == [("10", 4), ("11", 3), ("12", 2)]
    remove = spark.createDataFrame([("11",)], "value string")
    assert [(r.value, r.score) for r in reco.recommend(s, mine, "doc", "user", "doc", 10, remove=remove).collect()] == [("10", 4), ("12", 2)]


def test_counts_and_paging(spark):
    s = stream(spark, [(i, i, f"u{i % 5}") for i in range(10)] + [(10, 10, None)], [Field("u")])
    got = counts.aggregate_counts(s, {"c": Constraint("u", start=1, desired=2)}).orderBy("rank").collect()
    assert [(r.value, r.n, r.latest_time, r.oldest_time) for r in got] == [("u3", 2, 8, 3), ("u2", 2, 7, 2)]
    assert counts.distinct_count(s, "u", desired=2).first().n == 3
    assert counts.uniques(s, "u").first().n == 5
    empty = s.where(F.lit(False))
    assert counts.aggregate_counts(empty, {"c": Constraint("u")}).count() == 0 and counts.distinct_count(empty, "u").first().n == 0


def test_tracking(spark):
    s = stream(spark, [(i, i, "ab"[i % 2]) for i in range(6)], [Field("u")])
    events = [("READ", all_of(term("u", "a")), 4), ("UNREAD", all_of(term("u", "a")), 2), ("MARK_ALL_READ", None, 1)]
    assert sorted(r.id for r in tracking.unread(s, events).collect()) == [2, 3, 5]


def test_versions(spark):
    log = [("t", 1, 1, "ADD", 1, "a"), ("t", 1, 3, "ADD", 2, "b"), ("t", 1, 2, "ADD", 3, "c"), ("t", 1, 2, "REMOVE", 4, None), ("t", 2, 9, "REMOVE", 5, None)]
    df = spark.createDataFrame(log, "tenant string, time bigint, version bigint, op string, seq bigint, x string")
    assert [tuple(r) for r in changelog.resolve(df, ["x"]).collect()] == [("t", 1, 3, False, "b")]
    more = df.union(spark.createDataFrame([("t", 1, 4, "REMOVE", 6, None)], df.schema))
    assert changelog.resolve(more, ["x"]).first().removed


def test_feature_tuples(spark):
    rows = [(0, 0, list("abc"), list("xy"), list("1234"))]
    s = stream(spark, rows, [Field(n, "multiTerm") for n in ("f", "g", "h")])
    assert model.tuples(s, model.Feature("t", ("f", "g", "h"))).select("tuple").distinct().count() == 24


@pytest.mark.parametrize("how,want", [("UNIT_WEIGHTED", 0.375), ("REGRESSION_WEIGHTED", 1.5), ("MAX", 0.7)])
def test_combined_scores(spark, how, want):
    c = model.combine([F.lit(x) for x in (0.1, 0.7, 0.2, 0.5)], how, 4)
    assert abs(spark.range(1).select(c.alias("s")).first().s - want) < 1e-9


def test_schemas():
    old, new = Field("x"), Field("x", "singleTermIndexLatest")
    assert not new.additive(old) and not old.additive(new) and old.additive(old)
    assert Field("x", "singleTermIndexValueBits").additive(old) and old.additive(Field("x", "singleTermIndexValueBits")) and Field("x", "nonIndexedNonStored").additive(new)
    assert Field("x", "singleTermNonStored").additive(old) and Field("x", "multiTermNonStored").additive(Field("x", "multiTerm")) and not Field("x", "multiTerm").additive(Field("x", "multiTermNonStored"))
    with pytest.raises(ValueError):
        Field("x", "nosuch")


def test_plugins(colours):
    plugins.register_plugin("how_many", lambda s: s.df.agg(F.count("*").alias("n")), lambda parts: parts[0].union(parts[1]).agg(F.sum("n").alias("n")))
    assert plugins.ask("how_many", [colours, colours]).first().n == 20 and "how_many" in plugins.names()


def test_copy_begins_at_the_first_later_activity(spark):
    log = spark.createDataFrame([("t", 3, 0), ("t", 12, 1), ("t", 5, 2), ("t", 13, 3), ("x", 99, 4)], "tenant string, time bigint, seq bigint")
    assert [(r.tenant, r.time) for r in changelog.copy(log, "t", "u", start=10).orderBy("seq").collect()] == [("u", 12), ("u", 5), ("u", 13)]
    assert [r.time for r in changelog.copy(log, "t", "u", start=10, reverse=True).collect()] == [3]
    assert [r.time for r in changelog.copy(log, "t", "u", start=10, step=(0, 30)).orderBy("seq").collect()] == [0, 10, 20]
    assert changelog.copy(log, "t", "u", start=100).count() == 0


def test_rows_of_many_values(spark):
    df = spark.createDataFrame([(0, ["x", "y"]), (1, ["y"]), (2, ["y", "x", "y"])], "id bigint, v array<string>")
    s = make_stream(df, Schema("s", 1, (Field("v", "multiTerm"),)), "id", F.col("id"), {"v": F.col("v")})
    assert {r.value: r.n for r in counts.aggregate_counts(s, {"a": Constraint("v")}).collect()} == {"x": 2, "y": 3}
    assert counts.distinct_count(s, "v").first().n == 2
    first = mark_first(make_stream(df, Schema("s", 1, (Field("v", "multiTermIndexFirst"),)), "id", F.col("id"), {"v": F.col("v")}), "v")
    assert [r.id for r in first.df.filter(build(all_of(term("v", "y")), first)).collect()] == [0]


def test_peaks_percentile(spark):
    from tidewire.operators.waves import _ranks

    w = spark.createDataFrame([(str(k), [0, k, 0]) for k in range(1, 8)], "value string, waveform array<bigint>")
    for share, want in ((0.0095, 1.0), (0.5, 4.0), (0.3, 2.4), (0.99, 7.0)):
        plan = _ranks(w, ("PEAKS",), share)
        assert plan.count() == 7
        n, at = 7, share * 8
        x = [None, *range(1, 8)]
        assert abs(want - (1 if at < 1 else 7 if at >= n else x[int(at)] + (at - int(at)) * (x[int(at) + 1] - x[int(at)]))) < 1e-9


def test_sums_stop_at_the_ends(spark):
    big = (1 << 63) - 1
    df = spark.createDataFrame([(1, 1, big), (2, 2, big)], "id bigint, t bigint, x bigint")
    s = make_stream(df, Schema("s", 1, ()), "id", F.col("t"), {}, properties={"x": F.col("x")})
    assert waves.metrics(s, "p_x", {"a": MATCH_ALL}, (0, 10), 1).first()["sum"] == big


def test_wide_prefixes_lose_nothing(spark):
    from tidewire.operators.search import full_text

    df = spark.range(1500).select("id", F.array(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("v"))
    s = make_stream(df, Schema("s", 1, (Field("v", "multiTermCardinality", prefix="wildcard"),)), "id", F.col("id"), {"v": F.col("v")})
    for how in ("TIME", "TF_IDF"):
        for cap in (None, 0):
            rows, found = full_text(s, "w*", "v", None, how, max_wildcards=cap)
            assert rows.count() == found.first().found == 1500
    assert full_text(s, "w*", "v", None, "TF_IDF", max_wildcards=10)[1].first().found == 10
