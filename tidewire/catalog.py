"""Every query on the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import log_terms
from .functions.waves import pack_order_id, ring, unpack_order_id
from .operators import counts, model, reco, search, tracking, waves
from .operators.counts import Constraint
from .operators.model import Feature
from .plans.filters import MATCH_ALL, Filter, all_of, any_of, but_not, parse_filters, term
from .plans.stream import mark_latest, monotonic_time, newest_per_value
from .sources import changelog, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOW, HIGH = 1704067200000000, 1706659200000000
DAY = 86_400_000_000
TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}'']+'), lambda x: x <> '')"
E = "e AS (SELECT event_id AS id, epoch_us(ts) AS t, user_id::VARCHAR AS u, event_type AS ty, hour(ts)::VARCHAR AS h, floor(value)::BIGINT AS v, (floor(value / 50)::BIGINT)::VARCHAR || ' ' || event_type AS lv, event_id % 97 = 5 AS removed FROM events)"
D = f"d AS (SELECT doc_id AS id, doc_id * 1000 AS t, {TOKENS} AS w, lang, source FROM documents)"
O = "o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS t, o_custkey::VARCHAR AS c, o_orderpriority AS p FROM orders), op AS (SELECT DISTINCT o_orderkey AS id, o_custkey::VARCHAR AS c, l_partkey::VARCHAR AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# -- filters ----------------------------------------------------------------

def _filter(name: str, flt, where: str, authz=None) -> None:
    @query(name, f"WITH {E} SELECT id, t AS time, u AS user, ty AS type FROM e WHERE NOT removed AND {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .plans.filters import build

        s = tables.events(spark, sf_dir).visible(authz)
        return s.df.filter(build(flt, s)).select("id", "time", F.col("f_user").alias("user"), F.col("f_type").alias("type"))


_filter("filter_and", all_of(term("type", "click", "view"), term("user", "1", "2", "3")), "ty IN ('click', 'view') AND u IN ('1', '2', '3')")
_filter("filter_or", any_of(term("type", "signup"), term("user", "7")), "(ty = 'signup' OR u = '7')")
_filter("filter_p_but_not_q", but_not(term("type", "click"), term("user", "1", "2"), term("hour", "3")), "ty = 'click' AND u NOT IN ('1', '2') AND h <> '3'")
_filter("filter_inclusive_not", but_not(term("type", "click"), inclusive=True), "ty <> 'click'")
_filter("filter_nested", all_of(term("type", "error", "view"), any_of(term("user", "5"), all_of(term("hour", "1", "2"), term("type", "error")))), "ty IN ('error', 'view') AND (u = '5' OR (h IN ('1', '2') AND ty = 'error'))")
_filter("filter_wildcard", all_of(term("type", ("s", "*"), ("cl", "*"))), "(ty LIKE 's%' OR ty LIKE 'cl%')")
_filter("filter_composite", all_of(term("userType", ("12", "purchase"), ("13", "*"))), "((u = '12' AND ty = 'purchase') OR u = '13' OR starts_with(u, '13'))")
_filter("filter_typed_prefix", all_of(term("level", ("1", "*"))), "lv LIKE '1 %'")
_filter("filter_authz", MATCH_ALL, "ty IN ('view', 'error')", ["view", "error"])
_filter("filter_dsl", parse_filters("type:click|view, user:9"), "ty IN ('click', 'view') AND u = '9'")
_filter("filter_empty_and", Filter("and", (term("type"), term("user", "1"))), "false")
_filter("filter_unknown_field", all_of(term("nosuch", "1"), term("user", "4")), "u = '4'")


@query("filter_latest", f"WITH {E}, l AS (SELECT u, max(id) AS id FROM e GROUP BY u) SELECT e.id FROM e JOIN l USING (id) WHERE e.u IN ('1', '2', '3', '4') AND NOT removed")
def filter_latest(spark, sf_dir):
    from .plans.filters import build

    s = mark_latest(tables.events(spark, sf_dir), "user")
    return s.df.filter(~F.col("removed") & build(all_of(term("user", "1", "2", "3", "4", kind="latest")), s)).select("id")


@query("latest_per_value", f"WITH {E} SELECT u AS value, max(id) AS id, arg_max(t, id) AS time FROM e GROUP BY u")
def latest_per_value(spark, sf_dir):
    return newest_per_value(tables.events(spark, sf_dir), "user")


@query("first_per_value", f"WITH {E} SELECT u AS value, min(id) AS id, arg_min(t, id) AS time FROM e GROUP BY u")
def first_per_value(spark, sf_dir):
    return newest_per_value(tables.events(spark, sf_dir), "user", first=True)


# -- distinct values --------------------------------------------------------

@query("distincts", f"WITH {E} SELECT DISTINCT u AS value FROM e WHERE t > {LOW} AND t <= {LOW + 3 * DAY} AND ty = 'click'")
def distincts(spark, sf_dir):
    return counts.distincts(tables.events(spark, sf_dir), "user", (LOW, LOW + 3 * DAY), all_of(term("type", "click")))


@query("distincts_prefix", f"WITH {D} SELECT DISTINCT x AS value FROM (SELECT unnest(w) AS x FROM d) WHERE x LIKE 'th%' OR x LIKE 'zu%'")
def distincts_prefix(spark, sf_dir):
    return counts.distincts(tables.documents(spark, sf_dir), "text", prefixes=(("th",), ("zu",)))


@query("distincts_parts", f"WITH {E} SELECT DISTINCT ty AS value FROM e WHERE u = '12'")
def distincts_parts(spark, sf_dir):
    return counts.distincts(tables.events(spark, sf_dir), "userType", constraints=all_of(term("user", "12")), parts=(1,))


@query("distincts_restricted", f"WITH {E} SELECT u AS value FROM e WHERE ty = 'click' INTERSECT SELECT u FROM e WHERE h = '1' OR h = '2' INTERSECT SELECT u FROM e WHERE v > -1")
def distincts_restricted(spark, sf_dir):
    groups = [(all_of(term("type", "click")),), (all_of(term("hour", "1")), all_of(term("hour", "2")))]
    return counts.distincts(tables.events(spark, sf_dir), "user", restrict=groups)


@query("uniques", f"WITH {E} SELECT count(DISTINCT u) AS n FROM e WHERE ty = 'error'")
def uniques(spark, sf_dir):
    return counts.uniques(tables.events(spark, sf_dir), "user", constraints=all_of(term("type", "error")))


@query("distinct_count", f"WITH {E} SELECT count(DISTINCT u) AS n FROM e WHERE NOT removed AND t > {LOW} AND t <= {LOW + DAY}")
def distinct_count(spark, sf_dir):
    return counts.distinct_count(tables.events(spark, sf_dir), "user", bounds=(LOW, LOW + DAY))


@query("distinct_count_capped", f"WITH {E} SELECT least(count(DISTINCT u), 21) AS n FROM e WHERE NOT removed AND ty = 'view'")
def distinct_count_capped(spark, sf_dir):
    return counts.distinct_count(tables.events(spark, sf_dir), "user", all_of(term("type", "view")), desired=20)


_AGG = "u AS value, count(*) FILTER ({count}) AS n, max(id) AS lid, arg_max(t, id) AS latest_time, arg_min(t, id) AS oldest_time{more}"


def _agg_sql(where: str, count: str = "true", collect: str = "true", start: int = 0, desired: int = 10, more: str = "", cols: str = "") -> str:
    g = _AGG.format(count=count, more=more)
    return f"WITH {E}, g AS (SELECT {g} FROM e WHERE NOT removed AND {where} GROUP BY u), r AS (SELECT *, row_number() OVER (ORDER BY lid DESC)::INTEGER AS rank FROM g WHERE {collect}) SELECT 'a' AS \"constraint\", rank, value, n, latest_time, oldest_time{cols} FROM r WHERE rank > {start} AND rank <= {start + desired}"


@query("aggregate_counts_multi", f"""WITH {O}, g AS (SELECT op.p AS value, count(*) AS n, max(op.id) AS lid, arg_max(o.t, o.id) AS latest_time, arg_min(o.t, o.id) AS oldest_time FROM op JOIN o ON o.id = op.id GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY lid DESC, value)::INTEGER AS rank FROM g) SELECT 'a' AS "constraint", rank, value, n, latest_time, oldest_time FROM r WHERE rank <= 25""")
def aggregate_counts_multi(spark, sf_dir):
    return counts.aggregate_counts(tables.orders(spark, sf_dir), {"a": Constraint("part", desired=25)})


@query("distinct_count_multi", f"WITH {O} SELECT count(DISTINCT op.p) AS n FROM op JOIN o ON o.id = op.id WHERE o.p = '1-URGENT'")
def distinct_count_multi(spark, sf_dir):
    return counts.distinct_count(tables.orders(spark, sf_dir), "part", all_of(term("priority", "1-URGENT")))


@query("filter_index_first", f"WITH {E} SELECT id, t AS time, u AS user, ty AS type FROM e WHERE NOT removed AND id IN (SELECT min(id) FROM e WHERE u LIKE '1%' OR u = '7' GROUP BY u)")
def filter_index_first(spark, sf_dir):
    from dataclasses import replace

    from .plans.filters import build
    from .plans.stream import mark_first

    s = tables.events(spark, sf_dir)
    fields = tuple(replace(f, type="singleTermIndexFirst", prefix="wildcard") if f.name == "user" else f for f in s.schema.fields)
    s = mark_first(replace(s, schema=replace(s.schema, fields=fields)), "user").visible()
    return s.df.filter(build(all_of(term("user", ("1", "*"), "7")), s)).select("id", "time", F.col("f_user").alias("user"), F.col("f_type").alias("type"))


@query("aggregate_counts", _agg_sql(f"ty IN ('click', 'view') AND t > {LOW} AND t <= {HIGH}", f"t > {LOW + 10 * DAY} AND t <= {LOW + 20 * DAY}"))
def aggregate_counts(spark, sf_dir):
    s = tables.events(spark, sf_dir)
    return counts.aggregate_counts(s, {"a": Constraint("user", all_of(term("type", "click", "view")))}, answer=(LOW, HIGH), count=(LOW + 10 * DAY, LOW + 20 * DAY))


@query("aggregate_counts_paged", _agg_sql("ty = 'purchase'", collect=f"latest_time BETWEEN {LOW + 5 * DAY} AND {LOW + 29 * DAY}", start=20, desired=15))
def aggregate_counts_paged(spark, sf_dir):
    s = tables.events(spark, sf_dir)
    return counts.aggregate_counts(s, {"a": Constraint("user", start=20, desired=15)}, all_of(term("type", "purchase")), collect=(LOW + 5 * DAY, LOW + 29 * DAY))


@query("aggregate_counts_gather", _agg_sql("true", more=", arg_max(ty, id) AS lt, arg_min(ty, id) AS ot", cols=", lt AS latest_type, ot AS oldest_type"))
def aggregate_counts_gather(spark, sf_dir):
    out = counts.aggregate_counts(tables.events(spark, sf_dir), {"a": Constraint("user", gather=("type",))})
    return out.withColumn("latest_type", F.get("latest_type", F.lit(0))).withColumn("oldest_type", F.get("oldest_type", F.lit(0)))


_EVENTS_READ = [("READ", all_of(term("type", "click")), LOW + 20 * DAY), ("MARK_ALL_READ", None, LOW + 5 * DAY), ("UNREAD", all_of(term("user", "3", "4")), LOW + 25 * DAY)]
_UNREAD = f"CASE WHEN u IN ('3', '4') AND t <= {LOW + 25 * DAY} THEN true WHEN t <= {LOW + 5 * DAY} THEN false WHEN ty = 'click' AND t <= {LOW + 20 * DAY} THEN false ELSE NOT (ty = 'error') END"


@query("unread_rows", f"WITH {E} SELECT id FROM e WHERE {_UNREAD}")
def unread_rows(spark, sf_dir):
    return tracking.unread(tables.events(spark, sf_dir), _EVENTS_READ, any_of(term("type", "error")))


@query("aggregate_counts_unread", _agg_sql("true", more=f", bool_or({_UNREAD}) AS au, arg_max({_UNREAD}, id) AS lu, arg_min({_UNREAD}, id) AS ou", cols=", au AS any_unread, lu AS latest_unread, ou AS oldest_unread"))
def aggregate_counts_unread(spark, sf_dir):
    s = tables.events(spark, sf_dir)
    ids = tracking.unread(s, _EVENTS_READ, any_of(term("type", "error")))
    return counts.aggregate_counts(s, {"a": Constraint("user")}, unread=ids, include_unread=True)


@query("aggregate_counts_unread_only", _agg_sql(f"ty = 'view' AND {_UNREAD}"))
def aggregate_counts_unread_only(spark, sf_dir):
    s = tables.events(spark, sf_dir)
    ids = tracking.unread(s, _EVENTS_READ, any_of(term("type", "error")))
    return counts.aggregate_counts(s, {"a": Constraint("user")}, all_of(term("type", "view")), unread=ids, unread_only=True)


@query("inbox_counts", _agg_sql("ty IN ('view', 'signup')", count=f"({_UNREAD.replace('ELSE NOT (ty = ' + chr(39) + 'error' + chr(39) + ')', 'ELSE true')})"))
def inbox_counts(spark, sf_dir):
    s = tables.events(spark, sf_dir)
    mine = all_of(term("type", "view", "signup"))
    return counts.aggregate_counts(s, {"a": Constraint("user")}, inbox=tracking.inbox(s, mine), unread=tracking.inbox_unread(s, mine, "s", _EVENTS_READ))


@query("inbox_distinct_count", f"WITH {E} SELECT least(count(DISTINCT u), 1001) AS n FROM e WHERE NOT removed AND ty = 'view' AND h = '4'")
def inbox_distinct_count(spark, sf_dir):
    s = tables.events(spark, sf_dir)
    return counts.distinct_count(s, "user", all_of(term("hour", "4")), inbox=tracking.inbox(s, all_of(term("type", "view"))), desired=1000)


@query("read_events_replayed", f"""WITH {E}, r(stream_id, seq, til, op, k) AS (VALUES ('a', 1, {LOW + 20 * DAY}, 'READ', 'c'), ('a', 2, {LOW + 22 * DAY}, 'UNREAD', 'v'), ('a', 3, {LOW + 3 * DAY}, 'MARK_ALL_READ', NULL), ('b', 1, {HIGH}, 'READ', 'v'), ('c', 1, {LOW + DAY}, 'MARK_ALL_READ', NULL)),
x AS (SELECT stream_id, id, t, arg_max(op, seq) AS op, max(seq) AS seq FROM r JOIN e ON t <= til AND ((k = 'c' AND ty = 'click') OR (k = 'v' AND u IN ('1', '2', '3'))) GROUP BY ALL)
SELECT stream_id, id, op = 'UNREAD' AND NOT EXISTS (SELECT 1 FROM r WHERE r.stream_id = x.stream_id AND r.op = 'MARK_ALL_READ' AND r.seq > x.seq AND r.til >= x.t) AS unread FROM x
UNION ALL SELECT stream_id, id, false FROM (SELECT stream_id, max(til) AS til FROM r WHERE op = 'MARK_ALL_READ' GROUP BY 1) m JOIN e ON t <= til WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.stream_id = m.stream_id AND x.id = e.id)""")
def read_events_replayed(spark, sf_dir):
    rows = [("a", 1, LOW + 20 * DAY, "READ", "c"), ("a", 2, LOW + 22 * DAY, "UNREAD", "v"), ("a", 3, LOW + 3 * DAY, "MARK_ALL_READ", None), ("b", 1, HIGH, "READ", "v"), ("c", 1, LOW + DAY, "MARK_ALL_READ", None)]
    readers = spark.createDataFrame(rows, "stream_id string, seq bigint, time bigint, op string, filter string")
    return tracking.replay(readers, tables.events(spark, sf_dir), {"c": all_of(term("type", "click")), "v": all_of(term("user", "1", "2", "3"))})


# -- waves ------------------------------------------------------------------

_NAMED = {"clicks": all_of(term("type", "click")), "one": all_of(term("user", "1", "2")), "none": all_of(term("user", "nobody"))}
_KEYS = "k(key) AS (VALUES ('clicks'), ('one'), ('none')), m AS (SELECT 'clicks' AS key, * FROM e WHERE ty = 'click' UNION ALL SELECT 'one', * FROM e WHERE u IN ('1', '2'))"


def _bucket(low: int, high: int, n: int) -> str:
    d = (high - low) // n
    return f"CASE WHEN t > {low} AND t < {low + n * d} THEN ((t - {low}) // {d})::INTEGER END"


def _wave_sql(name: str, low: int, high: int, n: int) -> str:
    return f"SELECT '{name}' AS score_set, key, b::INTEGER AS bucket, (SELECT count(*) FROM m WHERE NOT removed AND m.key = k.key AND {_bucket(low, high, n)} = b) AS n FROM k, range({n}) AS r(b)"


@query("analytics_waveform", f"WITH {E}, {_KEYS} {_wave_sql('all', LOW, HIGH, 32)}")
def analytics_waveform(spark, sf_dir):
    return waves.analytics(tables.events(spark, sf_dir), _NAMED, {"all": ((LOW, HIGH), 32)})


@query("analytics_multi_score_set", f"WITH {E}, {_KEYS} {_wave_sql('week', LOW + 7 * DAY, LOW + 14 * DAY, 7)} UNION ALL {_wave_sql('tail', LOW + 20 * DAY, HIGH, 11)}")
def analytics_multi_score_set(spark, sf_dir):
    return waves.analytics(tables.events(spark, sf_dir), _NAMED, {"week": ((LOW + 7 * DAY, LOW + 14 * DAY), 7), "tail": ((LOW + 20 * DAY, HIGH), 11)})


@query("metrics_avg", f"""WITH {E}, {_KEYS}, g AS (SELECT key, {_bucket(LOW, HIGH, 24)} AS b, count(*) AS n, sum(v)::BIGINT AS s, min(v) AS lo, max(v) AS hi FROM m WHERE NOT removed AND t > {LOW} AND t <= {HIGH} GROUP BY 1, 2)
SELECT k.key, r.b::INTEGER AS bucket, coalesce(n, 0) AS n, coalesce(s, 0) AS sum, coalesce(s // n, 0) AS avg, lo AS min, hi AS max FROM k CROSS JOIN range(24) AS r(b) LEFT JOIN g ON g.key = k.key AND g.b = r.b""")
def metrics_avg(spark, sf_dir):
    return waves.metrics(tables.events(spark, sf_dir), "p_value", _NAMED, (LOW, HIGH), 24)


def _anomaly_sql(m: str, value: str, n: int) -> str:
    return f"""{m}, g AS (SELECT key, {_bucket(LOW, HIGH, n)} AS b, (sum(CASE WHEN {value} > 0 THEN {value} ELSE 0 END) // count(*))::BIGINT AS p, (sum(CASE WHEN {value} < 0 THEN -({value}) ELSE 0 END) // count(*))::BIGINT AS q FROM m WHERE NOT removed AND t > {LOW} AND t <= {HIGH} GROUP BY 1, 2 HAVING b IS NOT NULL),
f AS (SELECT k.key, r.b, p, q FROM (SELECT DISTINCT key FROM g) k CROSS JOIN range({n}) AS r(b) LEFT JOIN g ON g.key = k.key AND g.b = r.b),
w AS (SELECT *, last_value(p IGNORE NULLS) OVER a AS p0, last_value(q IGNORE NULLS) OVER a AS q0, last_value(CASE WHEN p IS NOT NULL THEN b END IGNORE NULLS) OVER a AS b0,
 first_value(p IGNORE NULLS) OVER z AS p1, first_value(q IGNORE NULLS) OVER z AS q1, first_value(CASE WHEN p IS NOT NULL THEN b END IGNORE NULLS) OVER z AS b1
 FROM f WINDOW a AS (PARTITION BY key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY key ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT key, b::INTEGER AS bucket, (CASE WHEN p IS NOT NULL THEN p WHEN p0 IS NULL THEN p1 WHEN p1 IS NULL THEN p0 ELSE p0 + trunc((p1 - p0) * (b - b0)::DOUBLE / (b1 - b0))::BIGINT END)
 - (CASE WHEN q IS NOT NULL THEN q WHEN q0 IS NULL THEN q1 WHEN q1 IS NULL THEN q0 ELSE q0 + trunc((q1 - q0) * (b - b0)::DOUBLE / (b1 - b0))::BIGINT END) AS value FROM w"""


@query("anomaly_avg", f"WITH {E}, " + _anomaly_sql(_KEYS, "(v - 40)", 16))
def anomaly_avg(spark, sf_dir):
    s = tables.events(spark, sf_dir)
    from .plans.stream import Stream

    s = Stream(s.df.withColumn("signed", F.col("p_value") - 40), s.schema)
    return waves.anomaly(s, "signed", _NAMED, (LOW, HIGH), 16)


_ONE = "m AS (SELECT 'x' AS key, * FROM e WHERE u = '17' AND ty = 'click')"


@query("anomaly_interpolated", f"WITH {E}, " + _anomaly_sql(_ONE, "v", 60))
def anomaly_interpolated(spark, sf_dir):
    return waves.anomaly(tables.events(spark, sf_dir), "p_value", {"x": all_of(term("user", "17"), term("type", "click"))}, (LOW, HIGH), 60)


@query("anomaly_expansion", f"WITH {E}, " + _anomaly_sql("m AS (SELECT 'u-' || ty AS key, * FROM e WHERE u IN ('1', '2', '3') AND ty IN ('signup', 'view'))", "v", 10))
def anomaly_expansion(spark, sf_dir):
    return waves.anomaly(tables.events(spark, sf_dir), "p_value", {"u": all_of(term("user", "1", "2", "3"))}, (LOW, HIGH), 10, expansion=("type", ["s*", "view"]))


@query("log_search_latest", f"WITH {E}, {_KEYS} SELECT key, rank, id, time, 0::BIGINT AS version FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY id DESC)::INTEGER AS rank, id, t AS time FROM m WHERE NOT removed AND t > {LOW} AND t <= {HIGH - DAY}) WHERE rank <= 7")
def log_search_latest(spark, sf_dir):
    return waves.newest_matches(tables.events(spark, sf_dir), _NAMED, (LOW, HIGH - DAY), 7)


def _trend_base(low: int, high: int, n: int, name: str = "w") -> str:
    return f"{name}b AS (SELECT u AS value, {_bucket(low, high, n)} AS b, count(*) AS n FROM e WHERE NOT removed AND t > {low} AND t <= {high} GROUP BY 1, 2 HAVING b IS NOT NULL), {name} AS (SELECT value, list(coalesce(n, 0) ORDER BY r.b) AS wave FROM (SELECT DISTINCT value FROM {name}b) JOIN range({n}) AS r(b) ON true LEFT JOIN {name}b USING (value, b) GROUP BY 1)"


_SLOPE = "list_sum(list_transform(range(0, {n}), lambda i: (i / ({n} - 1.0) - 0.5) * (wave[i + 1] - list_avg(wave)))) / {xx}"


def _slope(n: int) -> str:
    xx = sum((i / (n - 1) - 0.5) ** 2 for i in range(n))
    return _SLOPE.format(n=n, xx=repr(xx))


def _trend_sql(score: str, strategy: str, k: int = 10, source: str = "w", name: str = "s") -> str:
    return f"SELECT '{name}' AS score_set, '{strategy}' AS strategy, row_number() OVER (ORDER BY score DESC NULLS LAST, value)::INTEGER AS rank, value, score FROM (SELECT value, round(({score})::DOUBLE, 6) AS score FROM {source}) QUALIFY rank <= {k}"


def _trending(name: str, strategy: str, score: str | None) -> None:
    @query(name, None if score is None else f"WITH {E}, {_trend_base(LOW, HIGH, 20)} {_trend_sql(score, strategy)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = waves.trending(tables.events(spark, sf_dir), "user", [("s", (strategy,), (LOW, HIGH), 20, 10)])
        return out.withColumn("score", F.round("score", 6))


_trending("trending_leader", "LEADER", "list_sum(wave)")
_trending("trending_highest_peak", "HIGHEST_PEAK", "list_max(wave)")
_trending("trending_slope", "LINEAR_REGRESSION", _slope(20))
_PEAK = """list_reduce(list_prepend({{'mn': 'inf'::DOUBLE, 'mx': '-inf'::DOUBLE, 'up': true, 'n': 0, 'x': 0.0::DOUBLE}}, list_transform(wave, lambda x: {{'mn': 0.0::DOUBLE, 'mx': 0.0::DOUBLE, 'up': true, 'n': 0, 'x': x::DOUBLE}})),
 lambda s, c: {{'mn': CASE WHEN s.up AND c.x < greatest(s.mx, c.x) - delta THEN c.x ELSE least(s.mn, c.x) END, 'mx': CASE WHEN NOT s.up AND c.x > least(s.mn, c.x) + delta THEN c.x ELSE greatest(s.mx, c.x) END,
 'up': CASE WHEN s.up AND c.x < greatest(s.mx, c.x) - delta THEN false WHEN NOT s.up AND c.x > least(s.mn, c.x) + delta THEN true ELSE s.up END, 'n': s.n + CASE WHEN s.up AND c.x < greatest(s.mx, c.x) - delta THEN 1 ELSE 0 END, 'x': c.x}}).n""".replace("{{", "{").replace("}}", "}")


@query("trending_peaks", f"""WITH {E}, {_trend_base(LOW, HIGH, 20)}, xs AS (SELECT list_sort(list(list_max(wave)::DOUBLE)) AS x, count(*) AS n, 0.0095::DOUBLE * (count(*) + 1) AS pos FROM w),
pc AS (SELECT CASE WHEN pos < 1 THEN x[1] WHEN pos >= n THEN x[n] ELSE x[floor(pos)::BIGINT] + (pos - floor(pos)) * (x[floor(pos)::BIGINT + 1] - x[floor(pos)::BIGINT]) END AS p FROM xs),
dl AS (SELECT *, list_max(wave) / 6.0 + (SELECT p FROM pc) / 100.0 AS delta FROM w) {_trend_sql(_PEAK, 'PEAKS', source='dl')}""")
def trending_peaks(spark, sf_dir):
    return waves.trending(tables.events(spark, sf_dir), "user", [("s", ("PEAKS",), (LOW, HIGH), 20, 10)]).withColumn("score", F.round("score", 6))


@query("trending_score_set_exclusion", f"""WITH {E}, {_trend_base(LOW, LOW + 15 * DAY, 10)}, {_trend_base(LOW + 15 * DAY, HIGH, 10, 'y')},
a AS ({_trend_sql('list_sum(wave)', 'LEADER', 5, name='first')}), z AS (SELECT * FROM y WHERE value NOT IN (SELECT value FROM a))
SELECT * FROM a UNION ALL ({_trend_sql('list_sum(wave)', 'LEADER', 5, 'z', 'second')})""")
def trending_score_set_exclusion(spark, sf_dir):
    sets = [("first", ("LEADER",), (LOW, LOW + 15 * DAY), 10, 5), ("second", ("LEADER",), (LOW + 15 * DAY, HIGH), 10, 5)]
    return waves.trending(tables.events(spark, sf_dir), "user", sets).withColumn("score", F.round("score", 6))


_LIVE = ((HIGH // DAY) + 1) * DAY


@query("live_waves", f"WITH {E}, k(u, ty) AS (SELECT u, ty FROM (VALUES ('1'), ('2')) a(u), (VALUES ('click'), ('view')) b(ty)) SELECT u || '/' || ty AS key, b::INTEGER AS bucket, (SELECT count(*) FROM e WHERE NOT removed AND e.u = k.u AND e.ty = k.ty AND {_bucket(_LIVE - 12 * DAY, _LIVE, 12)} = b) AS n FROM k, range(12) AS r(b)")
def live_waves(spark, sf_dir):
    return waves.live_waves(tables.events(spark, sf_dir), "user", ["1", "2"], "type", ["click", "view"], DAY, 12, HIGH)


@query("ring_buckets", f"WITH {E}, h AS (SELECT u, t // {DAY} AS b, count(*) AS n FROM e GROUP BY 1, 2), x AS (SELECT u, max(b) AS top FROM h GROUP BY 1) SELECT u AS f_user, x.top - 4 + i AS bucket, coalesce(n, 0) AS n FROM x JOIN range(5) AS r(i) ON true LEFT JOIN h USING (u) WHERE false UNION ALL SELECT x.u, x.top - 4 + i, coalesce((SELECT n FROM h WHERE h.u = x.u AND h.b = x.top - 4 + i), 0) FROM x, range(5) AS r(i)")
def ring_buckets(spark, sf_dir):
    return ring(tables.events(spark, sf_dir).df, ["f_user"], "time", DAY, 5)


# -- recommendations, search, models ----------------------------------------

_MINE = all_of(term("customer", "1", "2", "3", "4", "5"))
_RECO = """ok AS (SELECT * FROM op), mine AS (SELECT * FROM ok WHERE c IN ('1', '2', '3', '4', '5')), pa AS (SELECT DISTINCT p FROM mine),
co AS (SELECT c, count(DISTINCT id) AS n FROM ok WHERE c NOT IN ('1', '2', '3', '4', '5') AND p IN (SELECT p FROM pa) GROUP BY 1 ORDER BY n DESC, c LIMIT 25),
sc AS (SELECT p, sum(n)::BIGINT AS score FROM (SELECT DISTINCT c, p FROM ok) JOIN co USING (c) WHERE p NOT IN (SELECT p FROM pa){more} GROUP BY 1)
SELECT p AS value, score FROM sc ORDER BY score DESC, p LIMIT 25"""


@query("reco_collaborative", f"WITH {O}, " + _RECO.format(more=""))
def reco_collaborative(spark, sf_dir):
    return reco.recommend(tables.orders(spark, sf_dir), _MINE, "part", "customer", "part", 25)


@query("reco_remove_distincts", f"WITH {O}, " + _RECO.format(more=" AND p NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size < 25)"))
def reco_remove_distincts(spark, sf_dir):
    gone = tables.load(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("value"))
    return reco.recommend(tables.orders(spark, sf_dir), _MINE, "part", "customer", "part", 25, remove=gone)


@query("reco_contributors", f"WITH {O}, mine AS (SELECT * FROM op WHERE c IN ('1', '2', '3', '4', '5')) SELECT c AS value, count(DISTINCT id) AS score FROM op WHERE c NOT IN ('1', '2', '3', '4', '5') AND p IN (SELECT p FROM mine) GROUP BY 1 ORDER BY score DESC, c LIMIT 20")
def reco_contributors(spark, sf_dir):
    return reco.recommend(tables.orders(spark, sf_dir), _MINE, "part", "customer", "customer", 20)



_FOUND = "list_contains(w, 'the') AND (list_contains(w, 'edited') OR list_contains(w, 'thing') OR list_contains(w, 'edst')) AND NOT list_contains(w, 'scum')"


@query("fulltext_time", f"WITH {D} SELECT id, t AS time, 0.0::DOUBLE AS score FROM d WHERE {_FOUND} ORDER BY id DESC LIMIT 30")
def fulltext_time(spark, sf_dir):
    return search.full_text(tables.documents(spark, sf_dir), "the AND (edited OR thing OR edst) NOT scum", "text", 30)[0]


@query("fulltext_found", f"WITH {D} SELECT count(*) AS found FROM d WHERE {_FOUND}")
def fulltext_found(spark, sf_dir):
    return search.full_text(tables.documents(spark, sf_dir), "the AND (edited OR thing OR edst) NOT scum", "text", 30)[1]


_TF = " + ".join(f"coalesce(({n}.0 / nullif((SELECT sum(len(list_filter(w, lambda x: x = '{x}'))) FROM d), 0)) * len(list_filter(w, lambda x: x = '{x}')), 0)" for x, n in (("the", 1), ("edited", 1), ("thing", 1), ("edst", 1), ("scum", -1)))


@query("fulltext_tfidf", f"WITH {D} SELECT id, time, score FROM (SELECT id, t AS time, round({_TF}, 9) AS score FROM d WHERE {_FOUND}) ORDER BY score DESC, id DESC LIMIT 30")
def fulltext_tfidf(spark, sf_dir):
    out = search.full_text(tables.documents(spark, sf_dir), "the AND (edited OR thing OR edst) NOT scum", "text", None, "TF_IDF")[0]
    return out.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), F.desc("id")).limit(30)


@query("fulltext_tfidf_prefix", f"""WITH {D}, x AS (SELECT id, lang, unnest(w) AS term FROM d), cf AS (SELECT term, count(*) AS c FROM x WHERE starts_with(term, 'a') GROUP BY 1),
sc AS (SELECT id, sum(1.0::DOUBLE / c) AS score FROM x JOIN cf USING (term) WHERE lang = 'en' GROUP BY 1) SELECT id, id * 1000 AS time, round(score, 9) AS score FROM sc ORDER BY 3 DESC, id DESC LIMIT 40""")
def fulltext_tfidf_prefix(spark, sf_dir):
    out = search.full_text(tables.documents(spark, sf_dir), "a* AND lang:en", "text", None, "TF_IDF")[0]
    return out.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), F.desc("id")).limit(40)


@query("fulltext_wildcard", f"WITH {D} SELECT id, t AS time, 0.0::DOUBLE AS score FROM d WHERE len(list_filter(w, lambda x: starts_with(x, 'disg'))) > 0 AND lang = 'en' ORDER BY id DESC LIMIT 50")
def fulltext_wildcard(spark, sf_dir):
    return search.full_text(tables.documents(spark, sf_dir), "disg* AND lang:en", "text", 50)[0]


_FEATURES = [Feature("type", ("type",)), Feature("typeHour", ("type", "hour"), all_of(term("type", "click", "error", "purchase")))]
_MODELS = [all_of(term("type", "purchase")), all_of(term("hour", "9", "10"))]
_TRAIN = f"""v AS (SELECT * FROM e WHERE NOT removed), i AS (SELECT * FROM v WHERE t > {LOW} AND t <= {LOW + 20 * DAY}),
a0 AS (SELECT u, count(*) AS c FROM i WHERE ty = 'purchase' GROUP BY 1 ORDER BY c DESC, u LIMIT 20), a1 AS (SELECT u, count(*) AS c FROM i WHERE h IN ('9', '10') GROUP BY 1 ORDER BY c DESC, u LIMIT 20),
tu AS (SELECT 'type' AS feature, ty AS tuple, u, id FROM v UNION ALL SELECT 'typeHour', ty || chr(31) || h, u, id FROM v WHERE ty IN ('click', 'error', 'purchase')),
g AS (SELECT u, feature, tuple, count(*) AS n, max(id) AS latest FROM tu WHERE u IN (SELECT u FROM a0 UNION SELECT u FROM a1) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY u, feature ORDER BY n DESC, latest DESC, tuple) <= 8),
nu AS (SELECT feature, tuple, coalesce(sum(n) FILTER (u IN (SELECT u FROM a0)), 0)::BIGINT AS n0, coalesce(sum(n) FILTER (u IN (SELECT u FROM a1)), 0)::BIGINT AS n1 FROM g GROUP BY 1, 2),
mo AS (SELECT feature, tuple, n0, n1, (SELECT count(*) FROM tu WHERE tu.feature = nu.feature AND tu.tuple = nu.tuple) AS denominator FROM nu)"""


def _model(s):
    return model.train(s, "user", _FEATURES, _MODELS, (LOW, LOW + 20 * DAY), top_terms=20, top_tuples=8)


@query("model_train", f"WITH {E}, {_TRAIN} SELECT feature, replace(tuple, chr(31), '/') AS tuple, n0, n1, denominator FROM mo")
def model_train(spark, sf_dir):
    m = _model(tables.events(spark, sf_dir))
    return m.select("feature", F.translate("tuple", "\x1f", "/").alias("tuple"), F.get("numerators", F.lit(0)).alias("n0"), F.get("numerators", F.lit(1)).alias("n1"), "denominator")


@query("model_pruned", f"WITH {E}, {_TRAIN} SELECT feature, replace(tuple, chr(31), '/') AS tuple, n0, n1, denominator FROM mo WHERE greatest(n0, n1) / denominator > 0.05 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY greatest(n0, n1) / denominator DESC, denominator DESC, tuple) <= 12")
def model_pruned(spark, sf_dir):
    m = model.prune(_model(tables.events(spark, sf_dir)), 0.05, 12)
    return m.select("feature", F.translate("tuple", "\x1f", "/").alias("tuple"), F.get("numerators", F.lit(0)).alias("n0"), F.get("numerators", F.lit(1)).alias("n1"), "denominator")


@query("model_merged", f"WITH {E}, {_TRAIN} SELECT feature, replace(tuple, chr(31), '/') AS tuple, 2 * n0 AS n0, 2 * n1 AS n1, (2 * denominator * 5) // 2 AS denominator, 2 AS partitions FROM mo")
def model_merged(spark, sf_dir):
    m = _model(tables.events(spark, sf_dir))
    m = model.deflate(model.merge([m, m]), 5)
    return m.select("feature", F.translate("tuple", "\x1f", "/").alias("tuple"), F.get("numerators", F.lit(0)).alias("n0"), F.get("numerators", F.lit(1)).alias("n1"), "denominator", "partitions")


def _scored(name: str, strategy: str, agg: str) -> None:
    sql = f"""WITH {E}, {_TRAIN}, ca AS (SELECT * FROM v WHERE t > {LOW + 20 * DAY} AND t <= {HIGH}), ct AS (SELECT DISTINCT tu.u, tu.feature, tu.tuple FROM tu JOIN ca USING (id)),
b AS (SELECT ct.u, feature, max(least(n0::FLOAT / denominator::FLOAT, 1::FLOAT)::DOUBLE) AS s0, max(least(n1::FLOAT / denominator::FLOAT, 1::FLOAT)::DOUBLE) AS s1 FROM ct JOIN mo USING (feature, tuple) GROUP BY 1, 2),
c AS (SELECT u, {agg.format('s0')} AS s0, {agg.format('s1')} AS s1 FROM b GROUP BY 1), f AS (SELECT u, count(*) AS n, max(id) AS latest_id, arg_max(t, id) AS latest_time FROM ca GROUP BY 1)
SELECT value, score, n, latest_time, latest_id FROM (SELECT u AS value, round(CASE WHEN (s0 + s1 * 0.5) > 0.0001 THEN s0 + s1 * 0.5 ELSE 0 END, 6) AS score, n, latest_time, latest_id FROM f LEFT JOIN c USING (u)) ORDER BY score DESC, latest_id DESC, value LIMIT 20"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = tables.events(spark, sf_dir)
        out = model.score(s, [(_model(s), 1.0)], "user", _FEATURES, None, bounds=(LOW + 20 * DAY, HIGH), numerator_scalars=(1.0, 0.5), strategy=strategy, numerator_strategy="REGRESSION_WEIGHTED")
        return out.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), F.desc("latest_id"), "value").limit(20)


_scored("score_unit", "UNIT_WEIGHTED", "sum({0}) / 2")
_scored("score_regression", "REGRESSION_WEIGHTED", "sum({0})")
_scored("score_max", "MAX", "max({0})")


# -- ingest -----------------------------------------------------------------

_LOG = "l AS (SELECT user_id::VARCHAR AS tenant, event_id % 40 AS time, (event_id * 7) % 11 AS version, CASE WHEN event_id % 13 = 0 THEN 'REMOVE' ELSE 'ADD' END AS op, event_id AS seq, event_type AS payload FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 13 == 0, "REMOVE").otherwise("ADD")
    return e.select(F.col("user_id").cast("string").alias("tenant"), (F.col("event_id") % 40).alias("time"), ((F.col("event_id") * 7) % 11).alias("version"), op.alias("op"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))


@query("upsert_latest_version", f"WITH {_LOG}, n AS (SELECT tenant, time, version * 1000000 + seq % 1000000 AS v, op, payload FROM l) SELECT tenant, time, max(v) AS v, arg_max(op, v) AS op, arg_max(payload, v) AS payload FROM n GROUP BY 1, 2")
def upsert_latest_version(spark, sf_dir):
    log = _log(spark, sf_dir).select("tenant", "time", (F.col("version") * 1000000 + F.col("seq") % 1000000).alias("v"), "op", "payload")
    return changelog.upsert(log, ["tenant", "time"], "v")


@query("versions_and_removal", f"""WITH RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY tenant, time ORDER BY seq) AS i FROM l),
s AS (SELECT tenant, time, 0::BIGINT AS i, -1::BIGINT AS version, false AS removed, false AS known, NULL::VARCHAR AS payload FROM (SELECT DISTINCT tenant, time FROM l)
 UNION ALL SELECT tenant, time, o.i, CASE WHEN a OR r THEN o.version ELSE s.version END, CASE WHEN r THEN true WHEN a THEN false ELSE s.removed END, s.known OR a, CASE WHEN a THEN o.payload ELSE s.payload END
 FROM s JOIN o USING (tenant, time), LATERAL (SELECT o.op = 'ADD' AND (NOT s.known OR o.version > s.version) AND NOT s.removed AS a, o.op = 'REMOVE' AND s.known AND o.version > s.version AS r) WHERE o.i = s.i + 1)
SELECT tenant, time, version, removed, payload FROM s WHERE known QUALIFY row_number() OVER (PARTITION BY tenant, time ORDER BY i DESC) = 1""")
def versions_and_removal(spark, sf_dir):
    return changelog.resolve(_log(spark, sf_dir), ["payload"])


@query("monotonic_time", "WITH x AS (SELECT event_id AS id, epoch_us(ts) // 60000000 - (event_id * 37) % 500 AS t FROM events) SELECT id, t, id + max(t - id) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS mono_ts FROM x")
def monotonic(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events")
    t = F.expr("unix_micros(cast(ts as timestamp)) div 60000000") - (F.col("event_id") * 37) % 500
    return monotonic_time(e.select(F.col("event_id").alias("id"), t.alias("t")), "id", "t", block=1 << 10)


@query("sync_copy", f"WITH {_LOG} SELECT 'copy' AS tenant, time + 1000 AS time, version, op, seq, payload FROM l WHERE tenant = '8' AND seq >= (SELECT min(seq) FROM l WHERE tenant = '8' AND time > 10)")
def sync_copy(spark, sf_dir):
    return changelog.copy(_log(spark, sf_dir), "8", "copy", start=10, shift=1000)


@query("sync_copy_before", f"WITH {_LOG} SELECT 'copy' AS tenant, time, version, op, seq, payload FROM l WHERE tenant = '8' AND seq < coalesce((SELECT min(seq) FROM l WHERE tenant = '8' AND time > 36), 9223372036854775807)")
def sync_copy_before(spark, sf_dir):
    return changelog.copy(_log(spark, sf_dir), "8", "copy", start=36, reverse=True)


@query("sync_copy_stepped", f"""WITH {_LOG}, c AS (SELECT * FROM l WHERE tenant = '8' AND seq >= (SELECT min(seq) FROM l WHERE tenant = '8' AND time > 10)), b AS (SELECT min(seq) AS lo, max(seq) - min(seq) + 1 AS n FROM c)
SELECT 'copy' AS tenant, 5000 + ((seq - lo) * 4000) // n AS time, version, op, seq, payload FROM c, b""")
def sync_copy_stepped(spark, sf_dir):
    return changelog.copy(_log(spark, sf_dir), "8", "copy", start=10, step=(5000, 9000))


@query("partition_ids", f"WITH {_LOG} SELECT tenant, seq, (seq // 700)::INTEGER AS partition_id FROM l")
def partition_ids(spark, sf_dir):
    return changelog.partition_ids(_log(spark, sf_dir), 700).select("tenant", "seq", "partition_id")


@query("edge_activities", "SELECT o_custkey::VARCHAR AS tenant, o_orderkey AS time, list_filter([o_orderstatus], lambda x: x <> 'F') AS f_user, [o_orderpriority] AS f_name, [] ::VARCHAR[] AS f_origin, [o_custkey::VARCHAR] AS f_destination, ['a', o_orderstatus] AS f_tags, (o_orderkey % 7)::VARCHAR AS latency FROM orders")
def edge_activities(spark, sf_dir):
    o = tables.load(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    rows = o.select(
        F.col("o_custkey").cast("string").alias("tenant"), F.col("o_orderkey").alias("time"), status.alias("user"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("origin"),
        F.col("o_custkey").cast("string").alias("destination"), F.array(F.lit("a"), F.lit(""), F.col("o_orderstatus")).alias("tags"), (F.col("o_orderkey") % 7).alias("latency"),
    )
    return changelog.edges(rows)


@query("order_ids", "SELECT event_id AS id, ((epoch_us(ts) // 1000 - 1000) << 21) | ((3 << 12) | 7) AS number, epoch_us(ts) // 1000 AS ms FROM events")
def order_ids(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events")
    number = pack_order_id(F.expr("unix_micros(cast(ts as timestamp)) div 1000"), 3, 7, epoch=1000)
    return e.select(F.col("event_id").alias("id"), number.alias("number"), unpack_order_id(number, epoch=1000).alias("ms"))


@query("log_terms", "SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN ['unknown'] ELSE w END) AS term FROM (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9'']+'), lambda x: x <> '')) AS w FROM documents)")
def intake_terms(spark, sf_dir):
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.explode(log_terms(F.col("text"))).alias("term"))


@query("value_bits", "SELECT event_id AS id, floor(value * 100 - 3000)::BIGINT AS v, abs(floor(value * 100 - 3000)::BIGINT) = list_sum(list_transform(range(0, 63), lambda k: ((abs(floor(value * 100 - 3000)::BIGINT) >> k) & 1) << k)) AS same, bit_count(abs(floor(value * 100 - 3000)::BIGINT))::INTEGER + 1 AS n FROM events")
def value_bits(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.floor(F.col("value") * 100 - 3000).cast("bigint").alias("v"))
    bits = changelog.bits_of(F.col("v"))
    return e.select("id", "v", (changelog.value_of(bits) == F.col("v")).alias("same"), F.size(bits).alias("n"))
