"""Secret scan with corpus-wide ownership frequency.

Candidates come from fixed patterns.  Each value's hash is counted by distinct
owners and repositories over the whole corpus.  A value of EXAMPLE_OWNERS owners or
of EXAMPLE_REPOSITORIES repositories, be they of one owner, is a widely copied
example.  Of the others, a value that looks random is live-looking if only one
owner has it, and shared if two have.  These kinds add spans over the value; the
patterns' own spans stay.

Built-in functions only.  A hash is counted in three pre-aggregated steps and
looked up by a join that broadcasts no more than its few hot hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import lookup
from .storage import stage, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short has no longer run inside it, so lengths can stand in these patterns.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
FORMAT = r"gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----"
KINDS = ("assign", "access", "hex", "format", "live", "example", "shared")
BASE = 3
LEAST_VALUE = 6
#: A value that so many owners, or so many repositories of any owners, have is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 4
#: Matches whose places are added up together.
TOGETHER = 256
PLACEHOLDER = r"(?i)example|sample|dummy|test|changeme|placeholder|your|xxxx|0000|1234"


#: (pattern, group of the value), by rank; the value ends the match.
_PATTERNS = ((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (FORMAT, 0))
_KIND = "struct<start:bigint,rank:int,end:bigint,value:string>"


def _added_up(array: str, start: str, each: str) -> str:
    """An array of ``each``, said of the total so far, t.at, and the next number, z, of ``array``."""
    return f"aggregate({array}, named_struct('at', {start}, 'out', cast(array() as array<bigint>)), (t, z) -> named_struct('at', t.at + z, 'out', array_append(t.out, {each}))).out"


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """(row, owner, repository, spans): the patterns' spans of each row's whole text.

    The text between matches and the matches themselves give the places, in code
    points.  They are added up by blocks of TOGETHER matches, so that a text of many
    matches costs no square of their number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def named(c: str) -> F.Column:
        return F.coalesce(docs[c].cast("string"), F.lit("")) if c in docs.columns else F.lit("")

    keep = ["row", "owner", "repository"]
    df = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"), named(owner).alias("owner"), named(repository).alias("repository"), text.alias("t"))
    quoted = [p.replace("\\", "\\\\").replace("'", "\\'") for p, _ in _PATTERNS]
    df = df.select(*keep, "t", *(F.expr(f"regexp_extract_all(t, '{p}', 0)").alias(f"m{k}") for k, p in enumerate(quoted)))
    none = "cast(array() as array<string>)"
    more = []
    for k, (p, (_, group)) in enumerate(zip(quoted, _PATTERNS)):
        more.append(F.expr(f"if(size(m{k}) = 0, {none}, slice(split(t, '{p}', -1), 1, size(m{k})))").alias(f"g{k}"))
        more.append(F.expr(f"if(size(m{k}) = 0, {none}, {f"regexp_extract_all(t, '{p}', {group})" if group else f'm{k}'})").alias(f"v{k}"))
    ranks = range(len(_PATTERNS))
    df = df.select(*keep, *(f"m{k}" for k in ranks), *more)
    size = [F.expr(f"zip_with(g{k}, m{k}, (x, y) -> cast(char_length(x) + char_length(y) as bigint))").alias(f"s{k}") for k in ranks]
    df = df.select(*keep, *(f"m{k}" for k in ranks), *(f"v{k}" for k in ranks), *size)
    blocks = "transform(sequence(0, greatest(size(s{k}) - 1, 0) div {n}), b -> slice(s{k}, cast(b as int) * {n} + 1, {n}))"
    df = df.select("*", *(F.expr(blocks.format(k=k, n=TOGETHER)).alias(f"b{k}") for k in ranks))
    sums = "transform(b{k}, x -> aggregate(x, 0L, (a, y) -> a + y))"
    df = df.select("*", *(F.expr(_added_up(sums.format(k=k), "0L", "t.at")).alias(f"f{k}") for k in ranks))
    ends = (F.expr(f"flatten(zip_with(b{k}, f{k}, (x, y) -> {_added_up('x', 'y', 't.at + z')}))").alias(f"e{k}") for k in ranks)
    df = df.select(*keep, *(f"m{k}" for k in ranks), *(f"v{k}" for k in ranks), *ends)
    spans = [f"transform(e{k}, (e, i) -> cast(named_struct('start', e - char_length(m{k}[i]), 'rank', {k}, 'end', e, 'value', v{k}[i]) as {_KIND}))" for k in ranks]
    return df.select(*keep, F.expr(f"filter(concat({', '.join(spans)}), x -> x.rank <> 0 or char_length(x.value) >= {LEAST_VALUE})").alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, n) of candidates (hash, owner, repository); a repository is its owner's."""
    one = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    two = one.groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return two.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("n"))


def _text_of(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(sort_array({spans}), x -> concat_ws(':', {names}[x.rank], x.start, x.end)), ',')"


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """(row, spans, added): a row for each row of ``docs``.

    spans are the patterns' (start, rank in KINDS, end, value), added those of the
    method.  Null and empty texts have none.  Repeated rows are judged each for
    itself, and count as one owner.  An empty table gives no rows.
    """
    base = stage(candidates(docs, owner, repository).withColumn("key", F.monotonically_increasing_id()), "candidates")
    each = base.select("key", "owner", "repository", F.explode("spans").alias("s")).filter("s.value is not null")
    each = each.withColumn("hash", F.sha2("s.value", 256))
    known = ownership(each)
    total = each.count()
    judged = lookup(each.select("key", "hash", "s"), known, "hash", "n", total)
    random = (F.char_length("s.value") >= 16) & (F.size(F.array_distinct(F.split("s.value", ""))) >= 8) & F.expr("s.value rlike '[0-9]'") & ~F.col("s.value").rlike(PLACEHOLDER)
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    rank = F.when(example, KINDS.index("example")).when(random & (F.col("owners") == 1), KINDS.index("live")).when(random, KINDS.index("shared"))
    span = F.struct((F.col("s.end") - F.char_length("s.value")).alias("start"), rank.alias("rank"), F.col("s.end").alias("end"))
    added = judged.filter(rank.isNotNull()).groupBy("key").agg(F.collect_set(span).alias("added"))
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint>>)")
    with_spans = base.filter(F.size("spans") > 0).join(added, "key", "left").select("row", "spans", F.coalesce("added", none).alias("added"))
    without = base.filter(F.size("spans") == 0).select("row", "spans", none.alias("added"))
    return with_spans.unionByName(without)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    own = "transform(spans, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end))"
    n = [F.expr(f"cast(size(filter(spans, x -> x.rank = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    base = f"filter({own}, x -> x.rank < {BASE})"
    return s.select("row.doc_id", *n, F.sha2(F.expr(_text_of(base)), 256).alias("base_sha256"), F.expr(_text_of(f"concat({own}, added)")).alias("spans"))


def _walk(rank: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT k, doc_id, source, lang, {rank} AS rank, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, m[i] AS hit, v[i] AS value
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT k, doc_id, source, lang, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {group}) AS v FROM t))"""


_RANK = "CASE rank " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END"
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(_walk(k, p, g) for k, (p, g) in enumerate(_PATTERNS))}),
b AS (SELECT k, rank, start, start + length(hit) AS stop, value, source, lang FROM a WHERE rank <> 0 OR length(value) >= {LEAST_VALUE}),
o AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT (source, lang)) AS repositories FROM b GROUP BY 1),
x AS (SELECT DISTINCT k, CASE WHEN owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} THEN 5 WHEN length(value) >= 16 AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]')
    AND NOT regexp_matches(value, '{PLACEHOLDER}') THEN CASE WHEN owners = 1 THEN 4 ELSE 6 END END AS rank, stop - length(value) AS start, stop FROM b JOIN o USING (value)),
s AS (SELECT k, rank, start, stop FROM b UNION ALL SELECT k, rank, start, stop FROM x WHERE rank IS NOT NULL),
n AS (SELECT k, string_agg({_RANK} || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
  string_agg(CASE WHEN rank < {BASE} THEN {_RANK} || ':' || start || ':' || stop END, ',' ORDER BY start, rank) AS own,
  {", ".join(f"count(*) FILTER (rank = {k}) AS n_{KINDS[k]}" for k in range(BASE))} FROM s GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k]}, 0)::BIGINT AS n_{KINDS[k]}" for k in range(BASE))}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN n USING (k)
"""
