"""Quality rules: a table of thresholds compiled into one projection.

Statistics are built-in expressions over the whole text.  ``RULES`` is data: a
name, an expression over the statistics and the range that passes.  compile_rules
turns it into one boolean per rule and the verdict, with no user function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 5
STOP_WORDS = (
    "the of and a to in is that it for was on are as with be by this at from or an not "
    "der die das und ist von mit dem den ein eine zu im auf nicht "
    "le la les de des et un une est que qui dans pour sur du "
    "el los las en y se del por con no una su al lo"
)

#: (name, expression over the statistics, least, most); null: no bound on that side.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word", "word_chars / nullif(n_words, 0)", 2.0, 14.0),
    ("symbols", "n_symbols / nullif(n_words, 0)", None, 0.5),
    ("stop_words", "n_stop / nullif(n_words, 0)", 0.01, None),
    ("dup_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.3),
    ("caps", "n_upper / nullif(word_chars, 0)", None, 0.4),
)


def _separators() -> str:
    return r"[\x20\x09-\x0D]+"


def statistics(docs: DataFrame) -> DataFrame:
    """Every column of ``docs`` behind a struct ``row``, and the statistics.

    A null text is an empty one: zero everywhere.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(SEPARATORS))
    one = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text.alias("t"), bare.alias("bare"))
    two = one.select(
        "row", "t",
        F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", _separators())).alias("w"),
        F.split("t", "\n").alias("all_lines"),
    )
    line = F.filter("all_lines", lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    windows = F.expr(f"""if(size(w) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(w) - {WINDOW}),
        i -> xxhash64({", ".join(f"get(w, i + {k})" for k in range(WINDOW))})))""")
    three = two.select("row", "t", "w", line.alias("lines"), windows.alias("h"))
    # windows that occur again: sorted by hash and place, a neighbour has the same hash
    ranked = F.expr("if(size(array_distinct(h)) = size(h), null, sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i))))")
    squeezed = F.translate("t", SEPARATORS, "")
    four = three.select(
        "row", "lines", "w", ranked.alias("ranked"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(squeezed).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    again = F.expr("""if(ranked is null, cast(array() as array<int>), sort_array(transform(filter(ranked,
        (x, k) -> x.h <=> get(ranked, k - 1).h or x.h <=> get(ranked, k + 1).h), x -> x.i)))""")
    five = four.withColumn("again", again)
    covered = F.expr(f"aggregate(transform(again, (x, k) -> least({WINDOW}, coalesce(get(again, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)")
    return five.select(
        "row", "n_words", "word_chars", "n_symbols", "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS.split()))).cast("long").alias("n_stop"),
    )


def compile_rules(rules=RULES) -> Column:
    """One condition: every rule's value lies within its bounds (null values pass)."""
    parts = []
    for _, value, least, most in rules:
        v = F.expr(value)
        if least is not None:
            parts.append(F.coalesce(v >= least, F.lit(True)))
        if most is not None:
            parts.append(F.coalesce(v <= most, F.lit(True)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """(row, statistics, base_failed, kept), a row for each row of ``docs``.

    base_failed: under 10 words, or over a fifth of the words lie in repeated
    windows.  Null and empty texts have all counts zero and fail.  Values at a bound
    pass, repeated rows are judged each, an empty table gives no rows.
    """
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    s = statistics(docs).withColumn("base_failed", failed)
    return s.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass."""
    return judge(docs, rules).filter("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return j.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LIST = ", ".join(f"'{x}'" for x in STOP_WORDS.split())
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM a)),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n, FROM p),
c AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS k FROM g WHERE n > 1),
r AS (SELECT doc_id, sum(k)::BIGINT AS n_repeat_words FROM c GROUP BY 1),
s AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: x IN ({_LIST})))::BIGINT AS n_stop
  FROM a LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(" AND ".join(x for x in (f"coalesce({v} >= {lo}, true)" if lo is not None else "", f"coalesce({v} <= {hi}, true)" if hi is not None else "") if x) for _, v, lo, hi in RULES)} AS kept
FROM f
"""
