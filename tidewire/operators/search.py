"""Full-text search: boolean query strings, newest first or by weight of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stop_words
from ..plans.filters import NO_FILTER, build, expand, is_prefix, occurrences, parse_query, prefixes
from ..plans.stream import ALL_TIME, SEPARATOR, Stream, within


def _times(s: Stream, field: str, word: str) -> Column:
    """Occurrences of a word in a row."""
    return F.size(F.filter(F.col(s.field(field).column), lambda x: x == word))


def _prefix_scores(s: Stream, hits: DataFrame, field: str, head: str) -> DataFrame:
    """(id, score): for the terms that begin with ``head``, occurrences in a row / occurrences in the collection, summed by row."""
    def terms(df: DataFrame) -> DataFrame:
        own = F.filter(F.col(s.field(field).column), lambda x: x.startswith(head))
        return df.select("id", F.explode(own).alias("term"))

    all_ = terms(s.df).groupBy("term").agg(F.count("*").alias("c"))
    own = terms(hits).groupBy("id", "term").agg(F.count("*").alias("n"))
    return own.join(all_, "term").groupBy("id").agg(F.sum(F.col("n") / F.col("c")).alias("score"))


def full_text(
    s: Stream, query: str, default_field: str, k: int | None, strategy: str = "TIME", bounds=ALL_TIME, constraints=NO_FILTER,
    authz: list[str] | None = None, locale: str = "en", use_stop_words: bool = False, max_wildcards: int | None = None, gather: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` rows (id, time, score, gathered fields), all of them if it is None, and one row with the number of all that match.

    TIME scores 0 and takes the newest.  TF_IDF adds up, for each query term with
    any occurrence, net occurrences in the query / occurrences in the collection
    * occurrences in the row; fields without counts add nothing.  A prefix stands
    for all its terms, with ``max_wildcards`` (over 0) for the first so many.  Ties
    are taken from the newest on.
    """
    stop = set(stop_words(locale)) if use_stop_words else set()
    flt = parse_query(query, default_field, lambda t: [] if t.lower() in stop else [t.lower()])
    if max_wildcards is not None and max_wildcards > 0:
        flt = expand(flt, s, max_wildcards)
    base = s.visible(authz).where(within(bounds))
    if constraints != NO_FILTER:
        base = base.where(build(constraints, base))
    hits = base.df.filter(build(flt, base))
    found = hits.agg(F.count("*").alias("found"))
    if strategy == "TIME":
        scored = hits.withColumn("score", F.lit(0.0))
    elif strategy == "TF_IDF":
        weights = {}
        for (field, word), n in occurrences(flt).items():
            f = s.field(field)
            if f is not None and not is_prefix(f, tuple(word.split(SEPARATOR))) and "cardinality" in f.features:
                weights.setdefault(field, {})[word] = n
        # counts in the collection: one pass for all terms, each row adding what it holds
        wanted = [(f, w) for f, ws in weights.items() for w in ws]
        sums = [F.sum(_times(s, f, w)).alias(f"c{i}") for i, (f, w) in enumerate(wanted)]
        totals = s.df.agg(*sums).first() if wanted else ()
        score = F.lit(0.0)
        for i, (f, w) in enumerate(wanted):
            if totals[i]:
                score = score + F.lit(weights[f][w] / totals[i]) * _times(s, f, w)
        scored = hits.withColumn("score", score)
        for (field, head), n in prefixes(flt, s).items():
            if "cardinality" in s.field(field).features:
                more = _prefix_scores(s, hits, field, head).withColumnRenamed("score", "_more")
                scored = scored.join(more, "id", "left").withColumn("score", F.col("score") + n * F.coalesce("_more", F.lit(0.0))).drop("_more")
    else:
        raise ValueError(f"no strategy {strategy}")
    cols = ["id", "time", "score", *(base.values(g).alias(g) for g in gather)]
    ranked = scored.select(*cols).orderBy(F.desc("score"), F.desc("id"))
    return ranked if k is None else ranked.limit(k), found
