"""Feature co-occurrence models: training, merging, pruning and scoring."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import MATCH_ALL, Filter, build
from ..plans.stream import ALL_TIME, SEPARATOR, Stream, within


@dataclass(frozen=True)
class Feature:
    """A tuple of fields, and the rows it is taken from."""

    name: str
    fields: tuple[str, ...]
    filter: Filter = MATCH_ALL


STRATEGIES = ("UNIT_WEIGHTED", "REGRESSION_WEIGHTED", "MAX")


def tuples(s: Stream, feature: Feature) -> DataFrame:
    """Every row of the stream once for each combination of the feature's values, as ``feature`` and ``tuple``; rows that lack one drop out."""
    df = s.df.filter(build(feature.filter, s))
    names = []
    for i, f in enumerate(feature.fields):
        df = df.withColumn(f"_t{i}", F.explode(s.values(f)))
        names.append(f"_t{i}")
    return df.withColumn("tuple", F.concat_ws(SEPARATOR, *names)).withColumn("feature", F.lit(feature.name)).drop(*names)


def gather_features(s: Stream, answers: DataFrame, field: str, features: list[Feature], top: int) -> DataFrame:
    """(value, feature, tuple, n, latest): of each answer (value) its ``top`` most frequent tuples, the newest of equals first."""
    rows = [tuples(s, f).withColumn("value", F.explode(s.values(field))).select("value", "feature", "tuple", "id") for f in features]
    t = reduce(DataFrame.union, rows).join(answers.select("value").distinct(), "value", "left_semi")
    g = t.groupBy("value", "feature", "tuple").agg(F.count("*").alias("n"), F.max("id").alias("latest"))
    rn = F.row_number().over(Window.partitionBy("value", "feature").orderBy(F.desc("n"), F.desc("latest"), "tuple"))
    return g.withColumn("_rn", rn).filter(F.col("_rn") <= top).drop("_rn")


def train(
    s: Stream, gather: str, features: list[Feature], model_filters: list[Filter], bounds=ALL_TIME, authz: list[str] | None = None,
    top_terms: int = 1000, top_tuples: int = 1_000,
) -> DataFrame:
    """(feature, tuple, numerators, denominator): how often tuples go with the answers of each numerator, and at all.

    The answers of a numerator are its ``top_terms`` most frequent values of
    ``gather`` within the time range; their tuples are counted over all time.
    """
    base = s.visible(authz)
    inside = base.where(within(bounds))
    answers = None
    for i, flt in enumerate(model_filters):
        top = inside.df.filter(build(flt, inside)).select(F.explode(inside.values(gather)).alias("value")).groupBy("value").agg(F.count("*").alias("c"))
        top = top.orderBy(F.desc("c"), "value").limit(top_terms).select("value", F.lit(i).alias("numerator"))
        answers = top if answers is None else answers.union(top)
    sets = answers.groupBy("value").agg(F.collect_set("numerator").alias("numerators"))
    counts = gather_features(base, sets, gather, features, top_tuples).join(sets, "value")
    sums = [F.sum(F.when(F.array_contains("numerators", i), F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(model_filters))]
    nums = counts.groupBy("feature", "tuple").agg(*sums).select("feature", "tuple", F.array(*(f"n{i}" for i in range(len(model_filters)))).alias("numerators"))
    dens = reduce(DataFrame.union, [tuples(base, f).select("feature", "tuple", "id") for f in features])
    dens = dens.distinct().groupBy("feature", "tuple").agg(F.count("*").alias("denominator"))
    return nums.join(dens, ["feature", "tuple"])


def model_counts(s: Stream, answers: DataFrame, field: str, features: list[Feature]) -> DataFrame:
    """(feature, n): rows of answers that each feature is taken from."""
    out = None
    for f in features:
        rows = s.df.filter(build(f.filter, s)).select("id", F.explode(s.values(field)).alias("value")).join(answers.select("value").distinct(), "value", "left_semi")
        one = rows.select(F.lit(f.name).alias("feature"), "id", "value").groupBy("feature").agg(F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def merge(models: list[DataFrame]) -> DataFrame:
    """Models of the same kind added up; ``partitions`` says in how many a tuple is."""
    all_ = reduce(DataFrame.unionByName, [m if "partitions" in m.columns else m.withColumn("partitions", F.lit(1)) for m in models])
    n = F.posexplode("numerators").alias("i", "n")
    sums = all_.select("feature", "tuple", n).groupBy("feature", "tuple", "i").agg(F.sum("n").alias("n"))
    nums = sums.groupBy("feature", "tuple").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("numerators"))
    rest = all_.groupBy("feature", "tuple").agg(F.sum("denominator").alias("denominator"), F.sum("partitions").cast("int").alias("partitions"))
    return nums.join(rest, ["feature", "tuple"])


def prune(model: DataFrame, least: float = 0.0, top: int | None = None) -> DataFrame:
    """Tuples of which some score is above ``least``; of each feature the ``top`` with the largest score, then denominator."""
    score = F.array_max("numerators") / F.col("denominator")
    kept = model.withColumn("_s", score).filter(F.col("_s") > least)
    if top is not None:
        rn = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("_s"), F.desc("denominator"), "tuple"))
        kept = kept.withColumn("_rn", rn).filter(F.col("_rn") <= top).drop("_rn")
    return kept.drop("_s")


def deflate(model: DataFrame, total: int) -> DataFrame:
    """Denominators of tuples seen in some partitions only, scaled to all of them in whole numbers."""
    return model.withColumn("denominator", F.expr(f"(denominator * {total}) div partitions"))


def combine(scores: list[Column], strategy: str, n: int) -> Column:
    """Feature scores as one: their mean over all ``n`` features, their sum, or the largest."""
    if strategy == "UNIT_WEIGHTED":
        return reduce(lambda a, b: a + b, scores) / F.lit(float(n))
    if strategy == "REGRESSION_WEIGHTED":
        return reduce(lambda a, b: a + b, scores)
    if strategy == "MAX":
        return F.greatest(*scores) if len(scores) > 1 else scores[0]
    raise ValueError(f"no strategy {strategy}")


def score(
    s: Stream, models: list[tuple[DataFrame, float]], field: str, features: list[Feature], k: int | None, constraint: Filter = MATCH_ALL, bounds=ALL_TIME,
    numerator_scalars: tuple[float, ...] = (1.0,), strategy: str = "UNIT_WEIGHTED", numerator_strategy: str = "UNIT_WEIGHTED",
    feature_scalars: dict[str, float] | None = None, authz: list[str] | None = None, unread: DataFrame | None = None, unread_only: bool = False,
    gather: tuple[str, ...] = (), nil: float = 0.0001, explain: bool = False,
) -> DataFrame:
    """(value, score, n, latest_time, latest_id, ...): the ``k`` best values of ``field`` (all if None) by models and their weights.

    A tuple scores numerator / denominator, at most 1; a feature its best tuple
    times its scalar; features, models and numerators are combined in turn.
    At least one feature has a scalar above 0.  Scores up to ``nil`` count as 0, and values without a score fill the list.
    Ties are taken from the newest on, then by value.
    """
    base = s.visible(authz).where(within(bounds))
    base = base.where(build(constraint, base))
    df = base.df
    if unread is not None:
        marks = unread.select("id").distinct().withColumn("unread", F.lit(True))
        df = df.join(marks, "id", "left_semi" if unread_only else "left").withColumn("unread", F.lit(True) if unread_only else F.coalesce("unread", F.lit(False)))
        base = Stream(df, s.schema)
    rows = base.df.withColumn("value", F.explode(base.values(field)))
    keep = F.struct("time", "id", *(base.values(g).alias(f"g_{g}") for g in gather))
    info = rows.groupBy("value").agg(F.count("*").alias("n"), F.max_by(keep, F.col("id")).alias("latest"), *([F.bool_or("unread").alias("unread")] if unread is not None else []))
    scalars = feature_scalars or {f.name: 1.0 for f in features}
    total = sum(w for _, w in models)
    per_model = None
    for m, (model, weight) in enumerate(models):
        # tuples of all features together, so that each model is computed and joined once
        used = [f for f in features if scalars.get(f.name, 0.0) > 0]
        t = reduce(DataFrame.union, [tuples(base, f).withColumn("value", F.explode(base.values(field))).select("value", "feature", "tuple") for f in used]).distinct()
        scalar = F.try_element_at(F.create_map(*(F.lit(x) for f in used for x in (f.name, float(scalars[f.name])))), F.col("feature"))
        sc = F.transform("numerators", lambda x: F.least((x.cast("float") / F.col("denominator").cast("float")).cast("float"), F.lit(1.0).cast("float")) * scalar)
        cols = [F.max(F.coalesce(F.nanvl(F.get(sc, F.lit(i)).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(f"s{i}") for i in range(len(numerator_scalars))]
        best = t.join(model, ["feature", "tuple"]).groupBy("value", "feature").agg(*cols)
        sums = []
        for i in range(len(numerator_scalars)):
            agg = F.max(f"s{i}") if strategy == "MAX" else F.sum(f"s{i}") / F.lit(float(len(features)) if strategy == "UNIT_WEIGHTED" else 1.0)
            sums.append((agg * F.lit(weight)).alias(f"s{i}"))
        g = best.groupBy("value").agg(*sums, *([F.collect_list(F.struct("feature", "s0")).alias("features")] if explain and m == 0 else []))
        per_model = g if per_model is None else per_model.unionByName(g, allowMissingColumns=True)
    merged = per_model.groupBy("value").agg(*((F.sum(f"s{i}") / F.lit(total)).alias(f"s{i}") for i in range(len(numerator_scalars))), *([F.flatten(F.collect_list("features")).alias("features")] if explain else []))
    scaled = [F.col(f"s{i}") * F.lit(x) for i, x in enumerate(numerator_scalars)]
    merged = merged.withColumn("score", combine(scaled, numerator_strategy, len(numerator_scalars)))
    out = info.join(merged, "value", "left").withColumn("score", F.when(F.col("score") > nil, F.col("score")).otherwise(F.lit(0.0)))
    out = out.orderBy(F.desc("score"), F.desc("latest.id"), "value")
    out = out if k is None else out.limit(k)
    extra = [F.col(f"latest.g_{g}").alias(g) for g in gather] + (["unread"] if unread is not None else []) + (["features"] if explain else [])
    return out.select("value", "score", "n", F.col("latest.time").alias("latest_time"), F.col("latest.id").alias("latest_id"), *extra)
