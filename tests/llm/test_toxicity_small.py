"""op6 on few labels, on labels that no word tells apart, and on one class."""

import random

import numpy as np

from tidewire.llm import toxicity as T


def made(n, insults, seed=0):
    """Texts of random words; every fourth holds one of the insults, each equally often."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(6)) for _ in range(200)]
    return [(i, " ".join([*rng.sample(plain, 8), *([insults[i // 4 % len(insults)]] if insults and i % 4 == 0 else [])])) for i in range(n)]


def train(spark, rows, every=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, T.train(docs, spark.createDataFrame([(i, int(i % every == 0)) for i, _ in rows], "doc_id long, label int"))


def test_few_labels(spark):
    docs, model = train(spark, made(32, ["grumbleface"]))
    got = {r.doc_id: r.score >= T.THRESHOLD for r in T.score(docs, model).collect()}
    assert got == {i: i % 4 == 0 for i in range(32)}


def test_nothing_tells(spark):
    docs, model = train(spark, [(i, "the same words in each") for i in range(40)], every=10)
    assert np.allclose([r.score for r in T.score(docs, model).collect()], 0.1)


def test_one_class_only(spark, tmp_path):
    spark.createDataFrame(made(40, []), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {(r.score, r.predicted) for r in T.op6_toxicity(spark, str(tmp_path)).collect()} == {(0.0, 0)}
