"""op4's and op6's arithmetic against plain loops, and held-out rows of the real tables."""

import numpy as np
import pyarrow as pa

from tidewire.llm import quality as Q
from tidewire.llm import toxicity as T


def test_toxic_texts_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = T.op6_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    found = [r.predicted for r in rows if r.toxic]
    false = [r.predicted for r in rows if not r.toxic]
    assert len(found) > 100 and sum(found) >= 0.9 * len(found) and sum(false) <= 0.01 * len(false)


def test_pooled_texts():
    kernel = T.Kernel(["grumble", "fool>", "idiot"])
    texts = ["a grumbling fool, you fooool idiot idiot", "", None, "nothing here", "i d i o t and foolish"]
    got = T.Pool(kernel).texts(pa.array(texts))
    for text, row in zip(texts, got):
        x = T.Letters(pa.array([text], pa.string()))
        v = np.maximum(kernel.values(x.code, x.size) - T.FLOOR, 0) if len(x.size) else np.zeros((0, 3))
        want = np.r_[v.max(0, initial=0), v.sum(0) * T.Pool.WORDS / (len(x.size) + T.Pool.MORE)]
        assert np.allclose(row, want, atol=1e-5)
    again = T.Pool(kernel)
    assert all(np.allclose(again.texts(pa.array(texts)), got) for _ in range(2))
    hidden = T.Pool(kernel).texts(pa.array(["idiot"]), True)[0]
    assert 0 < hidden[2] < got[0][2]


def test_other_scripts_keep_apart():
    k = T.Kernel([str(w) for w in T.spell(T.Letters(pa.array(["дурак"])).code)])
    x = T.Letters(pa.array(["дурак дурaк хорошо 1d10t ab"]))
    v = k.values(x.code, x.size)[:, 0]
    words = [str(w) for w in T.spell(x.code)]
    assert len(words) == 5 and "idiot" in words and "ab" in words and sorted(v)[-1] > 0.99 and sorted(v)[2] < 0.3


def test_svm_is_at_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=200) > 0, 1.0, -1.0)
    weight = rng.random(200)
    weight /= weight.sum()
    w, b = T._svm(x, y, weight, c=100.0)

    def loss(w, b):
        return w @ w / 2 + 1e-3 * b * b / 2 + 100 * sum(k * max(0, 1 - t * (r @ w + b)) ** 2 for k, t, r in zip(weight, y, x))

    least = loss(w, b)
    assert all(loss(w + 1e-2 * d[:5], b + 1e-2 * d[5]) >= least for d in rng.normal(size=(100, 6)))
    slope, shift = T._sigmoid(x @ w + b, y)
    assert slope > 0 and np.mean((slope * (x @ w + b) + shift > 0) == (y > 0)) > 0.9


def test_discriminant_from_plain_sums(spark):
    rng = np.random.default_rng(1)
    d = len(Q.FEATURES)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + y[:, None]
    stats = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "doc_id long, x array<double>")
    model = Q.train(stats, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)] + [(7, None), (None, 1), (5000, 1)], "doc_id long, label int"))
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    n = [(y == k).sum() for k in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / 300
    dens = []
    for k in (0, 1):
        c = (1 - Q.POOLED - Q.DIAGONAL) * cov[k] + Q.POOLED * pooled + Q.DIAGONAL * np.diag(np.diag(pooled) + 1e-6)
        e = x - x[y == k].mean(0)
        dens.append(np.log(n[k] / 300) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
    want = 1 / (1 + np.exp(-np.clip((dens[1] - dens[0]) / Q.TEMPER, -30, 30)))
    assert np.allclose([r.score for r in Q.score(stats, model).orderBy("doc_id").collect()], want)


def test_features_by_plain_counting():
    text = "The Cat sat, the cat SAT!!\n#1 was was 42"
    x = dict(zip(Q.FEATURES, Q.features(pa.array([text]))[0]))
    w = text.lower().split()
    n, size, pairs = len(w), sum(map(len, w)), len(w) - 1
    assert np.isclose(x["words"], np.log(n + 12)) and np.isclose(x["word_size"], np.log((size + 60) / (n + 12)))
    assert np.isclose(x["new_words"], np.log((len(set(w)) + 12) / (n + 12))) and np.isclose(x["stutter"], np.log((1 + 0.1) / (pairs + 12) + 0.02))
    assert np.isclose(x["new_pairs"], np.log(1.05 - (len(set(zip(w, w[1:]))) + 12) / (pairs + 12))) and np.isclose(x["marks"], np.log((2 + 0.1) / (n + 12) + 0.02))
    assert np.isclose(x["capitals"], np.log((5 + 0.08 * 15) / (size + 60) + 0.01)) and np.isclose(x["line_words"], np.log((n + 24) / 3))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "x" * 200_000), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.score for r in Q.op4_quality(spark, str(tmp_path)).collect()) == [0.5] * len(rows)
    model = Q.Discriminant(np.array([50.0, 50.0]), np.vstack([np.zeros(10), np.ones(10)]) * 50, np.stack([np.eye(10), np.eye(10) + 1]) * 50)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [r.score for r in Q.score(Q.statistics(docs), model).collect()]
    assert len(got) == len(rows) and all(0 <= v <= 1 for v in got)
    assert Q.score(Q.statistics(docs.limit(0)), model).count() == 0 and T.score(docs.limit(0), None).count() == 0
