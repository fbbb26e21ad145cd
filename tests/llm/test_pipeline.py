"""Each stage of the pipeline against brute force on its own input, and on awkward rows."""

import os

import numpy as np
import pyarrow as pa
import test_linedup
import test_simhash
from oracle import connect

import corpus_pipeline as P
from tidewire.llm import decontam, packing, quality


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = P.table(spark, sf_dir, "documents")
    labels = P.table(spark, sf_dir, "labels")
    step = dict(P.STAGES)

    _, model = quality.fit(docs, labels)
    before = rows_of(docs)
    good = {d for d, r in before.items() if model.score(quality.features(pa.array([r.text], pa.string())))[0] >= quality.THRESHOLD}
    docs = P.stage(step["quality"](spark, docs, sf_dir), "quality")
    assert set(rows_of(docs)) == good and 0 < len(good) < len(before)

    before = rows_of(docs)
    gone, _ = test_linedup.brute(sorted((d, r.text) for d, r in before.items()))
    docs = P.stage(step["line_dedup"](spark, docs, sf_dir), "lines")
    after = rows_of(docs)
    for d, r in before.items():
        left = [x for k, x in enumerate((r.text or "").split("\n")) if (d, k) not in gone]
        assert after[d].text == (r.text if len(left) == len((r.text or "").split("\n")) else "\n".join(left))
    assert gone and set(after) == set(before)

    ids, fps = sorted(after), test_simhash.brute([after[d].text for d in sorted(after)])
    comp = test_simhash.closure(ids, fps)
    docs = P.stage(step["simhash"](spark, docs, sf_dir), "simhash")
    assert set(rows_of(docs)) == set(comp) and len(set(comp)) < len(ids)

    before = rows_of(docs)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in os.listdir(sf_dir):
        if t != "documents.parquet":
            os.symlink(f"{sf_dir}/{t}", f"{tmp_path}/{t}")
    bad = {r[0] for r in connect(str(tmp_path)).execute(f"SELECT DISTINCT doc_id FROM ({decontam.ORACLE})").fetchall()}
    docs = P.stage(step["decontaminate"](spark, docs, sf_dir), "clean")
    assert bad and set(rows_of(docs)) == set(before) - bad

    ids = packing.WordIds(packing._tokenizer_path())
    length = {d: int(ids.counts(pa.array([r.text], pa.string()))[0]) + 1 for d, r in rows_of(docs).items()}
    got = step["pack"](spark, docs, sf_dir).collect()
    for d, n in length.items():
        assert sorted((r.start, r.length) for r in got if r.doc_id == d) == [(a, min(2048, n - a)) for a in range(0, n, 2048)]
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048


def test_awkward_rows(spark, sf_dir):
    rows = [(1, None, 1, 2), (2, "", 1, 2), (3, " \n ", 1, 2), (4, "a b c\n" * 3, 1, 2), (4, "a b c\n" * 3, 1, 2), (None, "no id", 1, 2), (5, "w " * 60_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, th long")
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for name, step in P.STAGES:
            d = P.stage(step(spark, d, sf_dir), name)
            assert name == "pack" or d.columns == docs.columns
        assert (d.count() == 0) == empty
