import random

import numpy as np

from tidewire.llm import linedup as L


def sets(rows):
    out = []
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            words = "".join(c.lower() if "A" <= c <= "Z" else c for c in line).split()
            if len(words) >= L.MIN_WORDS:
                out.append((doc, k, frozenset(words), tuple(sorted(words))))
    return out


def brute(rows):
    lines, gone, links = sets(rows), {}, {}
    for a, (doc, k, s, w) in enumerate(lines):
        like = [(d2, k2, w2) for d2, k2, s2, w2 in lines if 5 * len(s & s2) >= 4 * len(s | s2)]
        first = min((x[:2] for x in like), default=(doc, k))
        if first < (doc, k):
            gone[doc, k] = first
        links[doc, k] = len({x[2] for x in like} - {w})
    return gone, links


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.similar_lines(df).collect()
    gone, links = brute(rows)
    assert {(r.doc_id, r.line_no): (r.m_doc, r.m_line) for r in got if r.later} == gone
    assert {(r.doc_id, r.line_no): r.links for r in got if r.line_no >= 0} == links
    return df, gone


def made(seed, n, vocabulary=60):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(4, 30))] for _ in range(12)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                line[rng.randrange(len(line))] = f"w{rng.randrange(vocabulary)}"
            if rng.random() < 0.2:
                line.append(rng.choice(line))
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    return rows


def test_random_lines(spark, monkeypatch):
    rows = made(1, 80)
    check(spark, rows)
    monkeypatch.setattr(L, "_blocks", lambda code: (code > 100).astype(int) * 2 + 1)
    check(spark, rows)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "a b c d e\n\na b c d e"), (4, "E D C B A"), (5, "a b c d"), (6, long), (7, long + " y"), (8, " \t ä ö ü ß é \n"), (9, "Ä Ö Ü ß é"), (10, "ä ö ü ß é")]
    df, gone = check(spark, rows)
    out = {r.doc_id: r.text for r in L.dedupe_lines(df).collect()}
    assert out[1] is None and out[2] == "" and out[3] == "a b c d e\n" and out[4] == "" and out[5] == ""
    assert out[6] == long and out[7] == "" and out[9] == "Ä Ö Ü ß é" and out[10] == ""


def test_repeats_and_columns(spark):
    rows = [(1, "a b c d e f\nq r s t u v", 7, 2, 3), (1, "a b c d e f\nq r s t u v", 7, 2, 3), (2, "q r s t u v\nz", 9, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cls long, gone long")
    out = L.dedupe_lines(df)
    assert out.columns == df.columns and out.schema == df.schema
    assert sorted(map(tuple, out.collect())) == sorted([rows[0], rows[1], (2, "z", 1, 2, 3)])
    assert L.similar_lines(df.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    q = L.op10_line_dedup(spark, sf_dir)
    assert q.count() == len({r[0] for r in rows})


def test_hashes_keep_lines_apart(spark):
    """Words that collide under any polynomial hash modulo 2^64, and classes that share one half of their hash."""
    one = ["a"]
    for _ in range(10):
        one = one + ["b" if x == "a" else "a" for x in one]
    two = ["b" if x == "a" else "a" for x in one]
    check(spark, [(1, "one two " + "".join(one)), (2, "one two " + "".join(two)), (3, "".join(two) + " two one")])
    memory = L._Memory()
    assert memory.fresh(np.array([5, 5, 5], np.uint64), np.array([1, 2, 1], np.uint64)).tolist() in ([0, 1], [0, 1, 2])


def test_matrices_agree_with_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L, "WIDE", 5)
    for pair in (0, 3 << 40 | 1, 3 << 40 | 1 << 20 | 1):
        sets = [rng.permutation(40)[: rng.integers(1, 12)].astype(np.uint64) for _ in range(60)]
        sets = [np.r_[x[x != 3][:4], np.uint64(3), x[x != 3][4:]] if k % 9 else x for k, x in enumerate(np.repeat(np.array(sets, object), 2))]
        sets = [np.array(x, np.uint64) for x in sets]
        cls = rng.integers(0, 100, len(sets)).astype(np.uint64)
        assert L._few_links(np.uint64(3), sets, cls, pair) == L._links_of(np.uint64(3), sets, cls, pair)
