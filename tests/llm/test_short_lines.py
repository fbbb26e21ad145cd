"""Lines of one to four words are compared like longer ones."""

import random

from test_linedup import check

from tidewire.llm import linedup as L


def like(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def test_short_copies_go(spark):
    rows = [(1, "All rights reserved.\nx"), (2, "ALL RIGHTS reserved.\n\ny"), (3, "x x\nonly here"), (4, "a b c d"), (5, "a b c d e"), (6, "a b c"), (7, " \t\n\nx")]
    df, gone = check(spark, rows)
    assert gone == {(2, 0): (1, 0), (3, 0): (1, 1), (5, 0): (4, 0), (7, 2): (1, 1)}
    out = {r.doc_id: r.text for r in L.dedupe_lines(df).collect()}
    assert out == {1: rows[0][1], 2: "\ny", 3: "only here", 4: "a b c d", 5: "", 6: "a b c", 7: " \t\n"}


def test_short_lines_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(d, "\n".join(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 7))) for _ in range(4))) for d in range(60)]
    lines = [(d, k, x) for d, t in rows for k, x in enumerate(t.split("\n"))]
    want = {}
    for a, (d, k, x) in enumerate(lines):
        first = next(((d2, k2) for d2, k2, y in lines[:a] if like(x, y)), None)
        if first:
            want[d, k] = first
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for blocks in (L._blocks, lambda code: (code > 100).astype(int) * 2 + 1):
        monkeypatch.setattr(L, "_blocks", blocks)
        got = L.similar_lines(df).collect()
        assert {(r.doc_id, r.line_no): (r.m_doc, r.m_line) for r in got if r.later} == want
        assert {r.doc_id: r.n for r in got if r.line_no < 0} == {d: sum(bool(x.split()) for x in t.split("\n")) for d, t in rows}
