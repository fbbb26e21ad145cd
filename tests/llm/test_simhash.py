import numpy as np
import xxhash

from tidewire.llm import simhash as S


def brute(texts):
    out = []
    for t in texts:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def closure(ids, fps):
    comp = list(range(len(ids)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[root(i)] = root(j)
    low = {}
    for i in range(len(ids)):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return [low[root(i)] for i in range(len(ids))]


def test_anchors_cover():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 200, dtype=np.uint64)
    for bit in [None, *range(32)]:
        y = x if bit is None else x ^ np.uint64(1 << bit)
        home = next(a for r, a, h in S.anchors(x) if h)
        seen = [set() for _ in x]
        for r, a, _ in S.anchors(y):
            for i, v in zip(r.tolist(), a.tolist()):
                assert v not in seen[i]
                seen[i].add(v)
        assert all(int(h) in s for h, s in zip(home, seen))
        assert all((int(v) ^ int(w)).bit_count() <= 1 for v, w in zip(home, x))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(df).collect())
    fps = brute([t for _, t in rows])
    comp = closure([i for i, _ in rows], fps)
    assert got == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp))
    return got


def test_edges(spark):
    long = "wort " * 30000
    check(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (6, "a"), (9, long), (9, long), (7, "é Ü ß ÀB x")])


def test_chain_and_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{rng.integers(300)}" for _ in range(120)]
    rows = [(100, " ".join(base))]
    for k in range(60):
        base = list(base)
        base[rng.integers(120)] = f"z{k}"
        rows.append((99 - k, " ".join(base)))
    rows += [(1000 + k, " ".join(f"q{rng.integers(5000)}" for _ in range(30))) for k in range(60)]
    plain = check(spark, rows)
    monkeypatch.setattr(S, "HOMES", 2)
    monkeypatch.setattr(S, "MEMBERS", 5)
    assert check(spark, rows) == plain


def test_work_at_one_anchor():
    """50,000 members and 20 homes: homes times rows after them, not members squared."""
    rng = np.random.default_rng(4)
    m = 50_000
    fp = rng.integers(0, 1 << 63, m, dtype=np.uint64)
    fp[30_000] = fp[3] ^ np.uint64(7)
    fp[40_000] = fp[30_000] ^ np.uint64(1 << 40)
    home = np.arange(m) < 20
    label, pairs = S.spanning(np.zeros(m, np.int64), fp, home)
    assert pairs == 20 * (m - 1) - 190 and np.flatnonzero(label != np.arange(m)).tolist() == [30_000] and label[30_000] == 3


def test_unique_texts_under_one_id_stay(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (2, "something else entirely here"), (2, "something else entirely here"), (3, None), (4, ""), (None, "no id")], "doc_id long, text string")
    assert sorted(map(str, S.dedupe(df).collect())) == sorted(map(str, [df.collect()[k] for k in (0, 2, 4, 6)]))
    other = {(r.doc_id, r.fingerprint): r.component_id for r in S.simhash_components(df).collect()}
    assert sorted(v for (d, _), v in other.items() if d == 2) == [1, 2]


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_empty_and_clashing_columns(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8), (3, "x y z", 1, 1)], "doc_id long, text string, fp long, component_id long")
    assert {r.doc_id: r.component_id for r in S.simhash_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    kept = S.dedupe(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
