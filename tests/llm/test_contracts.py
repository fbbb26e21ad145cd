"""Operators against their SQL or brute force, and on awkward rows."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tidewire import llm
from tidewire.llm import decontam, lengths, packing, quality, rules, secrets, toxicity, warc

KEY = "q7R2mZ0pXw9LbT4c"
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One two three four five six seven eight nine ten eleven twelve."), (5, "a b c d e " * 3),
    (6, f'api_key = "{KEY}" and AKIA{"A1" * 9} then {"0f" * 13}\nsame line here\nsame line here'), (6, "a repeated id"), (7, "x" * 50_000 + " é " + "y z " * 5_000), (None, "no id at all"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "s", 0, 1, "k", -1.0, 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score double, row int")


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_sql(name, spark, sf_dir):
    compare(llm.QUERIES[name](spark, sf_dir), connect(sf_dir), llm.ORACLE[name])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_rules(odd):
    got = rules.judge(odd.select("doc_id", "text"))
    for r in got.collect():
        text, w = r.row.text or "", words(r.row.text)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        again = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
    assert rules.keep(odd).columns == odd.columns and rules.judge(odd.limit(0)).count() == 0


def test_secrets(odd):
    got = [(r.row.doc_id, r) for r in secrets.scan(odd).collect()]
    assert len(got) == len(TEXTS)
    row = next(r for _, r in got if len(r.spans))
    text = dict((t[:8], t) for _, t in TEXTS if t)["api_key "]
    want = {(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text)} | {(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text)}
    want |= {(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text)}
    assert {(s.start, s.rank, s.end) for s in row.spans} == want
    live = {(a.start, a.end) for a in row.added if secrets.KINDS[a.rank] == "live"}
    assert (text.index(KEY), text.index(KEY) + len(KEY)) in live


def test_widely_held_values_are_examples(spark):
    rows = [(i, f"token: {KEY}", f"s{i}", "r") for i in range(4)] + [(9, "token: Z9y8X7w6V5u4T3s2", "s9", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kinds = {r.row.doc_id: {secrets.KINDS[a.rank] for a in r.added} for r in secrets.scan(df).collect()}
    assert kinds == {**{i: {"example"} for i in range(4)}, 9: {"live"}}


def test_copies_of_one_owner_are_examples(spark):
    rows = [(i, f"token: {KEY}", "hot", f"r{i % 4}") for i in range(8)] + [(20 + i, "token: Z9y8X7w6V5u4T3s2", f"s{i}", "r") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kinds = {r.row.doc_id: {secrets.KINDS[a.rank] for a in r.added} for r in secrets.scan(df).collect()}
    assert kinds == {**{i: {"example"} for i in range(8)}, 20: {"shared"}, 21: {"shared"}}
    assert secrets.scan(df.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    text = "é" + " ".join(f"{k:032x}" for k in range(1500)) + " password=secret99"
    got = secrets.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    want = sorted((m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text)) + [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text)]
    assert len(got) == 2 and all(sorted((s.start, s.rank, s.end) for s in r.spans) == sorted(want) for r in got)


def test_overlaps(spark, odd):
    item = " ".join(f"w{i}" for i in range(40))
    swapped = item.split()
    swapped[10] = swapped[22] = swapped[31] = "other"
    docs = [(1, "lead in " + item), (2, "x y " + " ".join(swapped) + " z"), (3, " ".join(item.split()[:7]) + " is too little"), (4, None), (1, "lead in " + item), (5, "Five Short words, in all!")]
    bench = [(7, item), (8, None), (9, "five short words in all"), (7, item), (10, "")]
    d = spark.createDataFrame([(*r, 1, "a") for r in docs], "doc_id long, text string, item_id int, seed string")
    b = spark.createDataFrame([(*r, 3) for r in bench], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.matched, r.compared) for r in decontam.overlaps(d, b).collect()}
    assert set(got) == {(1, 7), (2, 7), (5, 9)} and got[1, 7] == (16, 16) and got[5, 9] == (5, 5)
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [3, 4] and decontam.clean(d, b).columns == d.columns
    assert decontam.overlaps(d.limit(0), b).count() == 0 and decontam.overlaps(d, b.limit(0)).count() == 0
    assert decontam.clean(odd, b).count() == len(TEXTS)


def test_overlaps_at_edges_and_short_items(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(item[20:34])), (2, "Yes"), (3, "yes it is so"), (4, " ".join(item[:9])), (None, " ".join(item)), (5, "fine"), (5, "see " + " ".join(item)), (6, "well " + " ".join(item[:11] + ["x"] + item[12:13]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, "yes"), (3, "it is so that")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontam.overlaps(d, b).collect()) == [(0, 1), (1, 1), (2, 2), (5, 1), (6, 1)]
    assert sorted(r.text for r in decontam.clean(d, b).collect()) == sorted([docs[2][1], docs[3][1], "fine"])


def test_seeds_lose_no_run_with_three_substitutions():
    """Recall of the masks for every way to change three of RUN words, counted without Spark."""
    import itertools

    spots = [{o + k for k, x in enumerate(m) if x == "1"} for m in decontam.MASKS for o in range(decontam.RUN - len(m) + 1)]
    for k, lost in ((2, 0), (3, 2)):
        assert sum(all(s & set(changed) for s in spots) for changed in itertools.combinations(range(decontam.RUN), k)) == lost


def test_overlaps_against_brute_force(spark, sf_dir):
    """Without seeds: every alignment of every item with every text that has a part of it planted."""
    import random

    rng = random.Random(4)
    items = [[f"v{rng.randrange(400)}" for _ in range(rng.randrange(12, 40))] for _ in range(12)]
    docs = []
    for k in range(60):
        own, a = rng.choice(items), rng.randrange(0, 8)
        part = [f"u{k}x{i}" if rng.random() < 0.12 else w for i, w in enumerate(own[a : a + rng.randrange(8, 30)])]
        docs.append([f"p{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 5))] + part + [f"p{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 5))])
    want = set()
    for d, x in enumerate(docs):
        for i, y in enumerate(items):
            for by in range(-len(y), len(x)):
                lo, hi = max(0, -by), min(len(y), len(x) - by)
                n = min(decontam.RUN, hi - lo)
                if hi - lo >= min(decontam.SPAN, len(y)) and any(sum(y[s + k] == x[by + s + k] for k in range(n)) >= decontam.AGREE * n for s in range(lo, hi - n + 1)):
                    want.add((d, i))
    d = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 20


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    w = warc.ArcWriter(version)
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    w.add("http://a/ b", http + "é\n\n".encode(), date="20240102030405")
    w.add(None, b"", kind="text/dns")
    got = list(warc.read_arc(w.bytes()))
    assert [b for _, b in got] == [http + "é\n\n".encode(), b""] and set(got[0][0]) == set(warc.ARC_FIELDS[version])
    import io

    made = list(warc.read_warc(io.BytesIO(b"".join(warc.convert(f, b) for f, b in got))))
    assert [m.headers["WARC-Type"] for m in made] == ["response", "resource"] and made[0].payload == "é\n\n".encode()
    assert made[0].headers["WARC-Date"] == "2024-01-02T03:04:05Z" and made[0].headers["WARC-Payload-Digest"] == "sha1:" + warc.digest("é\n\n".encode())
    with pytest.raises(warc.ArchiveError):
        list(warc.read_arc(w.bytes()[:-5]))
    assert all(warc.page_of(warc.page_urn(p)) == p for p in (0, 1, -1, 2**63 - 1, -(2**63)))


def test_urls_come_back(spark):
    long = "http://h/" + "p" * 50_000
    urls = ["http://a/b%20c", "http://a/b c\td", "http://a/100%", "ü ö", None, "", long]
    pages = spark.createDataFrame([(k, u, f"page {k}") for k, u in enumerate(urls)] + [(None, "http://n", "page 1"), (None, "http://n", "alone")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert {r.page_id: r.url for r in got if r.page_id is not None} == dict(enumerate(["http://a/b%20c", "http://a/b%20c%09d", "http://a/100%", "ü%20ö", "-", "-", long]))
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", 1)]


def test_old_header_lines():
    block = b"1 0 x\n" + " ".join(warc.ARC_FIELDS[1]).encode() + b"\n"
    head = f"filedesc://x 0.0.0.0 20000101000000 text/plain {len(block)}\n".encode() + block + b"\n"
    lines = ["http://a/b c 20 d 1.2.3.4 20010203040506 text/html; charset=utf-8 2", "http://a 1.2.3.4 20010203040506 - 2", "what is this 2"]
    data = head + b"".join(x.encode() + b"\nhi\n" for x in lines)
    bad: list = []
    got = [f for f, _ in warc.read_arc(data, bad)]
    assert [f["URL"] for f in got] == ["http://a/b c 20 d", "http://a"] and got[0]["Content-type"] == "text/html; charset=utf-8" and bad == lines[2:]
    with pytest.raises(warc.ArchiveError):
        list(warc.read_arc(data))


def test_archives(spark):
    rows = [(1, "http://a", "same", 0), (3, None, "same", 0), (2, "u", None, 0), (5, "u", "", 0), (4, "u", "h" * 100_000, 0), (3, "again", "same", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, winner int")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id not in (3,)) == [(1, 4, "revisit", 3), (2, 0, "revisit", 5), (4, 100_000, "response", None), (5, 0, "response", None)]
    assert [r.record_type for r in got if r.page_id == 3] == ["response"] * 2
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_packing(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing._tokenizer_path())
    want = {}
    for i, text in TEXTS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        for k, s in enumerate(range(0, len(ids), packing.CAPACITY)):
            own = ids[s : s + packing.CAPACITY]
            want.setdefault((i, k, s, len(own), zlib.crc32(own.tobytes())), 0)
    got = packing.pack(odd).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == set(want)
    place = collections.defaultdict(list)
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
    for x in place.values():
        assert [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= packing.CAPACITY
    hist = {r.length: r for r in lengths.histogram(lengths.token_counts(odd)).collect()}
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in TEXTS]
    for size, r in hist.items():
        assert (r.n_docs, r.docs_from, r.tokens_from, r.total_tokens) == (n.count(size), sum(x >= size for x in n), sum(x for x in n if x >= size), sum(n))
        assert r.truncated_total == sum(min(x, size) for x in n)
    h = lengths.histogram(lengths.token_counts(odd))
    assert lengths.truncated_total(h, 7) == sum(min(x, 7) for x in n) and lengths.length_at(h, 1.0) == max(n)
    assert packing.pack(odd.limit(0)).count() == 0


def test_sum_of_squares():
    rng, state, gaps = np.random.default_rng(1), packing.SumOfSquares(20), []
    for size in rng.integers(1, 21, 300):
        def total(after):
            c = collections.Counter(g for g in after if g)
            return sum(v * v for v in c.values())

        at, offset = state.place(int(size))
        least = min(total([*gaps[:k], g - size, *gaps[k + 1 :]]) for k, g in enumerate([*gaps, 20]) if g >= size)
        if at == len(gaps):
            gaps.append(20)
        assert offset == 20 - gaps[at]
        gaps[at] -= size
        assert gaps[at] >= 0 and total(gaps) == least


def test_fewest_sequences():
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.integers(1, 2000, 3000))[::-1]
    least = -(-int(sizes.sum()) // 2048)
    state = packing.SumOfSquares(2048, least)
    for x in sizes.tolist():
        state.place(x)
    assert state.made <= 1.02 * least


def test_ids_are_the_tokenizers(spark):
    """Whole sf0.01, and strings made to be cut wrongly."""
    import random

    words_ = packing.WordIds(packing._tokenizer_path())
    rng = random.Random(1)
    chars = "aAsStTrReEvVmMlLdD'''\"  \n\t\x1c\x00\x85\xa0²½ªµºÀÉ×÷ßÿ¿«0179!-_<|>"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [None, "", "it's", "'", "'", "s", "'S", "l'l", "a'", "<|endoftext|> 's", "日本's", "İstanbul", "é", "|x", "a" * 70 + "'s" + "é" * 40]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for a in range(0, len(texts), 400):
        part = pa.array(texts[a : a + 400], pa.string())
        (ids, off), n = words_.ids(part), words_.counts(part)
        want = [e.ids for e in words_.tokenizer.encode_batch([t or "" for t in texts[a : a + 400]], add_special_tokens=False)]
        assert [ids[off[k] : off[k + 1] - 1].tolist() for k in range(len(want))] == want and n.tolist() == list(map(len, want))


def test_kernel():
    ws = ["idiot", "idxiot", "clown", "aaaaaaa", "ab"]

    def features(w):
        w, out = "^" + w + "^", collections.Counter()
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + toxicity.SPAN)):
                for j in range(i + 1, k):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def dot(a, b):
        return sum(v * b[k] for k, v in a.items())

    f = [features(w) for w in ws]
    want = [[dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 for b in f] for a in f]
    kernel = toxicity.Kernel(ws)
    got = kernel.values(*toxicity.encode(ws))
    assert np.allclose(got, want, atol=1e-5) and (kernel.bound(*toxicity.encode(ws)) >= got.max(1) - 1e-5).all()
    assert got[0, 1] > 0.5 > got[0, 2]


def test_toxicity(spark, odd):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefghilmnorstu"), 6)) for _ in range(60)]
    rows = [(i, " ".join([*rng.choice(plain, 20), *(["grumbleface"] if i % 4 == 0 else [])])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, label int")
    model = toxicity.train(docs, labels)
    more = [(1000, "x Gr-umblefzace y"), (1001, "g r u m b l e f a c e"), (1002, " ".join(plain[:30]))]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(more, "doc_id long, text string"), model).collect()}
    assert got[1000] >= 0.3 and got[1001] >= 0.3 and got[1002] < 0.3
    scores = [r.score for r in toxicity.score(odd, model).collect()]
    assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for s in scores)
    assert toxicity.train(docs, labels.filter("label = 0")) is None and toxicity.train(docs.limit(0), labels.limit(0)) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.5}


def test_quality(spark, odd):
    x = quality.features(pa.array([t for _, t in TEXTS]))
    assert x.shape == (len(TEXTS), len(quality.FEATURES)) and np.isfinite(x).all() and np.array_equal(x[0], x[1])
    sf = "/root/testdata/sf0.01"
    got = quality.op4_quality(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(got) > 30 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    _, model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    y = np.array([[0.0] * len(quality.FEATURES)])
    cov = [np.linalg.inv(f) @ np.linalg.inv(f).T for f in model.factor]
    dens = [c0 - 0.5 * ((y - m) @ np.linalg.inv(c) @ (y - m).T).item() for c0, m, c in zip(model.constant, model.mean, cov)]
    assert np.isclose(model.score(y)[0], 1 / (1 + np.exp(-np.clip((dens[1] - dens[0]) / quality.TEMPER, -30, 30))))
    assert quality.keep(odd, labels.limit(0)).count() == len(TEXTS) and quality.keep(odd, labels).columns == odd.columns


def test_names_and_pipeline(spark, sf_dir):
    import __spark_entry__ as entry
    import corpus_pipeline as p

    names = entry.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d", n)} == set(range(1, 11))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, step in p.STAGES:
        docs2 = step(spark, docs, sf_dir)
        if name != "pack":
            assert docs2.columns == docs.columns
        docs = p.stage(docs2, name)
        seen.append(docs.count())
    assert seen[1] == seen[2] >= seen[3] >= seen[4] > 0
    assert docs.select(F.sum("length")).first()[0] > 0
