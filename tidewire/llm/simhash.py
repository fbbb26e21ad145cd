"""Near-duplicate documents: 64-bit SimHash, linked by anchor-point covering.

Fingerprints that differ in at most three bits agree, but for one bit at most,
on one half of 32 bits.  For each half the anchors are a covering code of radius
1: the perfect Hamming code of length 31, times both values of the last bit.  A
fingerprint is at home at the one anchor within the radius and is replicated to
every anchor within radius plus threshold (1 + 1), 17 at most, so two linked
fingerprints meet at the home of either.  At each anchor homes are compared with
all members by popcount over all 64 bits, so no link is lost and none invented.

Equal fingerprints are one class before that, so a large group of exact copies
is one row.  Where an anchor has more homes than ``HOMES`` or more members than
``MEMBERS``, blocks of homes meet blocks of members, so the work of a task is
bounded by their product.  Only spanning links leave an anchor, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .skew import lookup
from .storage import stage, table
from .textnum import tidy

THRESHOLD = 3
SHINGLE = 3
SEED = 42
HOMES, MEMBERS = 5_000, 100_000
#: Pairs that are compared at once.
PAIRS = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _hashes(text: str | None) -> list[int]:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(line, SEED)]
    starts = np.zeros(len(words), np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    ends = (starts + sizes)[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)]


def fingerprint(text: str | None) -> int:
    """One text's fingerprint, as an unsigned number."""
    return int(fingerprints([text])[0])


def fingerprints(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    todo, sizes, rows = [], [], []

    def flush() -> None:
        if not rows:
            return
        bits = np.unpackbits(np.array(todo, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = np.zeros(len(sizes), np.int64)
        np.cumsum(sizes[:-1], out=at[1:])
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        major = 2 * ones > np.array(sizes)[:, None]
        out[rows] = np.packbits(major, axis=1).view(">u8").ravel()
        todo.clear(), sizes.clear(), rows.clear()

    for i, text in enumerate(texts):
        if h := _hashes(text):
            todo.extend(h)
            sizes.append(len(h))
            rows.append(i)
            if len(todo) > 60_000:
                flush()
    flush()
    return out


@tidy
def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            fp = fingerprints(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), part.column(2)], ["doc_id", "fp", "th"])


# -- the covering code ------------------------------------------------------

def _syndromes() -> np.ndarray:
    """Of each 16-bit word: XOR of the (1-based) places of its bits; two tables, low and high."""
    n = np.arange(1 << 16, dtype=np.uint32)
    out = np.zeros((2, 1 << 16), np.uint32)
    for bit in range(31):
        word, at = divmod(bit, 16)
        out[word] ^= ((n >> np.uint32(at)) & np.uint32(1)) * np.uint32(bit + 1)
    return out


_SYN = _syndromes()


def anchors(half: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, anchor, home) of 32-bit words: the home anchor, then all others within distance 2.

    Bits 0-30 are decoded by the Hamming code (parity checks are the binary
    places 1-31), bit 31 is taken as it is.
    """
    half = half.astype(np.uint32)
    rows = np.arange(len(half))
    syn = _SYN[0][half & np.uint32(0xFFFF)] ^ _SYN[1][(half >> np.uint32(16)) & np.uint32(0x7FFF)]
    flip = np.where(syn > 0, np.uint32(1) << (np.maximum(syn, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    home = half ^ flip
    out = [(rows, home, True), (rows, home ^ np.uint32(1 << 31), False)]
    # bit 31 flipped costs one and the decoding at most one: that anchor is within 2
    for p in range(1, 32):  # flips p and p ^ syn lead to a codeword at distance 2
        q = syn ^ np.uint32(p)
        ok = (syn > 0) & (q > p)
        r = rows[ok]
        out.append((r, half[ok] ^ np.uint32(1 << (p - 1)) ^ (np.uint32(1) << (q[ok] - np.uint32(1))), False))
    return out


@tidy
def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 20_000):
            part = batch.slice(i, 20_000)
            fp = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            cells, idx, homes = [], [], []
            for which, half in enumerate((fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))):
                for rows, anchor, home in anchors(half):
                    cells.append(anchor.astype(np.int64) | np.int64(which << 32))
                    idx.append(rows)
                    homes.append(np.full(len(rows), home))
            idx = np.concatenate(idx)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells)), pa.array(fp.view(np.int64)[idx]), pa.array(np.concatenate(homes))],
                ["cell", "fp", "home"],
            )


# -- comparing at an anchor -------------------------------------------------

def _contract(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make the labels of linked rows equal, to the smallest index."""
    while True:
        a, b = label[i], label[j]
        diff = a != b
        if not diff.any():
            return
        i, j, a, b = i[diff], j[diff], a[diff], b[diff]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def spanning(group: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, int]:
    """For rows sorted by group, homes first: each row's label, the first row it is linked with, and the pairs compared.

    Homes are compared with the rows after them in their group, other rows not with each other.
    """
    n = len(group)
    label = np.arange(n)
    rows = np.flatnonzero(home)
    after = np.searchsorted(group, group[rows], "right") - rows - 1
    rows, after = rows[after > 0], after[after > 0]
    total = np.cumsum(after)
    got_i, got_j, held, a = [], [], 0, 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        own = after[a:b]
        i = np.repeat(rows[a:b], own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        ok = np.flatnonzero(np.bitwise_count(fp[i] ^ fp[j]) <= THRESHOLD)
        got_i.append(i[ok])
        got_j.append(j[ok])
        held += len(ok)
        if held > PAIRS:
            _contract(label, np.concatenate(got_i), np.concatenate(got_j))
            got_i, got_j, held = [], [], 0
        a = b
    if held:
        _contract(label, np.concatenate(got_i), np.concatenate(got_j))
    return label, int(total[-1]) if len(total) else 0


@tidy
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, fp, home) sorted by cell and part, homes first; a group that a batch cuts is carried over."""
    held: list[list[np.ndarray]] = []

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        cell, part, fp, home = cols
        group = np.cumsum(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        label, _ = spanning(group, fp.view(np.uint64), home)
        sel = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[sel]), pa.array(fp[label[sel]])], ["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        held.append(cols)
        if held[0][0][0] == cols[0][-1] and held[0][1][0] == cols[1][-1]:
            continue
        cols = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
        held = [[c[cut:].copy() for c in cols]]
        yield solve([c[:cut] for c in cols])
    if held:
        yield solve([np.concatenate(x) for x in zip(*held)])


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, th) of each row, staged; th is the hash of the text."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return stage(rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long, th long"), "fingerprints")


def _classes(marks: DataFrame) -> DataFrame:
    """(fp, rep, n, comp), staged: the classes of equal fingerprints; comp is a fingerprint that all linked classes share."""
    classes = stage(marks.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    rows = classes.select("fp").mapInArrow(_replicas, "cell long, fp long, home boolean")
    size = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("members"))
    hot = stage(size.filter((F.col("homes") > HOMES) | ((F.col("members") > MEMBERS) & (F.col("homes") > 0))), "hot_anchors")
    dealt = rows.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        h, m = (F.coalesce(F.ceil(F.col(c) / most), F.lit(1)).cast("int") for c, most in (("homes", HOMES), ("members", MEMBERS)))
        own = F.pmod(F.xxhash64("fp"), h).cast("int")  # the block of a home, and of a member
        other = F.pmod(F.xxhash64("fp", F.lit(1)), m).cast("int")
        as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct((own * m + j).alias("part"), F.lit(True).alias("home"))))
        as_member = F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.struct((i * m + other).alias("part"), F.lit(False).alias("home")))
        both = F.concat(F.coalesce(as_home, F.expr("cast(array() as array<struct<part:int,home:boolean>>)")), as_member)
        at = F.when(F.col("homes").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.col("home").alias("home")))).otherwise(both)
        # hot anchors hold over HOMES rows each, so there are few; still they are joined by a shuffle if they outgrow a broadcast
        dealt = rows.join(hot, "cell", "left").select("cell", "fp", F.explode(at).alias("at")).select("cell", "fp", "at.part", "at.home")
    dealt = dealt.select("cell", "part", "fp", "home").repartition("cell", "part").sortWithinPartitions("cell", "part", F.desc("home"))
    found = components(dealt.mapInArrow(_links, "a long, b long"))
    linked = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("comp"))
    return stage(linked, "linked", done=(classes, hot))


def _named(classes: DataFrame) -> DataFrame:
    """(fp, n, component_id) of classes: the smallest doc_id of all classes with the same comp."""
    linked = classes.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("k"))
    many = linked.filter("k > 1")
    total = classes.count()
    return lookup(classes.select("fp", "rep", "n", "comp"), many, "comp", "k", total).select("fp", "n", F.coalesce("component_id", "rep").alias("component_id"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Null and empty texts, and those of separators only, have fingerprint zero
    and are linked like any other.  A repeated row returns as often as it came;
    different texts under one doc_id are linked by their fingerprints only.
    Other columns are ignored.  An empty table gives no rows.  A row without
    doc_id is linked like any other, and names a component only where no row
    has an id.
    """
    marks = _marks(docs).select("doc_id", "fp")
    classes = _classes(marks)
    named = _named(classes).filter("n > 1 or component_id is not null")
    out = lookup(marks, named, "fp", "n", marks.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def dedupe(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, columns as they were.

    It is the row with the smallest doc_id, of several with that id the one with
    the smallest hash of the text; so different texts under one doc_id stay where
    they aren't alike, and equal rows become one.  Rows without doc_id stay.
    Null and empty texts are alike.
    """
    marks = _marks(docs.filter("doc_id is not null"))
    classes = _classes(marks.select("doc_id", "fp"))
    firsts = marks.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min_by("th", F.struct("doc_id", "th")).alias("th"))
    winners = classes.join(firsts, "fp").groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("w")).select("w.doc_id", "w.th")
    rows = docs.filter("doc_id is not null").select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    kept = rows.join(winners, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]).select("row.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
