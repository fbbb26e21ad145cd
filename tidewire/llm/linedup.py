"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words (A-Z as a-z).  Words are ordered from rare to
common; two sets with Jaccard similarity of 4/5 or more then share a word among
their first n - ceil(4n/5) + 1, so only those prefixes are joined.  Length,
position and a bitmap of the set rule out most pairs that share a prefix word;
what is left is verified on the whole sets.  A line goes if any similar line
comes before it, in order of doc_id and place.

Words are told apart by 64-bit hashes under a key that each call draws anew, so
prepared collisions do not work; equal lines are those with equal 128-bit hashes
of their words.  Counts, prefixes and filters only decide what is looked at.

How it is spread:

1. one pass over the texts gives each line's class (hash of its words), and counts
   words in a table of fixed size, which is all the order needs: whatever the
   counts, the order is the same everywhere, so the join stays exact;
2. a second pass gives the prefixes, each class once a task; they meet by word,
   and only postings with a likely partner come out, never pairs;
3. a third pass over the texts that hold them first fetches the sets of those
   classes; pairs are verified where their first common word is, and each class
   gets its links and its earliest partner.

A word that would gather too many postings is dealt to blocks and pairs of blocks.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import lookup
from .storage import release, stage, table
from .textnum import Words, mix, signed, slices, tidy

NUM, DEN = 4, 5
#: Lines without words are left alone; the bound on prefixes holds from one word on.
MIN_WORDS = 1
#: The table of word counts has 2 ** BITS entries of two bytes each once it is merged.
BITS = 22
CHUNKS = 64
#: Places for classes that a task remembers, so as to send a repeated line once.
REMEMBER = 1 << 19
#: Occurrences of a word for which its postings get one block; more get more blocks.
PER_BLOCK = 1 << 15
#: Sets that are compared pair by pair; more are compared by matrices of BLOCK rows and WIDE words at a time.
FEW, BLOCK, WIDE = 24, 512, 4096
#: Rows that are compared at once, or a whole group.
ROWS = 1 << 16
_ONCE = 64  # the code of a count of one; doubling a large count adds as much


def _ceil(n, num: int, den: int):
    return (num * n + den - 1) // den


class Lines:
    """The lines of a slice that count: place, number of words and class.

    The class, ``cls`` and ``cls2``, is a hash of the words with their repeats, in any
    order, so lines of different classes may still be equal as sets; the join
    finds that.
    """

    def __init__(self, column: pa.Array, key: int = 0):
        w = Words(column, key)
        if not len(w.start):
            self.doc = self.line = self.size = self.first = np.empty(0, np.int64)
            self.cls = self.cls2 = self.hash = np.empty(0, np.uint64)
            return
        first = np.flatnonzero(np.r_[True, (w.doc[1:] != w.doc[:-1]) | (w.line[1:] != w.line[:-1])])
        self.hash, self.first, self.size = w.hash, first, np.diff(np.r_[first, len(w.hash)])
        self.doc, self.line = w.doc[first], w.line[first]
        h = mix(self.hash, 0x5BD1E995)
        self.cls = mix(np.add.reduceat(h, first), 0x27D4EB2F)
        self.cls2 = mix(np.add.reduceat((h ^ (h >> np.uint64(31))) * h, first), 0x165667B1)


class Sets:
    """The sets of words of some of the lines, each in order of rarity: hash, code, start and number ``n``."""

    def __init__(self, lines: Lines, which: np.ndarray, codes: np.ndarray):
        size = lines.size[which]
        begin = np.cumsum(size) - size
        at = np.repeat(lines.first[which] - begin, size) + np.arange(int(size.sum()))
        h = lines.hash[at]
        gid = np.repeat(np.arange(len(size)), size)
        code = codes[bucket(h)].astype(np.uint64)
        # line, rarity and hash in one key; equal words are neighbours, so comparing whole hashes finds repeats
        bits = max(1, int(len(size)).bit_length())
        key = (gid.astype(np.uint64) << np.uint64(64 - bits)) | (code << np.uint64(64 - bits - 12)) | (h >> np.uint64(bits + 12))
        order = np.argsort(key)
        sorted_key, sorted_hash = key[order], h[order]
        if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_hash[1:] != sorted_hash[:-1])).any():  # the key holds a part of the hash only
            order = np.lexsort((h, key))
        h, code, gid = h[order], code[order], gid[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (gid[1:] != gid[:-1])
        self.hash, self.code, self.gid = h[once], code[once].astype(np.int64), gid[once]
        self.n = np.bincount(self.gid, minlength=len(size))
        self.start = np.cumsum(self.n) - self.n


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


# -- counting in a table of fixed size --------------------------------------

def _pack(at: np.ndarray, count: np.ndarray) -> bytes:
    return zlib.compress(at.astype("<i4").tobytes() + count.astype("<i8").tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<i8", n, 4 * n)


def _blobs(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The entries that aren't zero, chunk by chunk."""
    at = np.flatnonzero(counts)
    edge = np.searchsorted(at, np.arange(CHUNKS + 1) * ((1 << BITS) // CHUNKS))
    for k in range(CHUNKS):
        own = at[edge[k] : edge[k + 1]]
        if len(own):
            yield k, _pack(own - k * ((1 << BITS) // CHUNKS), counts[own])


def _add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << BITS) // CHUNKS, np.int64)
    for blob in frame["counts"]:
        at, count = _unpack(blob)
        total[at] += count
    at = np.flatnonzero(total)
    return pd.DataFrame({"chunk": [int(key[0])], "part": [0], "counts": [_pack(at, total[at])]})


def _merged(blobs: DataFrame) -> np.ndarray:
    """Codes of 2 ** BITS counts, from (chunk, part, counts): two rounds, so no task adds up more than a share."""
    schema = "chunk int, part int, counts binary"
    one = blobs.groupBy("chunk", "part").applyInPandas(_add, schema)
    two = one.groupBy("chunk").applyInPandas(_add, schema)
    out = np.zeros((CHUNKS, (1 << BITS) // CHUNKS), np.uint16)
    for r in two.collect():  # CHUNKS rows of fixed size
        at, count = _unpack(r.counts)
        out[r.chunk, at] = np.minimum(4095, np.floor(_ONCE * np.log2(1.0 + count)))
    return out.ravel()


# -- the passes over the texts ----------------------------------------------

_LINE = "doc_id long, th long, line_no int, cls long, cls2 long, n int, chunk int, part int, counts binary"


def _line_batches(key: int) -> object:
    """doc_id, th, text to a row for each line that counts, one for each document (line_no -1), and the counts."""
    names = [x.split()[0] for x in _LINE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def rows(*cols) -> pa.RecordBatch:
        size = len(cols[0])
        full = [c if isinstance(c, pa.Array) else pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds)]
        return pa.RecordBatch.from_arrays(full, names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(2)):
                part = batch.slice(a, b - a)
                x = Lines(part.column(2), key)
                np.add.at(counts, bucket(x.hash), 1)
                at = pa.array(x.doc)
                each = np.bincount(x.doc, minlength=b - a).astype(np.int32) if len(x.doc) else np.zeros(b - a, np.int32)
                yield rows(part.column(0).take(at), part.column(1).take(at), x.line.astype(np.int32), signed(x.cls), signed(x.cls2), x.size.astype(np.int32), None, None, None)
                yield rows(part.column(0), part.column(1), np.full(b - a, -1, np.int32), None, None, each, None, None, None)
        got = list(_blobs(counts))
        if got:
            none = pa.nulls(len(got), pa.int64())
            share = TaskContext.get().partitionId() % 256
            yield rows(none, none, None, None, None, None, [k for k, _ in got], [share] * len(got), [c for _, c in got])

    return run


class _Memory:
    """Which classes a task has sent already; a class may push out another, which is then sent again."""

    def __init__(self):
        self.one, self.two = np.zeros(REMEMBER, np.uint64), np.zeros(REMEMBER, np.uint64)
        self.owner = np.zeros(REMEMBER, np.int64)

    def fresh(self, cls: np.ndarray, cls2: np.ndarray) -> np.ndarray:
        """Places of classes that are new, each once where its place in the table is not contested."""
        at = (cls % np.uint64(REMEMBER)).astype(np.int64)
        new = np.flatnonzero((self.one[at] != cls) | (self.two[at] != cls2))
        at = at[new]
        self.owner[at[::-1]] = new[::-1]
        first = self.owner[at]
        self.one[at], self.two[at] = cls[first], cls2[first]
        return new[(first == new) | (cls[first] != cls[new]) | (cls2[first] != cls2[new])]


def _blocks(code: np.ndarray) -> np.ndarray:
    """Blocks for the postings of words with these codes."""
    return np.ceil(np.exp2(code / _ONCE) / PER_BLOCK).astype(np.int64).clip(1)


def _posting_batches(shared, key: int) -> object:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, memory = np.frombuffer(shared.value, np.uint16), _Memory()
        for batch in batches:
            text = batch.column(0)
            for a, b in slices(text):
                x = Lines(text.slice(a, b - a), key)
                which = memory.fresh(x.cls, x.cls2)
                if not len(which):
                    continue
                y = Sets(x, which, codes)
                i = np.arange(len(y.hash)) - y.start[y.gid]
                probe = y.n - _ceil(y.n, NUM, DEN) + 1
                bit = mix(y.hash, 77)
                mask, upper = np.uint64(1) << (bit >> np.uint64(58)), (bit & np.uint64(1)).astype(bool)
                low, high = (np.bitwise_or.reduceat(np.where(u, mask, np.uint64(0)), y.start) for u in (~upper, upper))
                sel = np.flatnonzero((i < probe[y.gid]) & (y.code != _ONCE))
                g = y.gid[sel]
                tok, cls, n, i, low, high = y.hash[sel], x.cls[which[g]], y.n[g], i[sel], low[g], high[g]
                blocks = _blocks(y.code[sel])
                own = (cls % blocks.astype(np.uint64)).astype(np.int64)
                if (blocks > 1).any():  # a copy for each block that its own is paired with
                    rep = np.repeat(np.arange(len(tok)), blocks)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    tok, cls, n, i, low, high, own = (v[rep] for v in (tok, cls, n, i, low, high, own))
                    pair = np.where(blocks[rep] > 1, (blocks[rep] << 40) | (np.minimum(own, other) << 20) | np.maximum(own, other), 0)
                else:
                    pair = np.zeros(len(tok), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(tok)), pa.array(pair), pa.array(signed(cls)), pa.array(signed(low)), pa.array(signed(high)), pa.array((n << 32) | i)],
                    ["tok", "pair", "cls", "low", "high", "ni"],
                )

    return run


def _set_batches(shared, wanted, texts, key: int) -> object:
    """th, text to sets of the lines whose class may be wanted, in order of rarity; reads only texts that may hold the first line of one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, want, hold, memory = *(np.frombuffer(x.value, np.uint16) for x in (shared, wanted, texts)), _Memory()
        for batch in batches:
            th = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            text = batch.column(1).filter(pa.array(hold[bucket(th)] > 0))
            for a, b in slices(text):
                x = Lines(text.slice(a, b - a), key)
                maybe = np.flatnonzero(want[bucket(x.cls)] > 0)
                maybe = maybe[memory.fresh(x.cls[maybe], x.cls2[maybe])]
                if not len(maybe):
                    continue
                y = Sets(x, maybe, codes)
                words = [y.hash[s : s + n].tobytes() for s, n in zip(y.start, y.n)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(x.cls[maybe])), pa.array(signed(x.cls2[maybe])), pa.array(words, pa.binary())], ["cls", "cls2", "words"])

    return run


@tidy
def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        np.add.at(counts, bucket(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), 1)
    got, share = list(_blobs(counts)), TaskContext.get().partitionId() % 256
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([share] * len(got), pa.int32()), pa.array([c for _, c in got], pa.binary())], ["chunk", "part", "counts"])


# -- meeting by word --------------------------------------------------------

def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Columns of whole groups, ROWS rows or more at a time; rows come sorted by the first ``keys`` columns."""
    held: list[list] = []
    size = 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        held.append(cols)
        size += len(cols[0])
        if size < ROWS or all(held[0][k][0] == cols[k][-1] for k in range(keys)):
            continue  # a group that goes on is not copied until it ends
        cols = [np.concatenate(x) for x in zip(*held)]
        same = np.logical_and.reduce([cols[k] == cols[k][-1] for k in range(keys)])
        cut = int(np.argmax(same))
        held, size = [[c[cut:].copy() for c in cols]], len(cols[0]) - cut
        yield [c[:cut] for c in cols]
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the group of each row of sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


@tidy
def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by tok: those with a partner that length, position and bitmap allow."""
    for tok, pair, cls, low, high, ni in _grouped(batches, 1):
        order = np.lexsort((ni, pair, tok)) if pair.any() else np.lexsort((ni, tok))
        tok, pair, cls, low, high, ni = (c[order] for c in (tok, pair, cls, low, high, ni))
        low, high = low.view(np.uint64), high.view(np.uint64)
        n, left = (ni >> 32).astype(np.int32), ((ni >> 32) - (ni & 0xFFFFFFFF)).astype(np.int32)
        place = (_groups(tok, pair) << 32) | n
        # partners of a row are the rows after it up to a quarter longer, in its group
        reach = np.searchsorted(place, place + n * DEN // NUM - n, "right") - np.arange(len(tok)) - 1
        good = np.zeros(len(tok), bool)
        rows = np.argsort(-reach, kind="stable")
        far = -reach[rows]
        for shift in range(1, int(-far[0]) + 1 if len(far) else 1):
            a = rows[: np.searchsorted(far, -shift, "right")]
            b = a + shift
            both = n[a] + n[b]
            need = _ceil(both, NUM, NUM + DEN)
            ok = np.flatnonzero(np.minimum(left[a], left[b]) >= need)
            a, b = a[ok], b[ok]
            apart = np.bitwise_count(low[a] ^ low[b]).astype(np.int32) + np.bitwise_count(high[a] ^ high[b])
            ok = (apart <= (both - 2 * need)[ok]) & (cls[a] != cls[b])
            good[a[ok]] = True
            good[b[ok]] = True
        sel = np.flatnonzero(good)
        if not len(sel):
            continue
        sel = sel[np.lexsort((cls[sel], pair[sel], tok[sel]))]  # several tasks may have sent a class: one row is enough
        t, p, c = tok[sel], pair[sel], cls[sel]
        sel = sel[np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (c[1:] != c[:-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(tok[sel]), pa.array(pair[sel]), pa.array(cls[sel])], ["tok", "pair", "cls"])


_LINKS = "cls long, cls2 long, links long, p_doc long, p_th long, p_line int"


@tidy
def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tok, pair, cls, cls2, words, doc_id, th, line_no sorted by (tok, pair): links and earliest partner of each class."""
    for tok, pair, cls, cls2, words, doc, th, line in _grouped(batches, 2):
        group = _groups(tok, pair)
        order = np.lexsort((line, th, doc, group))
        edge = np.searchsorted(group, np.arange(group[-1] + 2))
        out_at, out_n, out_p = [], [], []
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a < 2:
                continue
            at, word = order[a:b], np.uint64(tok[a].view(np.uint64))
            sets = [np.frombuffer(words[k], np.uint64) for k in at]
            solve = _few_links if len(at) <= FEW else _links_of
            got = solve(word, sets, cls[at].view(np.uint64), int(pair[a]))
            for k, (n, p) in got.items():
                out_at.append(at[k])
                out_n.append(n)
                out_p.append(at[p])
        c, p = np.array(out_at, np.int64), np.array(out_p, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls[c], pa.int64()), pa.array(cls2[c], pa.int64()), pa.array(out_n, pa.int64()), pa.array(doc[p], pa.int64()), pa.array(th[p], pa.int64()), pa.array(line[p], pa.int32())],
            ["cls", "cls2", "links", "p_doc", "p_th", "p_line"],
        )


def _sides(cls: np.ndarray, pair: int) -> np.ndarray | None:
    """For a group of two blocks of a word's postings, the block of each class: pairs within one belong to that block's own group."""
    two = pair and (pair >> 20 & 0xFFFFF) != (pair & 0xFFFFF)
    return cls % np.uint64(pair >> 40) if two else None


def _few_links(tok: np.uint64, sets: list[np.ndarray], cls: np.ndarray, pair: int) -> dict[int, tuple[int, int]]:
    """What _links_of says, pair by pair: less work where sets are few."""
    lists = [s.tolist() for s in sets]
    bags = [frozenset(x) for x in lists]
    word = int(tok)
    heads = [x[: x.index(word)] if word in bag else x for x, bag in zip(lists, bags)]
    side = _sides(cls, pair)
    side = side.tolist() if side is not None else None
    out: dict[int, tuple[int, int]] = {}
    for j in range(1, len(bags)):
        for i in range(j):
            if side and side[i] == side[j]:
                continue
            common = len(bags[i] & bags[j])
            if common * DEN >= NUM * (len(bags[i]) + len(bags[j]) - common) and word in bags[i] and bags[j].isdisjoint(heads[i]):
                for x, y in ((i, j), (j, i)):
                    n, first = out.get(x, (0, len(bags)))
                    out[x] = (n + 1, min(first, y))
    return out


def _links_of(tok: np.uint64, sets: list[np.ndarray], cls: np.ndarray, pair: int) -> dict[int, tuple[int, int]]:
    """For sets in order of place: {k: (links, first partner)}, of pairs whose first common word is ``tok``.

    Common words are counted by products of 0/1 matrices over the words of the
    group, BLOCK sets and WIDE words at a time.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    mark = np.full(m, -1)
    hit = np.flatnonzero(flat == tok)
    mark[row[hit]] = place[hit]
    _, col = np.unique(flat, return_inverse=True)
    shared = np.bincount(col) > 1  # a word of one set only is common to none
    new = np.cumsum(shared) - 1
    use, width = shared[col], int(shared.sum())
    row, col, place = row[use], new[col[use]], place[use]
    before = place < mark[row]
    start = np.searchsorted(row, np.arange(m + 1))
    side = _sides(cls, pair)
    links = np.zeros(m, np.int64)
    partner = np.full(m, m, np.int64)

    def matrix(a: int, b: int, low: int, high: int, which: np.ndarray | None = None) -> np.ndarray:
        own = slice(start[a], start[b])
        r, c = row[own], col[own]
        sel = (c >= low) & (c < high)
        if which is not None:
            sel &= which[own]
        x = np.zeros((b - a, high - low), np.float32)
        x[r[sel] - a, c[sel] - low] = 1
        return x

    for a in range(0, m, BLOCK):
        b = min(a + BLOCK, m)
        for c in range(a, m, BLOCK):
            d = min(c + BLOCK, m)
            common, early = np.zeros((b - a, d - c), np.float32), np.zeros((b - a, d - c), np.float32)
            words = np.unique(np.concatenate([col[start[a] : start[b]], col[start[c] : start[d]]]))
            for low in range(int(words[0]), int(words[-1]) + 1, WIDE) if len(words) else ():
                high = min(low + WIDE, width)
                right = matrix(c, d, low, high).T
                common += matrix(a, b, low, high) @ right
                early += matrix(a, b, low, high, before) @ right
            ok = (common * DEN >= NUM * (n[a:b, None] + n[None, c:d] - common)) & (early == 0)
            ok &= (mark[a:b, None] >= 0) & (mark[None, c:d] >= 0)
            if c == a:
                ok = np.triu(ok, 1)
            i, j = np.nonzero(ok)
            i, j = i + a, j + c
            if side is not None:
                other = side[i] != side[j]
                i, j = i[other], j[other]
            links += np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
            np.minimum.at(partner, j, i)
            np.minimum.at(partner, i, j)
    return {int(k): (int(links[k]), int(partner[k])) for k in np.flatnonzero(links)}


# -- the operator -----------------------------------------------------------

def similar_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, n, m_doc, m_line, links): every line that counts, and a row of line_no -1 for each document.

    th is the hash of the text.  m_doc and m_line are the earliest line that is
    similar, if it comes before; links counts the different similar sets.
    """
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    spark, key = docs.sparkSession, secrets.randbits(63)
    first = stage(d.mapInArrow(_line_batches(key), _LINE), "lines")
    blobs = first.filter("chunk is not null").select("chunk", "part", "counts")
    codes = spark.sparkContext.broadcast(_merged(blobs).tobytes())
    lines = first.filter("chunk is null").select("doc_id", "th", "line_no", "cls", "cls2", "n")
    own = F.struct("doc_id", "th", "line_no")
    classes = lines.filter("line_no >= 0").groupBy("cls", "cls2").agg(F.count("*").alias("copies"), F.min(own).alias("first"))
    classes = stage(classes, "classes")

    postings = d.select("text").mapInArrow(_posting_batches(codes, key), "tok long, pair long, cls long, low long, high long, ni long")
    met = postings.repartition("tok", "pair").sortWithinPartitions("tok")
    likely = met.mapInArrow(_candidate_batches, "tok long, pair long, cls long")
    places = classes.select("cls", "cls2", "first.doc_id", "first.th", "first.line_no")
    likely = stage(likely.join(places, "cls"), "likely")
    del postings, met
    release(spark)
    wanted, texts = (
        spark.sparkContext.broadcast(_merged(likely.select(c).mapInArrow(_class_counts, "chunk int, part int, counts binary")).tobytes()) for c in ("cls", "th"))
    sets = d.select("th", "text").mapInArrow(_set_batches(codes, wanted, texts, key), "cls long, cls2 long, words binary")
    sets = sets.groupBy("cls", "cls2").agg(F.max("words").alias("words"))
    full = likely.join(sets, ["cls", "cls2"]).select("tok", "pair", "cls", "cls2", "words", "doc_id", "th", "line_no")
    dealt = full.repartition("tok", "pair").sortWithinPartitions("tok", "pair")
    partner = F.struct(F.col("p_doc").alias("doc_id"), F.col("p_th").alias("th"), F.col("p_line").alias("line_no"))
    links = dealt.mapInArrow(_verify_batches, _LINKS).groupBy("cls", "cls2").agg(F.sum("links").alias("links"), F.min(partner).alias("partner"))

    told = classes.join(links, ["cls", "cls2"], "left").filter("copies > 1 or links is not null")
    told = stage(told.select("cls", "cls2", "copies", "links", F.least("first", F.coalesce("partner", "first")).alias("early")), "told", done=(likely, classes))
    counted = lines.filter("line_no >= 0")
    out = lookup(counted, told, ["cls", "cls2"], "copies", counted.count())
    whole = lines.filter("line_no < 0")
    out = out.unionByName(whole, allowMissingColumns=True)
    later = own > F.col("early")
    return out.select(
        "doc_id", "th", "line_no", "n", F.coalesce("links", F.lit(0)).alias("links"),
        F.when(later, F.col("early.doc_id")).alias("m_doc"), F.when(later, F.col("early.line_no")).alias("m_line"), F.coalesce(later, F.lit(False)).alias("later"),
    )


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without lines that are similar to an earlier one; n_chars, if there is one, follows.

    Null and empty texts stay as they are, a text whose lines all go becomes empty,
    repeated rows (same doc_id and text) lose the same lines, ties of doc_id are
    taken by the hash of the text, an empty table gives no rows.
    """
    gone = similar_lines(docs).filter("later").groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("gone"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), key.alias("th"))
    j = d.join(gone, d["doc_id"].eqNullSafe(gone["doc_id"]) & (d["th"] == gone["th"]), "left").select("row", "gone")
    lines = F.split("row.text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    kind = dict(docs.dtypes)

    def value(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            return F.when(F.col("gone").isNull(), F.col("row").getField(c)).otherwise(F.char_length(text).cast(kind[c])).alias(c)
        return F.col("row").getField(c).alias(c)

    return j.select(*(value(c) for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its lines, which of them go, its class and links.

    class_id is the smallest doc_id that holds a similar line before one of its
    own, or else its own id; n_links adds up the different sets that its lines
    are similar to; removed lists line:doc:line for each line that goes and the
    earliest line like it.  Null and empty texts have no lines.  Repeated rows
    (same doc_id and text) are one document.  Lines without words stay.
    """
    s = similar_lines(table(spark, sf_dir, "documents"))
    line = F.when(F.col("later"), F.struct("line_no", F.concat_ws(":", "line_no", "m_doc", "m_line").alias("what")))
    g = s.groupBy("doc_id", "th").agg(
        F.max(F.when(F.col("line_no") < 0, F.col("n"))).alias("n_lines"),
        F.sum(F.when(F.col("later"), 1).otherwise(0)).alias("n_removed"),
        F.coalesce(F.least(F.min("m_doc"), F.col("doc_id")), F.col("doc_id")).alias("class_id"),
        F.sum("links").alias("n_links"),
        F.array_join(F.transform(F.sort_array(F.collect_set(line)), lambda x: x["what"]), ",").alias("removed"),
    )
    return g.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "n_removed", "class_id", "n_links", "removed")
