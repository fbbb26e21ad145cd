"""Packing documents into sequences by sum of squares.

Each piece goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being
the number of open sequences with g tokens free; a new sequence is one of the
choices while there are fewer than the tokens need at least, and after that only
where nothing else fits.  The state is one count and one stack per gap.  Pieces
are dealt to shards of some PER_SHARD pieces, each shard takes its own from the
longest to the shortest, and so no task needs another's state: what a shard loses
is its last few sequences, and their number follows from the pieces alone.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stage, table
from .textnum import hashes, raw, slices, tidy

CAPACITY = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
#: Places for words in the table of a Python worker, and ids kept for them.
SLOTS, CACHE = 1 << 20, 4_000_000
#: Pieces that are packed together.
PER_SHARD = 20_000


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: What the bytes of a text below U+0100 belong to: white space, letters, single numbers, anything else.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each byte: of ASCII, and of the second byte after C2 and after C3."""
    import regex

    is_space, is_letter, is_number = (regex.compile(x).match for x in (r"\s", r"\p{L}", r"\p{N}"))

    def kind(c: str) -> int:
        return _SPACE if is_space(c) else _LETTER if is_letter(c) else _NUMBER if is_number(c) else _OTHER

    ascii_, c2, c3 = (np.zeros(256, np.uint8) for _ in range(3))
    ascii_[:128] = [kind(chr(k)) for k in range(128)]
    c2[128:192] = [kind(chr(k)) for k in range(128, 192)]
    c3[128:192] = [kind(chr(k + 64)) for k in range(128, 192)]
    return ascii_, c2, c3


class WordIds:
    """Ids of texts by a tokenizer that cuts words first, with a bounded table of words.

    Whole slices of texts are lower-cased and cut at once, by the tokenizer's own
    rule: a contraction, a run of letters, one number, or a run of anything else
    but white space.  That is done for texts of characters below U+0100 without
    ``<|``, where normalising is only lower-casing; other texts go to the tokenizer
    whole.  Words that are not in the table are encoded together; each ends with
    the one id whose token closes a word.  The table tells words apart by a 64-bit
    hash under a key of the process.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.ascii, self.c2, self.c3 = _kinds()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.key = secrets.randbits(63)
        self._clear()

    def _clear(self) -> None:
        self.word = np.zeros(SLOTS, np.uint64)
        self.at, self.size = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        out, sizes = [], []
        for a in range(0, len(words), 5000):
            own = words[a : a + 5000]
            ids = self._encode(" ".join(own))
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(own):
                out.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = [self._encode(w) for w in own]
                out += each
                sizes.append(np.array([len(x) for x in each]))
        return np.concatenate(out), np.concatenate(sizes)

    def _cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case bytes, and start and end of each word."""
        n = len(data)
        low, kind = self.lower[data], self.ascii[data]
        second = np.flatnonzero(data >= 0xC2) + 1  # a lead byte has its second one in the same text
        if len(second):
            lead, trail = data[second - 1], data[second]
            kind[second] = kind[second - 1] = np.where(lead == 0xC2, self.c2[trail], self.c3[trail])
            upper = (lead == 0xC3) & (trail <= 0x9E) & (trail != 0x97)
            low[second[upper]] += 32
        new = np.zeros(n + 1, bool)
        new[off] = True
        new[1:n] |= kind[1:] != kind[:-1]
        new[:n] |= (kind == _NUMBER) & ((data & 0xC0) != 0x80)
        edge = np.flatnonzero(new)
        start, end = edge[:-1], edge[1:]
        used = kind[start] != _SPACE
        start, end = start[used], end[used]
        mark = np.flatnonzero((low[start] == 39) & (end - start == 1) & (end < n))
        if len(mark):  # 's 't 're 've 'm 'll 'd, however the letters go on
            mark = mark[(mark + 1 < len(start)) & (start[np.minimum(mark + 1, len(start) - 1)] == end[mark]) & ~np.isin(end[mark], off)]
            one = low[end[mark]]
            two = low[np.minimum(end[mark] + 1, n - 1)]
            room = end[np.minimum(mark + 1, len(end) - 1)] - end[mark]
            pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            take = np.where(np.isin(one, (115, 116, 109, 100)), 1, np.where(pair & (room > 1), 2, 0))
            mark, take = mark[take > 0], take[take > 0]
            end = end.copy()
            start = start.copy()
            end[mark] += take
            start[mark + 1] += take
            left = start < end
            start, end = start[left], end[left]
        return low, start, end

    def _places(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word are in ``flat``, and how many."""
        if self.used > CACHE:
            self._clear()
        h = hashes(low, start, end, self.key)
        slot = (h % np.uint64(SLOTS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero((self.word[slot] != h) | (size == 0))
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[first]
            ids, n = self._encode_words([low[a:b].tobytes().decode() for a, b in zip(start[one].tolist(), end[one].tolist())])
            new = self.used + np.cumsum(n) - n
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            at[miss], size[miss] = new[back], n[back]
            self.word[slot[one]], self.at[slot[one]], self.size[slot[one]] = h[one], new, n
        return at.astype(np.int64), size.astype(np.int64)

    def _rows(self, column: pa.Array) -> tuple:
        data, off = raw(column)
        odd = data > 0xC3
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        odd = np.unique(np.searchsorted(off, np.flatnonzero(odd), "right") - 1)
        whole = {int(k): self._encode(data[off[k] : off[k + 1]].tobytes().decode()) for k in odd}
        if whole:
            keep = np.ones(len(off) - 1, bool)
            keep[odd] = False
            size = np.where(keep, np.diff(off), 0)
            data, off = data[np.repeat(keep, np.diff(off))], np.r_[0, np.cumsum(size)]
        at = size = row = np.empty(0, np.int64)
        if len(data):
            low, start, end = self._cut(data, off)
            at, size = self._places(low, start, end)
            row = np.searchsorted(off, start, "right") - 1
        n = np.bincount(row, size, len(off) - 1).astype(np.int64) if len(row) else np.zeros(len(off) - 1, np.int64)
        for k, ids in whole.items():
            n[k] = len(ids)
        return at, size, row, n, whole

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text; null is empty."""
        return self._rows(column)[3]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END after each, and offsets of the texts."""
        at, size, row, n, whole = self._rows(column)
        off = np.r_[0, np.cumsum(n + 1)]
        out = np.full(off[-1], END, np.uint32)
        if len(at):
            begin = np.cumsum(size) - size  # among the ids of these words; other texts and END shift them
            first = np.searchsorted(row, np.arange(len(n)))
            base = np.where(first < len(row), begin[np.minimum(first, len(row) - 1)], 0)
            to = off[row] + begin - base[row]
            step = np.arange(int(size.sum())) - np.repeat(begin, size)
            out[np.repeat(to, size) + step] = self.flat[np.repeat(at, size) + step]
        for k, ids in whole.items():
            out[off[k] : off[k + 1] - 1] = ids
        return out, off


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(path: str, capacity: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(path).ids
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, off = encode(part.column(1))
                n = -(-np.diff(off) // capacity)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(off)[row] - start)
                raw_ids = memoryview(ids.astype("<u4", copy=False)).cast("B")
                first = 4 * (off[row] + start)
                crc = [zlib.crc32(raw_ids[x:y]) for x, y in zip(first.tolist(), (first + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


class SumOfSquares:
    """Open sequences by gap; place() says which one and where.

    While fewer than ``least`` sequences are there, a new one is a choice like the others.
    """

    def __init__(self, capacity: int, least: int = 1 << 62):
        self.capacity, self.least = capacity, least
        self.count = np.zeros(capacity + 1, np.int64)
        self.stacks: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        n, cap, never = self.count, self.capacity, np.iinfo(np.int64).max
        if size >= cap:
            self.made += 1
            return self.made - 1, 0
        # moving a sequence from gap g to g - size changes the sum by 2 (N(g - size) - N(g) + 1); gap 0 is closed
        cost = np.where(n[size:cap] > 0, 2 * (n[: cap - size] - n[size:cap] + 1), never)
        if n[size]:
            cost[0] = 1 - 2 * n[size]
        best = int(np.argmin(cost))
        if cost[best] < never and (cost[best] <= 2 * n[cap - size] + 1 or self.made >= self.least):
            gap = best + size
            at = self.stacks[gap].pop()
            n[gap] -= 1
        else:
            gap, at = cap, self.made
            self.made += 1
        if gap > size:
            n[gap - size] += 1
            self.stacks.setdefault(gap - size, []).append(at)
        return at, cap - gap


def _pack(capacity: int):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        state = SumOfSquares(capacity, -(-int(f["length"].sum()) // capacity))
        got = [state.place(x) for x in f["length"].tolist()]
        first = int(key[0]) << 40
        f = f.assign(sequence_id=[first | a for a, _ in got], offset=[b for _, b in got])
        return f.drop(columns="shard")

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each text and END, cut at ``capacity``."""
    run = _pieces(path or _tokenizer_path(), capacity)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """Every piece of every text, with its sequence and its place there.

    A null or empty text is the end mark alone.  Repeated rows are packed as
    often as they come, and dealt out one by one.  Ties are taken by doc_id and
    piece, rows without doc_id last; other columns are ignored; an empty table
    gives no rows.
    """
    made = stage(pieces(docs, path, capacity), "pieces")
    shards = shards or -(-made.count() // PER_SHARD) or 1
    dealt = made.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(_pack(capacity), schema)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
