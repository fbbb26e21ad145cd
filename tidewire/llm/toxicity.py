"""Toxicity: a support vector machine on a string subsequence kernel.

The kernel compares two words by the three-letter subsequences they share, each
weighted down for its gaps, so ``idxiot`` and ``i-d-i-o-t`` stay close to the word
they hide.  Landmarks are words, and beginnings of words, that speak for toxic
texts.  A text is pooled from its different words: for each landmark the largest
kernel value over ``FLOOR`` of any word, and the sum of them in proportion to the
number of words.  Both are mapped by the Nystroem factor of the landmarks' own
kernel matrix, and a linear SVM gives the text its margin.

The SVM is trained on the labelled texts, and on toxic ones once more with their
telling words disguised.  Training reads a bounded sample of labelled rows, at
most ``SAMPLE`` a class; scoring reads every word of every text.  A bound that
never lies below the kernel spares most words the full computation.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import discard, stage, table
from .textnum import Words, mix, slices, tidy

#: Labelled rows of a class that training reads, those with the smallest hash.
SAMPLE = 5000
#: Landmarks at most, chosen from so many words that tell most; less alike to each other than ALIKE.
LANDMARKS, CANDIDATES, ALIKE = 128, 1500, 0.7
#: Letters of the beginnings of words that may be landmarks.
STEMS = (4, 5, 6, 7)
#: Clean texts weigh so much more than toxic ones, and disguised texts so much less.
CAUTION, DISGUISE = 3.0, 0.5
#: How many words of a sample may become landmarks by chance alone; the evidence asked for follows from it.
CHANCE = 0.1
#: Places for words that a task remembers.
REMEMBER = 1 << 19
DECAY, SPAN, FLOOR = 0.7, 6, 0.5
LONGEST = 24  # with both edges
_LETTERS = LONGEST - 2
WIDTHS = (7, 9, 11, 13, 16, LONGEST)
THRESHOLD = 0.3

#: a-z are letters, digits are those they stand for, and bytes of other letters have 36 codes; the rest is left out.
_CODE = np.full(256, 255, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(26)
_CODE[list(b"013457")] = [ord(c) - 97 for c in "oieast"]
_CODE[128:] = 26 + np.arange(128) % 36
_BITS = 6
#: Stands before and after each word, so that its beginning and end count; and after that.
_EDGE, _NONE = 62, 63
_SPELL = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(2), np.uint8)
_STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


class Letters:
    """Different words of a slice, letters only, as rows of codes; and where they are.

    ``code`` (words, LONGEST), ``size``, ``key`` (a hash, rising); ``of`` and ``doc`` say for each
    occurrence which word it is and in which row.  Longer words are cut into
    pieces that overlap by half.  Three or more single letters in a row, with
    spaces between, are also one word.
    """

    def __init__(self, column: pa.Array):
        w = Words(column)
        data, n = w.data, len(w.start)
        codes = _CODE[data]
        mark = np.zeros(len(data) + 1, np.int64)
        mark[w.start] += 1
        mark[w.end] -= 1
        inside = np.cumsum(mark[:-1]) > 0
        token = np.cumsum(np.bincount(w.start, minlength=len(data))[: len(data)]) - 1 if n else np.empty(0, np.int64)
        keep = inside & (codes != 255)
        letter, token = codes[keep], token[keep]
        size = np.bincount(token, minlength=n) if n else np.empty(0, np.int64)
        begin = np.cumsum(size) - size
        doc = w.doc
        extra_code, extra_doc = [], []
        one = np.flatnonzero(size == 1)
        if len(one):
            for run in np.split(one, np.flatnonzero((np.diff(one) != 1) | (doc[one[1:]] != doc[one[:-1]])) + 1):
                if len(run) >= 3:
                    extra_code.append(letter[begin[run]])
                    extra_doc.append(doc[run[0]])
        for t in np.flatnonzero(size > _LETTERS):
            extra_code.append(letter[begin[t] : begin[t] + size[t]])
            extra_doc.append(doc[t])
        flat_code, flat_doc = [], []
        for c, d in zip(extra_code, extra_doc):
            for a in range(0, max(1, len(c) - _LETTERS // 2), _LETTERS // 2):
                flat_code.append(c[a : a + _LETTERS])
                flat_doc.append(d)
        normal = np.flatnonzero((size >= 1) & (size <= _LETTERS))
        if flat_code:
            more = np.array([len(c) for c in flat_code])
            letter = np.concatenate([letter, *flat_code])
            begin = np.concatenate([begin[normal], len(letter) - more.sum() + np.cumsum(more) - more])
            size = np.concatenate([size[normal], more])
            self.doc = np.concatenate([doc[normal], np.array(flat_doc)])
        else:
            begin, size, self.doc = begin[normal], size[normal], doc[normal]
        grid = np.full((len(size), LONGEST), _NONE, np.uint8)
        if len(size):
            col = np.arange(_LETTERS)
            at = begin[:, None] + col
            ok = col < size[:, None]
            grid[:, 1:-1][ok] = letter[at[ok]]
            grid[:, 0] = grid[np.arange(len(size)), size + 1] = _EDGE
        h = np.zeros(len(size), np.uint64)
        wide = grid.view(np.uint64).reshape(len(size), -1) if len(size) else np.empty((0, 3), np.uint64)
        for k in range(wide.shape[1]):
            h = mix(h ^ wide[:, k], k + 1)
        self.key, first, self.of = np.unique(h, return_index=True, return_inverse=True)
        self.code, self.size = grid[first].astype(np.int32), size[first] + 2


def _alike(size: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of like size, and how many columns they need."""
    order = np.argsort(size, kind="stable")
    edge = np.searchsorted(size[order], WIDTHS, "right")
    for a, b, width in zip([0, *edge], edge, WIDTHS):
        if b > a:
            yield order[a:b], width


def _triples(code: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(numbers, valid, weight) of all subsequences with the same gaps, for rows of codes."""
    col = np.arange(code.shape[1])
    for a, b, weight in _STEPS:
        last = max(0, code.shape[1] - b)
        ids = (code[:, :last] << 2 * _BITS) | (code[:, a : a + last] << _BITS) | code[:, b:]
        yield ids, (col[:last] + b) < size[:, None], weight


def _features(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of weights: (row, number, value), summed by number."""
    ids, vals = [], []
    for i, ok, weight in _triples(code, size):
        ids.append(np.where(ok, i, -1))
        vals.append(np.where(ok, weight, 0.0))
    ids, vals = np.concatenate(ids, 1), np.concatenate(vals, 1)
    row = np.repeat(np.arange(len(code)), ids.shape[1])
    key = row.astype(np.int64) * (1 << 3 * _BITS) + ids.ravel()
    real = ids.ravel() >= 0
    uniq, inv = np.unique(key[real], return_inverse=True)
    total = np.bincount(inv, vals.ravel()[real], len(uniq))
    return uniq >> 3 * _BITS, uniq & ((1 << 3 * _BITS) - 1), total


def spell(code: np.ndarray) -> np.ndarray:
    """Rows of codes as words: a-z, and other characters for the bytes of other letters."""
    return np.char.decode(np.ascontiguousarray(_SPELL[code[:, 1:]]).view(f"S{LONGEST - 1}").ravel())


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words written by spell(), of as many letters as fit; ``>`` at the end: a beginning, which has no edge there."""
    grid = np.full((len(words), LONGEST), _NONE, np.int32)
    size = np.zeros(len(words), np.int64)
    back = np.zeros(256, np.int64)
    back[_SPELL[:_EDGE]] = np.arange(_EDGE)
    for k, word in enumerate(words):
        c = back[np.frombuffer(word.rstrip(">").encode(), np.uint8)[:_LETTERS]]
        c = np.r_[_EDGE, c] if word.endswith(">") else np.r_[_EDGE, c, _EDGE]
        grid[k, : len(c)] = c
        size[k] = len(c)
    return grid, size


class Kernel:
    """Normalised kernel values of words against landmarks, with the bound that spares most of them."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        row, number, value = _features(*encode(landmarks))
        known, at = np.unique(number, return_inverse=True)
        self.place = np.zeros(1 << 3 * _BITS, np.int32)  # row of the table; the first one is of what no landmark has
        self.place[known] = 1 + np.arange(len(known))
        norm = np.sqrt(np.bincount(row, value * value, len(landmarks)))
        value = value / norm[row]
        order = np.lexsort((row, at))
        self.landmark, self.value = row[order], value[order]  # of the entries, by row of the table
        self.first = np.searchsorted(at[order], np.arange(-1, len(known) + 1))
        top = np.zeros(1 + len(known), np.float32)
        np.maximum.at(top, 1 + at, value.astype(np.float32))
        self.top = top[self.place]

    def bound(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        """At least the largest kernel value of each word."""
        out = np.zeros(len(code), np.float32)
        for rows, width in _alike(size):
            part, n = code[rows, :width], size[rows]
            up, square = np.zeros(len(rows), np.float32), np.zeros(len(rows), np.float32)
            for i, ok, weight in _triples(part, n):
                up += weight * np.where(ok, self.top[i], 0).sum(1)
                square += weight * weight * ok.sum(1)
            out[rows] = up / np.sqrt(np.maximum(square, 1e-9))
        return out

    def values(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(code), len(self.landmarks)), np.float32)
        for rows, width in _alike(size):
            for a in range(0, len(rows), 2000):
                own = rows[a : a + 2000]
                part, n = code[own, :width], size[own]
                steps = list(_triples(part, n))
                ids, ok = np.concatenate([i for i, _, _ in steps], 1), np.concatenate([k for _, k, _ in steps], 1)
                weight = np.concatenate([np.full(i.shape[1], w) for i, _, w in steps])
                square = ok @ weight**2
                # weights of a subsequence that comes more than once are added before they are squared
                told = np.sort(np.where(ok, ids, -1 - np.arange(len(weight))).astype(np.int32), 1)
                again = np.flatnonzero((told[:, 1:] == told[:, :-1]).any(1))
                if len(again):
                    row, _, value = _features(part[again], n[again])
                    square[again] = np.bincount(row, value * value, len(again))
                place = np.where(ok, self.place[ids], 0)
                row, at = np.nonzero(place)
                if len(row):
                    begin = self.first[place[row, at]]
                    n = self.first[place[row, at] + 1] - begin
                    entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    key = np.repeat(row * len(self.landmarks), n) + self.landmark[entry]
                    total = np.bincount(key, self.value[entry] * np.repeat(weight[at], n), out[own].size).reshape(len(own), -1)
                    out[own] = total / np.sqrt(np.maximum(square, 1e-9))[:, None]
        return out


def disguised(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with an x put into their middle; the longest as they are."""
    out, at = code.copy(), np.arange(LONGEST)
    middle = size // 2
    short = size < LONGEST
    moved = np.where(at < middle[:, None], at, np.maximum(at - 1, 0))
    grown = np.take_along_axis(code, moved, 1)
    grown[np.arange(len(code)), middle] = ord("x") - 97
    out[short] = grown[short]
    return out, size + short


class Pool:
    """Texts as vectors: for each landmark the largest value of a word, then their sum for each WORDS words."""

    WORDS, MORE = 50.0, 20.0  # MORE words are added to each text, so that short ones don't jump

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.key, self.at = np.zeros(REMEMBER, np.uint64), np.zeros(REMEMBER, np.int32)
        self.known = np.zeros((1024, len(kernel.landmarks)), np.float32)  # the first row: no landmark is near
        self.used = 1

    def values(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are near a landmark, and by how much more than FLOOR."""
        good = np.flatnonzero(self.kernel.bound(code, size) > FLOOR)
        over = np.maximum(self.kernel.values(code[good], size[good]) - FLOOR, 0)
        some = over.max(1, initial=0) > 0
        return good[some], over[some]

    def _of_words(self, x: Letters) -> np.ndarray:
        """Row of ``known`` for each word; words seen before are looked up."""
        slot = (x.key % np.uint64(REMEMBER)).astype(np.int64)
        at = self.at[slot].astype(np.int64)
        new = np.flatnonzero(self.key[slot] != x.key)
        good, over = self.values(x.code[new], x.size[new])
        at[new] = 0
        at[new[good]] = self.used + np.arange(len(good))
        while self.used + len(good) > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[self.used : self.used + len(good)] = over
        self.used += len(good)
        self.key[slot[new]], self.at[slot[new]] = x.key[new], at[new]
        return at

    def texts(self, column: pa.Array, hide: bool = False) -> np.ndarray:
        """A row for each text; with ``hide``, as if its telling words were disguised."""
        n = len(self.kernel.landmarks)
        out = np.zeros((len(column), 2 * n), np.float32)
        x = Letters(column)
        if not len(x.size) or not n:
            return out
        if self.used > REMEMBER // 8:
            self.__init__(self.kernel)
        at = self._of_words(x)
        pair = np.unique(x.doc.astype(np.int64) * len(x.size) + x.of)
        doc, word = pair // len(x.size), pair % len(x.size)
        count = np.bincount(doc, minlength=len(column))
        near = at[word] > 0
        doc, word = doc[near], word[near]
        value = self.known
        if hide:
            telling = np.flatnonzero(at)
            good, over = self.values(*disguised(x.code[telling], x.size[telling]))
            value = np.zeros((1 + len(good), n), np.float32)
            value[1:] = over
            at = np.zeros_like(at)
            at[telling[good]] = 1 + np.arange(len(good))
        np.maximum.at(out[:, :n], doc, value[at[word]])
        np.add.at(out[:, n:], doc, value[at[word]])
        out[:, n:] *= (self.WORDS / (count + self.MORE))[:, None].astype(np.float32)
        return out


class Model:
    """Kernel, weights of pooled texts (the Nystroem map is in them), and the sigmoid that turns margins into scores."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.kernel, self.weights, self.bias, self.slope, self.shift = kernel, weights, bias, slope, shift

    def score(self, pooled: np.ndarray) -> np.ndarray:
        margin = pooled.astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _nystroem(kernel: Kernel) -> np.ndarray:
    k = kernel.values(*encode(kernel.landmarks)).astype(np.float64)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    return vector * (1 / np.sqrt(np.maximum(value, 0) + 0.05)) @ vector.T


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1000.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weighted linear SVM with squared hinge loss, by Newton steps on the primal; weights add up to one."""
    x = np.c_[x, np.ones(len(x))]
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return w @ keep @ w / 2 + c * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        g = keep @ w - 2 * c * x[on].T @ (weight[on] * y[on] * slack[on])
        h = keep + 2 * c * (x[on] * weight[on, None]).T @ x[on]
        step, size, now = np.linalg.solve(h, g), 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the score, by Newton steps on the log loss with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.full(len(y), 1 / len(y))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, s = weight * (p - target), weight * (p * (1 - p) + 1e-6)
        g = np.array([(r * margin).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-2), float(b)


def learn(landmarks: list[str], x: np.ndarray, y: np.ndarray, hidden: np.ndarray) -> Model:
    """The model from pooled texts, their labels (0 or 1) and which of them are disguised copies."""
    kernel = Kernel(landmarks)
    one = _nystroem(kernel)
    mapping = np.block([[one, np.zeros_like(one)], [np.zeros_like(one), one]])
    sign = np.where(y > 0, 1.0, -1.0)
    count = np.array([max(1, ((y == k) & ~hidden).sum()) for k in (0, 1)])
    weight = np.where(y > 0, 1 / count[1], CAUTION / count[0]) * np.where(hidden, DISGUISE, 1.0)
    weights, bias = _svm(x.astype(np.float64) @ mapping, sign, weight / weight.sum())
    model = Model(kernel, mapping @ weights, bias)
    model.slope, model.shift = _sigmoid((x.astype(np.float64) @ model.weights + bias)[~hidden], sign[~hidden])
    return model


@tidy
def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text to (word, label), each word and each beginning of one once a text."""
    for batch in batches:
        for a, b in slices(batch.column(1)):
            part = batch.slice(a, b - a)
            label = part.column(0).to_numpy(zero_copy_only=False)
            x = Letters(part.column(1))
            if not len(x.size):
                continue
            word = spell(x.code)
            for stem in (None, *STEMS):
                own = word if stem is None else np.char.add(word.astype(f"U{stem}"), ">")
                name, at = np.unique(own, return_inverse=True)
                used = x.of if stem is None else x.of[x.size[x.of] - 2 > stem]
                doc = x.doc if stem is None else x.doc[x.size[x.of] - 2 > stem]
                pair = np.unique(doc.astype(np.int64) * len(name) + at[used])
                yield pa.RecordBatch.from_arrays([pa.array(name[pair % len(name)], pa.string()), pa.array(label[pair // len(name)], pa.int32())], ["word", "label"])


def _sample_batches(shared) -> object:
    """label, text to pooled texts; toxic ones also disguised."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(pickle.loads(shared.value))
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                toxic = part.filter(pa.array(part.column(0).to_numpy(zero_copy_only=False) == 1))
                for rows, hide in ((part, False), (toxic, True)):
                    x = pool.texts(rows.column(1), hide)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([hide] * len(x), pa.bool_()), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "hidden", "x"])

    return run


def _score_batches(shared) -> object:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        pool = Pool(model.kernel)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(pool.texts(part.column(1))), pa.float64())], ["doc_id", "score"])

    return run


def _landmarks(strong: list[str]) -> list[str]:
    """Of the words that speak for toxic texts, most telling first, up to LANDMARKS that differ from each other."""
    if not strong:
        return []
    alike = Kernel(strong).values(*encode(strong))
    chosen: list[int] = []
    for k in range(len(strong)):
        if len(chosen) < LANDMARKS and (not chosen or alike[k, chosen].max() < ALIKE):
            chosen.append(k)
    return [strong[k] for k in chosen]


def _evident(words: DataFrame, totals: dict[int, int]) -> list[str]:
    """The words (word, t, c) that speak for toxic texts, most telling first.

    Evidence is the log likelihood gained by giving a word its own share of toxic
    texts, if that is above the prior.  What is asked for grows with the number of
    words that are tried, so small samples and large ones are judged alike.
    """
    t, c = F.col("t"), F.col("c")
    prior, share = totals[1] / (totals[0] + totals[1]), t / (t + c)
    gain = t * F.log(share / prior) + F.when(c > 0, c * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    tried = words.filter("t >= 3")
    need = float(np.log(max(1, tried.count()) / CHANCE))
    found = tried.filter((share > prior) & (gain > need))
    return [r.word for r in found.orderBy(F.desc(F.round(gain, 6)), F.col("word").endswith(">"), "word").limit(CANDIDATES).select("word").collect()]


def _rate(known: DataFrame) -> float:
    """The share of toxic rows in (label), 0 if there are none."""
    return float(known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1); None if a class has no rows.

    Rows with a null label or doc_id are left out.  Of each class the SAMPLE rows
    with the smallest hash of doc_id are read (ties by doc_id); a doc_id with both
    labels counts as toxic.  If no word speaks for toxic texts, every text gets the
    share of toxic rows.  Empty tables give no model.
    """
    spark = docs.sparkSession
    known = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    own = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    picked = own[0].union(own[1])  # bounded, so it can be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text")
    totals = {r.label: r["count"] for r in picked.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None
    words = stage(sample.mapInArrow(_word_batches, "word string, label int").groupBy("word").agg(
        F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")), "words")
    landmarks = _landmarks(_evident(words, totals))
    discard(words)
    if not landmarks:
        rate = _rate(known)
        return Model(Kernel([]), np.empty(0), float(np.log(rate / (1 - rate))))
    shared = spark.sparkContext.broadcast(pickle.dumps(Kernel(landmarks)))
    rows = sample.mapInArrow(_sample_batches(shared), "label int, hidden boolean, x binary").collect()  # 3 * SAMPLE rows at most
    rows = sorted((r.label, r.hidden, bytes(r.x)) for r in rows)
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(len(rows), -1)
    return learn(landmarks, x, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: Model | None, rate: float = 0.5) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; without a model every score is ``rate``.

    Null and empty texts have no words and the score of the bias.  Rows that
    repeat are scored each, equal texts alike; other columns are ignored; an
    empty table gives no rows.
    """
    if model is None:
        return docs.select("doc_id", F.lit(rate).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    return docs.select("doc_id", "text").mapInArrow(_score_batches(shared), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(~held).select("doc_id", F.col("toxic").alias("label"))
    model = train(docs, known)
    rate = _rate(known.filter("label in (0, 1)")) if model is None else 0.5
    return score(docs, model, rate).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
