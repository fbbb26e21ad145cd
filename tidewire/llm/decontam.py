"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into words of letters and digits.  A seed is a
fixed mask over some words that reads a part of them and ignores the rest, so a
hit survives substitutions at ignored places; in ``RUN`` words, 558 of the 560
ways to substitute three leave a hit of some mask.  Seeds of benchmark items are joined
with those of documents, and around each hit the aligned words are compared: an
overlap counts if, in the alignment of some hit, a run of ``RUN`` words (all that
are aligned, if item or document has fewer there) agrees in ``AGREE`` of its
places or more.

A part of fewer than ``SPAN`` words of an item is no overlap.  Items that are too
short for any mask must occur word for word.  Items of fewer than
``SHORTEST`` words say nothing inside a longer text; they count where they are the
whole text.

Built-in functions only.  The masks are applied after ``explode`` of the words,
inside generated code and around words that a seed can have, and only rows that
hit leave that stage, so no position of a document is ever shuffled.  Benchmark
seeds are broadcast in blocks of at most ``BLOCK`` rows; their number does not
depend on the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stage, table

MASKS = ("111001001101", "110101111", "111100010011")
#: Words of the shortest mask, and least number of aligned words, if the item has so many.
LEAST, SPAN = min(map(len, MASKS)), 12
RUN = 16
AGREE = 0.8
#: Items of fewer words count only as whole texts; items of fewer than LEAST words must occur without a change.
SHORTEST = 5
#: Seed rows broadcast at once; a row holds an item's words, some hundred bytes.
BLOCK = 200_000
#: Hits that are verified in one task.
HITS = 256


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(words: str, at: str, mask: str, number: int) -> str:
    """Hash of the words that a mask reads; null where the span runs over the end."""
    read = ", ".join(f"get({words}, {at} + {k})" for k, x in enumerate(mask) if x == "1")
    return f"if({at} + {len(mask)} <= size({words}), xxhash64({number}, {read}), null)"


def _masks(bench: DataFrame) -> list[str]:
    short = bench.select(F.size("item_words").alias("n")).filter(F.col("n").between(1, LEAST - 1)).distinct()
    return [*MASKS, *("1" * r.n for r in short.orderBy("n").collect())]  # fewer than LEAST rows


def _item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """(seed, item_id, j, item, m, anchor, o) of every place and mask of every item; a short item has one seed, of all its words.

    The anchor is the hash of the word that is rarest in the benchmark, of those
    that the mask reads; o is its place from j.
    """
    seeds = [_seed("item_words", "j", m, k) for k, m in enumerate(masks)]
    seeds[len(MASKS) :] = [f"if(size(item_words) = {len(m)}, {x}, null)" for m, x in zip(masks[len(MASKS) :], seeds[len(MASKS) :])]
    rows = items.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.size("item_words") - LEAST, F.lit(0)))))
    rows = rows.select("*", F.posexplode(F.expr(f"array({', '.join(seeds)})")).alias("m", "seed")).filter("seed is not null")
    often = items.select(F.explode("item_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    reads = F.expr("array(" + ", ".join("array(" + ", ".join(str(k) for k, x in enumerate(m) if x == "1") + ")" for m in masks) + ")")
    words = rows.select("seed", "item_id", "j", "m", "item_words", F.explode(F.get(reads, F.col("m"))).alias("o"))
    words = words.withColumn("word", F.get("item_words", F.col("j") + F.col("o"))).join(often, "word")
    best = F.min(F.struct("n", (-F.length("word")).alias("short"), "word", "o")).alias("a")
    keys = ["seed", "item_id", "j", "m", F.size("item_words").alias("n_item"), F.array_join("item_words", " ").alias("item")]
    return words.groupBy(*keys).agg(best).select("seed", "item_id", "j", "item", "n_item", "m", F.xxhash64("a.word").alias("anchor"), F.col("a.o").alias("o"))


def _hits(words: DataFrame, seeds: DataFrame, masks: list[str]) -> DataFrame:
    """Places of documents whose seed is one of ``seeds``.

    A seed can only be there if its anchor is, so seeds are hashed around anchors
    alone: most words cost one look-up.
    """
    anchors = seeds.select("anchor", "m", "o").distinct()
    at = words.select("doc_id", "th", "doc_words", F.posexplode("doc_words").alias("p", "word"))
    near = at.join(F.broadcast(anchors), F.xxhash64("word") == F.col("anchor")).withColumn("i", F.col("p") - F.col("o")).filter("i >= 0")
    seed = "case m " + " ".join(f"when {k} then {_seed('doc_words', 'i', m, k)}" for k, m in enumerate(masks)) + " end"
    near = near.select("doc_id", "th", "doc_words", "i", F.expr(seed).alias("seed"))
    found = near.join(F.broadcast(seeds.select("seed", "item_id", "j", "item", "n_item")), "seed")
    return found.filter((F.col("n_item") >= SHORTEST) | (F.col("n_item") == F.size("doc_words")))


def _overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, best): overlaps of each text; th is its hash."""
    items = stage(bench.select("item_id", words_of(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0).distinct(), "items")
    masks = _masks(items)
    seeds = stage(_item_seeds(items, masks).withColumn("block", F.monotonically_increasing_id()), "seeds")
    blocks = max(1, -(-seeds.count() // BLOCK))
    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words_of(F.col("text")).alias("doc_words"))
    parts = [seeds.filter(F.pmod(F.xxhash64("block"), F.lit(blocks)) == b) if blocks > 1 else seeds for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, [_hits(d, part, masks) for part in parts])
    # One row goes on for each alignment, with the document's words beside the item.  They are staged, as the filter
    # below would otherwise move into the join and take it, and with it the seeds, out of generated code.
    near = F.expr("array_join(slice(doc_words, greatest(i - j, 0) + 1, n_item + least(i - j, 0)), ' ')")
    hits = hits.select("doc_id", "th", "item_id", (F.col("i") - F.col("j")).alias("by"), "item", near.alias("near"))
    hits = stage(hits.groupBy("doc_id", "th", "item_id", "by").agg(F.max("item").alias("item"), F.max("near").alias("near")), "hits", done=(items, seeds))
    # few bytes that cost much work: dealt by their number, as their size would put them into one task
    hits = hits.repartition(max(1, -(-hits.count() // HITS)), "doc_id", "th", "item_id", "by")
    hits = hits.select("doc_id", "th", "item_id", "by", F.greatest(F.lit(0), -F.col("by")).alias("lo"), F.split("item", " ").alias("item_words"), F.split("near", " ").alias("near"))
    hits = hits.filter(F.size("near") >= F.least(F.lit(SPAN), F.size("item_words")))
    hits = hits.withColumn("len", F.least(F.lit(RUN), F.size("near")))  # the aligned part is never longer than the item
    # the run: words s .. s + len - 1 of the item against the same of the document, shifted
    best = """array_max(transform(sequence(lo, lo + size(near) - len), s -> named_struct(
        'matched', size(filter(sequence(0, len - 1), k -> get(item_words, s + k) = get(near, s - lo + k))),
        'compared', len, 'doc_word', - by - s, 'item_word', -s)))"""
    hits = hits.withColumn("best", F.expr(best)).filter(F.col("best.matched") >= F.ceil(F.lit(AGREE) * F.col("best.compared")))
    return hits.groupBy("doc_id", "th", "item_id").agg(F.max("best").alias("best"))


def overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, compared, doc_word, item_word), a row for each contaminated pair.

    ``matched`` of ``compared`` aligned words agree in the best run around a hit;
    doc_word and item_word say where that run begins (the first, if several are
    equally good).  Null or empty texts and items have no words and never match;
    repeated rows with one id count as one, and of different texts with one id
    the best run is told; other columns are ignored; empty tables give no rows.
    Clean documents do not appear.
    """
    top = _overlaps(docs, bench).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return top.select("doc_id", "item_id", "best.matched", "best.compared", (-F.col("best.doc_word")).alias("doc_word"), (-F.col("best.item_word")).alias("item_word"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item; columns as they were.

    Rows are judged by their text, with or without a doc_id.  Null and empty
    texts stay, repeated rows stay or go together, an empty benchmark keeps all.
    """
    bad = _overlaps(docs, bench).select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    same = rows["doc_id"].eqNullSafe(bad["bad_id"]) & (rows["th"] == bad["bad_th"])
    return rows.join(bad, same, "left_anti").select("row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')"


def _key(words: str, at: str, mask: str) -> str:
    return " || ' ' || ".join(f"{words}[{at} + {k + 1}]" for k, x in enumerate(mask) if x == "1")


#: The same for items of LEAST words or more.
ORACLE = f"""
WITH b AS (SELECT item_id, list_filter({_WORDS}, lambda x: x <> '') AS iw FROM benchmark),
d AS (SELECT doc_id, list_filter({_WORDS}, lambda x: x <> '') AS dw FROM documents),
bs AS ({" UNION ALL ".join(f"SELECT {n} AS m, item_id, iw, j, {_key('iw', 'j', m)} AS seed FROM (SELECT *, unnest(range(0, len(iw) - {len(m) - 1})) AS j FROM b)" for n, m in enumerate(MASKS))}),
ds AS ({" UNION ALL ".join(f"SELECT {n} AS m, doc_id, dw, i, {_key('dw', 'i', m)} AS seed FROM (SELECT *, unnest(range(0, len(dw) - {len(m) - 1})) AS i FROM d)" for n, m in enumerate(MASKS))}),
h AS (SELECT DISTINCT doc_id, item_id, i - j AS by_, iw, dw, least({RUN}, least(len(iw), len(dw) - (i - j)) - greatest(0, j - i)) AS n FROM bs JOIN ds USING (m, seed) WHERE least(len(iw), len(dw) - (i - j)) - greatest(0, j - i) >= least({SPAN}, len(iw))),
r AS (SELECT *, unnest(range(greatest(0, -by_), least(len(iw), len(dw) - by_) - n + 1)) AS s FROM h),
v AS (SELECT doc_id, item_id, n, by_ + s AS dword, s, len(list_filter(range(0, n), lambda k: iw[s + k + 1] = dw[by_ + s + k + 1])) AS hit FROM r)
SELECT doc_id, item_id, hit::INTEGER AS matched, n::INTEGER AS compared, dword::INTEGER AS doc_word, s::INTEGER AS item_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY hit DESC, n DESC, dword, s) AS rn FROM v WHERE hit >= ceil({AGREE} * n)) WHERE rn = 1
"""
