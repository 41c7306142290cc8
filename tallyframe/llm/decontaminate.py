"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations alone.

A mask is a fixed pattern of positions that count and positions that are
ignored.  Every window of a benchmark item is hashed under every mask over the
positions that count; training windows with an equal hash are hits, although
words at ignored positions differ.  Around each hit the item is laid over the
document and the equal words are counted: a stretch of ``reach`` words beyond the seed
with at least ``percent`` % equal words is a leak, and so are ``run`` equal words in a row.

Of a training text only windows are hashed that hold, at the right place, the
longest counting word of some benchmark window (its anchor), so nearly all
positions cost one hash lookup.  The benchmark's seeds are dealt into blocks
of at most ``SEED_BLOCK`` rows and each block is broadcast; texts are scanned
once a block and never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import stage

MASKS = ("1101111011", "101110111", "1110110111")
#: Seeds that are broadcast at once (some hundred bytes each, with the words around them).
SEED_BLOCK = 200_000
REACH = 8
PERCENT = 80
#: Unbroken equal words that are a leak by themselves: the smallest passage that is caught.
RUN = 13

_SPACE = " \t\n\x0b\x0c\r"


def tokens(text: Column) -> Column:
    """Lower-case words; null and blank texts have none."""
    trimmed = F.trim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def _cares(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seed(words: Column, at: Column, mask: str) -> Column:
    """Hash of the counting words of the window that starts at ``at``."""
    return F.xxhash64(F.lit(mask), *[F.get(words, at + i) for i in _cares(mask)])


def _contiguous(n: int) -> str:
    return "1" * n


def seeds(benchmark: DataFrame, masks: tuple[str, ...], reach: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, n, mask, seed, q, anchor, off, near): a row per window and mask;
    an item shorter than every mask has one seed of all its words.  ``near`` has
    the item's words from ``reach`` before the window to ``reach`` after it, null
    beyond the item's n words, so a row's size does not follow the item's."""
    items = (benchmark.select(F.col(item_col).cast("long").alias("item_id"), tokens(F.col(text_col)).alias("item"))
             .filter("item_id is not null and size(item) > 0").distinct())
    shortest = min(map(len, masks))
    out = []
    for mask in [*masks, *(_contiguous(n) for n in range(1, shortest))]:
        n = len(mask)
        fits = F.size("item") >= n if mask in masks else F.size("item") == n
        rows = items.filter(fits).withColumn("q", F.explode(F.sequence(F.lit(0), F.size("item") - n)))
        # the longest counting word, the first of equally long ones
        best = F.array_max(F.array(*[F.struct(F.length(F.get("item", F.col("q") + i)).alias("l"), F.lit(-i).alias("i")) for i in _cares(mask)]))
        rows = rows.withColumn("off", -best["i"])
        near = F.transform(F.sequence(F.col("q") - reach, F.col("q") + (n + reach - 1)),
                           lambda i: F.when((i >= 0) & (i < F.size("item")), F.get("item", i)))
        out.append(rows.select("item_id", F.size("item").alias("n"), near.alias("near"), F.lit(mask).alias("mask"), _seed(F.col("item"), F.col("q"), mask).alias("seed"), "q",
                               F.get("item", F.col("q") + F.col("off")).alias("anchor"), "off"))
    return reduce(DataFrame.unionByName, out)


def _stretches(reach: int, percent: int, run: int) -> Column:
    """The best verified stretch around a hit as (percent, lo, hi), null if none.

    ``equal`` tells for the item's words from ``reach`` before the seed to ``reach``
    after it whether the document has them (null: beyond the item).  A stretch
    must hold a seed and ``reach`` words, or the whole item; ``run`` equal words in
    a row are one as well."""
    signs = F.array_join(F.transform("equal", lambda e: F.when(e, F.lit("1")).otherwise(F.lit("0"))), "")
    begin, size = F.locate("1" * run, signs), F.length(F.regexp_extract(signs, "1{%d,}" % run, 0))
    lo = F.col("q") - reach + begin - 1
    out = [F.when(begin > 0, F.struct(F.lit(100).alias("percent"), lo.alias("lo"), (lo + size).alias("hi")))]
    for before, after in ((reach, 0), (0, reach), (reach // 2, reach - reach // 2), (reach, reach)):
        part = F.slice("equal", reach - before + 1, F.col("span") + before + after)
        inside = F.filter(part, lambda e: e.isNotNull())
        n, same = F.size(inside), F.size(F.filter(inside, lambda e: e))
        share = (F.lit(100) * same / F.greatest(n, F.lit(1))).cast("int")
        ok = (n >= F.least(F.col("n"), F.col("span") + reach)) & (share >= percent)
        lo = F.greatest(F.col("q") - before, F.lit(0))
        out.append(F.when(ok, F.struct(share.alias("percent"), lo.alias("lo"), (lo + n).alias("hi"))))
    return F.array_max(F.array(*out))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", masks: tuple[str, ...] = MASKS, reach: int = REACH, percent: int = PERCENT,
                    run: int = RUN) -> DataFrame:
    """(doc_id, item_id, hits, matched_percent, first_word, last_word) for every
    document and benchmark item that share a leak.

    A leak is a seed hit that verifies over the seed and ``reach`` words before it,
    after it, half of them on either side, or as many on both: at least ``percent``
    % of the item's words there are the document's; words of the item beyond the
    document's ends count as different.  ``run`` unbroken equal words (no more than a
    seed and ``reach`` words on both sides) are a leak wherever they stand.  ``first_word``/``last_word`` are the
    document's word positions that the verified stretches span.  Null or empty texts and
    null ids leak nothing; repeated rows of an id count as one document; other
    columns are not looked at.  An empty table on either side gives an empty
    result.
    """
    spark = docs.sparkSession
    known = stage(seeds(benchmark, masks, reach, item_col, item_text_col), "seeds")
    n, blocks = known.count(), 1
    blocks = max(1, -(-n // SEED_BLOCK))
    every = [r.mask for r in known.select("mask").distinct().collect()]  # at most one a mask
    text = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), tokens(F.col(text_col)).alias("words"))
    found = []
    for b in range(blocks):
        part = known if blocks == 1 else known.filter(F.pmod(F.xxhash64("mask", "seed"), F.lit(blocks)) == b)
        anchors = part.select("anchor", "mask", "off").distinct()
        # the outer form infers no filter on the array, which would split every text twice
        at = text.select("doc_id", "words", F.posexplode_outer("words").alias("pos", "word"))
        near = at.join(F.broadcast(anchors), F.col("word") == F.col("anchor")).withColumn("p", F.col("pos") - F.col("off"))
        hashed = reduce(lambda out, m: F.when(F.col("mask") == m, _seed(F.col("words"), F.col("p"), m)).otherwise(out), every, F.lit(None).cast("long"))
        near = (near.filter((F.col("p") >= 0) & (F.col("p") + F.length("mask") <= F.size("words")))
                .select("doc_id", "words", "mask", "p", hashed.alias("seed")))
        hits = near.join(F.broadcast(part.select("mask", "seed", "item_id", "n", "near", "q")), ["mask", "seed"])
        found.append(hits.select("doc_id", "words", "item_id", "n", "near", "q", "p", F.length("mask").alias("span")))
    if not found or not every:
        return spark.createDataFrame([], "doc_id long, item_id long, hits long, matched_percent int, first_word int, last_word int")
    hits = reduce(DataFrame.unionByName, found)
    at = F.col("p") - reach
    equal = F.transform("near", lambda w, i: F.when(w.isNotNull(), F.coalesce((at + i >= 0) & (F.get("words", at + i) == w), F.lit(False))))
    # one short array for each hit, then narrow rows alone
    flagged = hits.select("doc_id", "item_id", "n", "q", "span", (F.col("p") - F.col("q")).alias("diagonal"), equal.alias("equal"))
    # a filter on a generated column stays above the join, which thus stays in generated code
    best = flagged.select("*", F.explode_outer(F.array(_stretches(reach, percent, run))).alias("best"))
    verified = (best.filter("best is not null")
                .select("doc_id", "item_id", F.col("best.percent").alias("percent"),
                        F.greatest(F.col("best.lo") + F.col("diagonal"), F.lit(0)).alias("first"), (F.col("best.hi") + F.col("diagonal") - 1).alias("last")))
    return (verified.groupBy("doc_id", "item_id")
            .agg(F.count("*").alias("hits"), F.max("percent").alias("matched_percent"), F.min("first").alias("first_word"), F.max("last").alias("last_word")))
