"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts are lower-cased and cut into words at white space. Fixed masks pick some of the next word positions and ignore the
others, so a replaced word spoils only the seeds that pick it. Seeds of benchmark items meet seeds of documents by hash;
around each meeting the whole item is laid over the document, and the words that agree position by position are counted.
A document is contaminated if some placement agrees in at least ``percent`` of the item's words.

From ``min_words`` = 6 words on no placement with ``percent`` = 80 or more is missed: whichever words are replaced, a seed is left.
(Items of up to 24 words: all replacements are tried in the tests. Longer ones: k replaced of 5 k words or more leave four agreeing
words in a row.) A replaced word spoils at most as many seeds of a mask as the mask picks words, so long items must share
several seeds with a placement before it is verified; this drops no placement either.

Edge cases. A null or empty text has no words and is clean; an empty item is left out. An item of fewer than ``min_words`` words is
found where it is the whole text (inside a longer one it would be ordinary speech). Repeated rows and items are each
judged. Null ids are kept. Very long texts are cut into words once. Only doc_id and text, item_id and text are read, so other
columns do not matter. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Word positions that a seed picks. Any 6 words in a row with one replaced keep a seed of one of these masks.
MASKS = ((0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 2, 3))
#: Seeds that are broadcast at once; a larger benchmark is taken in blocks of this size.
SEEDS_AT_ONCE = 1_000_000
#: Placements to verify that are broadcast at most (a counted number); beyond it they meet the texts by a shuffle.
PLACED_AT_ONCE = 200_000


def split_words(text: Column) -> Column:
    """Lower-cased words of a text; null and empty texts have one empty word."""
    return F.split(F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" \t\n\x0b\f\r")), r"[\x09-\x0D\x20]+")


def seeds(texts: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, pos, seed) for every word position and mask of the column ``words``, where the mask fits.

    Words are hashed once and laid side by side, shifted, so that a seed is a hash of a few numbers of one row.
    """
    span = max(m[-1] for m in MASKS) + 1
    texts = texts.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    shifted = [F.sequence(F.lit(0), F.size("h") - 1).alias("pos"), *[F.slice("h", k + 1, F.size("h")).alias(f"w{k}") for k in range(span)]]
    rows = texts.withColumns({f"w{k}": c for k, c in enumerate(shifted[1:])}).withColumn("pos", shifted[0]).select(*keep, F.inline(F.arrays_zip("pos", *[f"w{k}" for k in range(span)])))
    picked = [F.when(F.col(f"w{m[-1]}").isNotNull(), F.xxhash64(F.lit(k), *[F.col(f"w{i}") for i in m])) for k, m in enumerate(MASKS)]
    return rows.select(*keep, "pos", F.explode(F.array(*picked)).alias("seed")).filter("seed is not null")


def shared_seeds(words: Column, percent: int) -> Column:
    """How many seeds an item of so many words shares with every placement that agrees in ``percent`` of them; 1 at least."""
    all_seeds = reduce(lambda a, b: a + b, [F.greatest(words - m[-1], F.lit(0)) for m in MASKS])
    spoilt = F.floor(words * (100 - percent) / 100) * sum(len(m) for m in MASKS)
    return F.greatest(all_seeds - spoilt, F.lit(1)).cast("int")


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["met_id"]) & (a["text_key"] == b["met_key"])


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, min_words: int = 6, seeds_at_once: int = SEEDS_AT_ONCE, placed_at_once: int = PLACED_AT_ONCE) -> DataFrame:
    """(doc_id, text_key, item_id, start, agree, item_words): the best placement of each benchmark item found in a document.

    ``start`` is the word of the document where the item begins; ties go to the earliest. ``text_key`` is a hash of the
    document's text, which tells rows of one id apart.
    """
    items = benchmark.select("item_id", split_words(F.col("text")).alias("words")).filter(F.get("words", F.lit(0)) != "")
    items = items.withColumns({"item_no": F.xxhash64("item_id", "words"), "item_words": F.size("words")})
    long, short = items.filter(F.col("item_words") >= min_words), items.filter(F.col("item_words") < min_words)
    long = long.withColumn("need", shared_seeds(F.col("item_words"), percent))
    tests = seeds(long, "item_no", "need").select("item_no", "need", F.col("pos").alias("at"), "seed").distinct()
    blocks = max(1, -(-tests.count() // seeds_at_once))
    docs = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"), split_words(F.col("text")).alias("words"))
    spread = seeds(docs, "doc_id", "text_key")
    found = []
    for k in range(blocks):
        part = tests.filter(F.pmod("seed", F.lit(blocks)) == k)
        met = spread.join(F.broadcast(part), "seed")  # at most seeds_at_once rows
        found.append(met.select("doc_id", "text_key", "item_no", "need", (F.col("pos") - F.col("at")).alias("start")))
    placed = reduce(DataFrame.union, found).groupBy("doc_id", "text_key", "item_no", "need", "start").agg(F.count("*").alias("shared")).filter("shared >= need")
    placed = placed.select(F.col("doc_id").alias("met_id"), F.col("text_key").alias("met_key"), "item_no", "start")
    placed = Scratch(docs.sparkSession, "placements").keep(placed, "placed")
    few = placed.count() <= placed_at_once
    here = docs.join(F.broadcast(placed) if few else placed, _same_key(docs, placed))
    # The part of the text under the item goes on, not the text.
    item = long.select("item_no", "item_id", F.col("words").alias("item"), "item_words")
    here = here.join(item.select("item_no", "item_words").distinct(), "item_no")
    ahead = F.greatest(-F.col("start"), F.lit(0))
    covered = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.greatest(F.col("item_words") - ahead, F.lit(0)))
    here = here.select("doc_id", "text_key", "item_no", "start", covered.alias("covered")).join(item, "item_no")
    agree = F.size(F.filter(F.zip_with("covered", F.slice("item", ahead + 1, F.size("item")), lambda a, b: a == b), lambda same: same))
    here = here.select("doc_id", "text_key", "item_id", "start", agree.alias("agree"), "item_words")
    here = here.filter(100 * F.col("agree") >= percent * F.col("item_words"))
    brief = docs.filter((F.size("words") < min_words) & (F.get("words", F.lit(0)) != ""))
    whole = brief.join(short, "words").select("doc_id", "text_key", "item_id", F.lit(0).alias("start"), F.col("item_words").alias("agree"), "item_words")
    best = F.max(F.struct("agree", F.negative("start").alias("minus"), "item_words")).alias("best")
    kept = here.unionByName(whole).groupBy("doc_id", "text_key", "item_id").agg(best)
    return kept.select("doc_id", "text_key", "item_id", F.negative("best.minus").alias("start"), F.col("best.agree").alias("agree"), F.col("best.item_words").alias("item_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, contaminated, n_items, agree, item_words) for every row of ``docs``; the best item's figures."""
    found = contaminated(docs, benchmark, percent)
    best = found.groupBy(F.col("doc_id").alias("met_id"), F.col("text_key").alias("met_key")).agg(F.count("*").alias("n_items"), F.max(F.struct("agree", "item_words")).alias("best"))
    docs = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    out = docs.join(best, docs["doc_id"].eqNullSafe(best["met_id"]) & (docs["text_key"] == best["met_key"]), "left")
    return out.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.col("best.agree").alias("agree"), F.col("best.item_words").alias("item_words"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contaminated(docs, benchmark, percent).select(F.col("doc_id").alias("met_id"), F.col("text_key").alias("met_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["met_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["met_key"]), "left_anti")
