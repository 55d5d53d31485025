"""Periodic runs of words: stretches that repeat with a period, found as maximal pairs of an LCP-interval tree.

Two equal stretches of words at i < j that differ in the word before them and in the word behind them are a maximal pair.
With distance q = j - i and common length l, the words from i to j + l repeat with period q and no neighbour extends them: a pair
with ``(repeats - 1) * q <= l`` and ``q + l >= least`` is a run, without any extension. Of the periods that the same stretch has,
the smallest is kept.

The suffixes of a text are sorted by prefix doubling, and the intervals of their longest common prefixes are visited bottom-up.
An interval's children are merged in turn, the smaller into the larger one; a merge at depth l meets every pair whose common
length is exactly l. Each interval keeps its places sorted, with the class of a place being its left word. Places of one
interval within l / 2 of each other are a progression (by Fine and Wilf), in which all but the first have the same left word.
So near a place there are at most two classes: one look at the first place before it and one at the next place behind it
find all partners of another class, and places of the own class are never walked through. The pairs met are at most a third of
the exponents of all runs together, which is linear in the text.

A common length below ``least / repeats * (repeats - 1)`` never makes a run, so texts that repeat no such n-gram of words are done after
hashing it, and the tree holds only the intervals from that depth on.

Every text is worked on by itself, in batches of bounded bytes: a table is one pass without a shuffle. A text of n words takes
O(n log n) time and about 250 bytes a word. Words are compared by 64-bit hashes inside one text.

Edge cases. A null, empty or blank text has no words and no runs. A very long text is a batch by itself. Ids may be null or repeated; every
row has its result. Other columns pass through; ``n_words``, ``runs`` and ``collapsed`` are replaced.
"""

from __future__ import annotations

from bisect import bisect, bisect_left, insort
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segment import gram_hashes, mix, slices, words

_SAME = np.arange(256, dtype=np.uint8)
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def doubling(word: np.ndarray, text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Labels of the first 1, 2, 4, ... words from each place, in the order of the suffixes; and the end of each place's text.

    ``word`` and ``text`` are a number for each place; places of one text are neighbours. A place with no other of its label keeps
    it. The last labels rank all suffixes.
    """
    n = len(word)
    end = np.searchsorted(text, text, "right")
    order = np.lexsort((word, text))
    new = np.ones(n, bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    levels, h = [], 1
    label = np.empty(n, np.int64)
    label[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels.append(label)
    active = order[~(new & np.append(new[1:], True))]
    while len(active):
        ahead = active + h
        following = np.where(ahead < end[active], label[np.minimum(ahead, n - 1)] + 1, 0)
        active = active[np.argsort(label[active] * (n + 1) + following, kind="stable")]
        old = label[active]
        ahead = active + h
        following = np.where(ahead < end[active], label[np.minimum(ahead, n - 1)] + 1, 0)
        first = np.ones(len(active), bool)
        first[1:] = old[1:] != old[:-1]
        new = first.copy()
        new[1:] |= following[1:] != following[:-1]
        at = np.arange(len(active))
        label = label.copy()
        label[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        levels.append(label)
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    return levels, end


def common_lengths(levels: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words from each place of ``a`` and ``b`` on."""
    length = np.zeros(len(a), np.int64)
    last = len(end) - 1
    for k in reversed(range(len(levels))):
        x, y = a + length, b + length
        same = (x < end[a]) & (y < end[b]) & (levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)])
        length += same * (1 << k)
    return length


def _merge(a: list[int], b: list[int], depth: int, left: list[int], repeats: int, found) -> list[int]:
    """Places of both children, sorted; reports their pairs of different left words and bounded distance."""
    if len(a) < len(b):
        a, b = b, a
    reach = depth // (repeats - 1)
    for p in b:
        k = bisect_left(a, p - reach)
        if k < len(a) and a[k] < p and left[a[k]] != left[p]:
            found(a[k], p, depth)
        k = bisect(a, p)
        while k < len(a) and a[k] <= p + reach and left[a[k]] != left[p]:
            found(p, a[k], depth)
            k += 1
    if b[0] > a[-1]:
        a += b
    elif len(b) * 16 < len(a):
        for p in b:
            insort(a, p)
    else:
        a += b
        a.sort()
    return a


def maximal_pairs(places: list[int], lcp: list[int], left: list[int], repeats: int, found) -> None:
    """Visit the LCP intervals bottom-up. ``lcp[k]`` belongs to ``places[k]`` and ``places[k + 1]``; 0 parts two trees."""
    stack: list[tuple[int, list[int]]] = []
    for k, place in enumerate(places):
        child, depth = [place], lcp[k] if k < len(lcp) else 0
        while stack and stack[-1][0] > depth:
            deeper, own = stack.pop()
            child = _merge(own, child, deeper, left, repeats, found)
        if depth and stack and stack[-1][0] == depth:
            stack[-1] = (depth, _merge(stack[-1][1], child, depth, left, repeats, found))
        elif depth:
            stack.append((depth, child))


def batch_runs(word: np.ndarray, text: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs over places of some texts, sorted; numbers as in ``doubling``."""
    shortest = -(-least * (repeats - 1) // repeats)
    levels, end = doubling(word, text)
    level = min(shortest.bit_length() - 1, len(levels) - 1)
    order = np.argsort(levels[-1])
    same = levels[level][order[1:]] == levels[level][order[:-1]]
    touched = np.append(same, False) | np.append(False, same)
    order = order[touched]
    if not len(order):
        return []
    lcp = common_lengths(levels, end, order[:-1], order[1:])
    lcp[lcp < shortest] = 0
    left = levels[0].copy()
    left[1:], left[0] = levels[0][:-1], -1
    left[1:][text[1:] != text[:-1]] = -1
    period: dict[tuple[int, int], int] = {}

    def found(a: int, b: int, depth: int) -> None:
        q = b - a
        if q + depth >= least:
            run = (a, b + depth)
            period[run] = min(q, period.get(run, q))

    maximal_pairs(order.tolist(), lcp.tolist(), left.tolist(), repeats, found)
    return sorted((a, b, q) for (a, b), q in period.items())


def text_runs(texts: pa.Array, least: int, repeats: int) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """Number of words of each text, and (start, length, period) of the runs of those that have any."""
    w = words(texts, _SAME)
    count = np.diff(w.first)
    grams, first = gram_hashes(w, -(-least * (repeats - 1) // repeats))
    owner = np.arange(len(count)).repeat(np.diff(first))
    keyed = grams ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed)
    twice = np.unique(owner[order[1:]][keyed[order[1:]] == keyed[order[:-1]]])
    runs: dict[int, list[tuple[int, int, int]]] = {int(d): [] for d in twice}
    if len(twice):
        size = count[twice]
        text = twice.repeat(size)
        begin = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(begin[-1]) - begin[:-1].repeat(size) + w.first[twice].repeat(size)
        for a, b, q in batch_runs(w.hash[place], text, least, repeats):
            d = int(text[a])
            start = int(a - begin[np.searchsorted(twice, d)])
            runs[d].append((start, int(b - a), int(q)))
    return count, {d: r for d, r in runs.items() if r}


def collapse(text: str | None, runs: list[tuple[int, int, int]]) -> str:
    """Words joined by a space, without those that a run holds after its first period."""
    kept = (text or "").encode().split()
    if runs:
        held = np.zeros(len(kept) + 1, np.int64)
        for start, length, period in runs:
            held[start + period] += 1
            held[start + length] -= 1
        kept = compress(kept, np.cumsum(held) == 0)
    return b" ".join(kept).decode()


def _periodic(least, repeats):
    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(0)):
                part = batch.slice(low, high - low)
                texts = part.column(0)
                count, runs = text_runs(texts, least, repeats)
                shorter = [collapse(t, runs.get(d, [])) for d, t in enumerate(texts.to_pylist())]
                listed = [[dict(zip(("start", "length", "period"), r)) for r in runs.get(d, [])] for d in range(len(count))]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                new = [pa.array(count), pa.array(listed, kind), pa.array(shorter, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], [*part.schema.names[1:], "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 24, repeats: int = 3) -> DataFrame:
    """The rows without their text, with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A run has at least ``least`` words and ``repeats`` periods, 3 or more of them. ``collapsed`` is the text without the words that repeat.
    """
    if repeats < 3:
        raise ValueError("repeats must be at least 3")
    other = [c for c in docs.columns if c not in ("text", "n_words", "runs", "collapsed")]
    rows = docs.select(F.col("text").cast("string").alias("text"), *other)
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return rows.mapInArrow(_periodic(least, repeats), T.StructType([*rows.select(*other).schema.fields, *new]))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """Gives every tenth document, by the CRC-32 of its id, a tail that repeats some of its words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    tailed = docs.withColumn("parts", F.when(h % 10 == 0, parts)).withColumn("n", F.size("parts").cast("bigint"))
    g = F.floor(h / 10)
    a = F.when(F.col("n") > 0, g % F.col("n"))
    p = F.floor((F.col("n") - a) / (g % 8 + 3)) + 1
    tailed = tailed.withColumn("a", a).withColumn("p", p)
    word = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.get("parts", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return tailed.withColumn("text", F.when(F.col("n") > 0, F.array_join(word, " ")).otherwise(F.col("text"))).select(*docs.columns)


def run_digests(found: DataFrame) -> DataFrame:
    """Digest columns of each document's runs; the best run has the greatest exact number of periods."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    more = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), more))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
