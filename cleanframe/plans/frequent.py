"""The most frequent texts of columns, without moving whole texts.

A text beyond ``KEPT`` letters is counted under its digest, beside its first letters. Count and first letters bound the candidates: those
that are not behind the k-th best. Only the candidates' texts are fetched, which settles ties by the whole text. Where more than
``TIES`` candidates share count and first letters, they are told apart by more letters. So what is shuffled is bounded per
distinct text, however long the texts are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import col

KEPT = 64
TIES = 10_000
WIDER = 16
_MARK = "sha256:"  # with a digest behind it longer than any text that is kept as it is


def known(c: Column) -> Column:
    """A long text by its digest."""
    return F.when(F.length(c) > KEPT, F.concat(F.lit(_MARK), F.sha2(c.cast("binary"), 256))).otherwise(c)


def _is_digest(text: str) -> bool:
    return len(text) > KEPT


def _cells(df: DataFrame, columns: Sequence[str], **parts) -> DataFrame:
    """(slot, parts...) of every text that is there."""
    cells = df.select(*[F.when(col(c).isNotNull(), F.struct(*[make(col(c)).alias(p) for p, make in parts.items()])).alias(str(i)) for i, c in enumerate(columns)])
    cells = cells.unpivot([], [str(i) for i in range(len(columns))], "slot", "cell").filter("cell is not null")
    return cells.select(F.col("slot").cast("int").alias("slot"), "cell.*")


def _first(counts: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Rows of each slot that are not behind its k-th one in ``order``, ties included. A task hands on ``k`` rows a slot."""
    key = F.struct(*order)
    keyed = counts.withColumn("key", key)
    place = F.row_number().over(Window.partitionBy("slot").orderBy("key"))
    bound = keyed.select("slot", "key").withColumn("place", place).filter(F.col("place") <= k).groupBy("slot").agg(F.max_by("key", "place").alias("bound"))
    return keyed.join(F.broadcast(bound), "slot").filter("key <= bound").drop("key", "bound")  # one row a column


def texts_of(df: DataFrame, columns: Sequence[str], wanted: Sequence[tuple[int, str]], form=lambda c: c) -> DataFrame:
    """(slot, known, text): the distinct texts whose ``form`` has one of the ``wanted`` (slot, known) keys, at most ``TIES`` a column."""
    keys = df.sparkSession.createDataFrame(list(wanted), "slot int, known string")
    cells = _cells(df, columns, known=lambda c: known(form(c)), text=lambda c: c)
    return cells.join(F.broadcast(keys), ["slot", "known"]).distinct()


def top_texts(df: DataFrame, columns: Sequence[str], k: int) -> tuple[dict[str, list[tuple[str, int]]], dict[str, tuple[int, int]]]:
    """The ``k`` most frequent texts of each column with their counts (ties: the smallest), and its (texts, distinct texts)."""
    tops: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    totals = dict.fromkeys(columns, (0, 0))
    left, letters, most = list(columns), KEPT, max(TIES, k)
    while left:
        counts = _cells(df, left, known=known, head=lambda c: F.substring(c, 1, letters)).groupBy("slot", "known", "head").agg(F.count("*").alias("n"))  # noqa: B023
        sums = counts.groupBy("slot").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"))
        best = _first(counts, [-F.col("n"), F.col("head")], k)
        size = len(left) * most
        rows = sums.select("slot", F.lit(None).cast("string").alias("known"), "n", "distinct").union(best.select("slot", "known", "n", F.lit(None).cast("bigint"))).limit(size + len(left) + 1).collect()
        for r in rows:
            if r["distinct"] is not None:
                totals[left[r["slot"]]] = (r["n"], r["distinct"])
        found = [r for r in rows if r["distinct"] is None]
        per_slot = [sum(r["slot"] == i for r in found) for i in range(len(left))]
        done = {i for i, n in enumerate(per_slot) if n <= most} if len(rows) <= size + len(left) else set()
        digests = [(r["slot"], r["known"]) for r in found if r["slot"] in done and _is_digest(r["known"])]
        whole = {(r["slot"], r["known"]): r["text"] for r in texts_of(df, left, digests).collect()} if digests else {}
        for i in done:
            own = [(whole.get((i, r["known"]), r["known"]), r["n"]) for r in found if r["slot"] == i]
            tops[left[i]] = sorted(own, key=lambda x: (-x[1], x[0]))[:k]
        left, letters = [c for i, c in enumerate(left) if i not in done], letters * WIDER
    return tops, totals


def variant_keys(df: DataFrame, columns: Sequence[str], form, k: int) -> list[tuple[int, str]]:
    """Keys (slot, known form) of texts with several spellings, holding at least the ``k`` first ones of each column."""
    letters, most = KEPT, max(TIES, k)
    while True:
        spelled = _cells(df, columns, own=known, known=lambda c: known(form(c)), head=lambda c: F.substring(form(c), 1, letters)).distinct()  # noqa: B023
        groups = spelled.groupBy("slot", "known", "head").agg(F.count("*").alias("spellings")).filter("spellings > 1")
        rows = _first(groups, [F.col("head")], k).select("slot", "known").limit(len(columns) * most + 1).collect()
        if len(rows) <= len(columns) * most:
            return [(r["slot"], r["known"]) for r in rows]
        letters *= WIDER
