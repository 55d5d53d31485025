"""Hard negatives: for each anchor and each of its positives, the best rows of another label within a window of scores.

Scores are inner products of integer vectors. The positives of an anchor are its best rows of its own label. Each positive
with score p opens the window of scores from ``low`` % of p to p. Windows of one anchor overlap, so they are not searched one
by one. The positives' scores, the upper limits, split all scores into disjoint slots: slot j lies above the limit of positive
j + 1 and at most at that of positive j. Every task keeps the best ``k`` rows of each slot, these are combined across tasks,
and one walk over the slots, from the lowest limit up, merges each slot into what the lower ones hold: that is the answer of
the window with that upper limit, cut at its lower one.

Anchors are a stated set of queries. Rows and anchors are packed into matrices of bounded size, and each pair of a block of
anchors and a chunk of rows is one matrix product in one task; no pair of rows is a row of any table. A task holds one
chunk, one block and the best rows of ``HELD`` anchors. What it hands on is ``k`` rows for each anchor (or slot), however many
rows share a label or a vector.

Edge cases. A row with a null id, label or vector, or with a null or non-finite component, takes no part. A shorter vector counts
as filled with zeros. Rows of an anchor's id are never its positives; rows that repeat another id each count. Anchors that repeat
a row are answered once, anchors that share an id but not the label or vector each. Ties go to the smaller id. A window of a
positive with a negative score is empty, that of score 0 holds score 0. A score beyond 64 bits is held at the largest number.
Other columns are not read. An empty table has no rows to return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SCALE = 256
CHUNK = 2048
BLOCK = 512
HELD = 1 << 15
_EXACT = 2.0**52
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1
_PACKED = "n int, width int, ids binary, labels binary, keys binary, limits binary, vectors binary"
_NONE = np.iinfo(np.int64).min


def _pack(size):
    """Rows to matrices of at most ``size`` rows; each matrix is sorted by id, so a smaller place wins a tie."""

    def pack(held):
        table = pa.concat_tables(held)
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        width = pc.list_value_length(table["embedding"]).to_numpy()
        flat = table["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64)
        matrix = np.zeros((len(ids), int(width.max())))
        matrix[np.arange(matrix.shape[1]) < width[:, None]] = np.floor(SCALE * flat)
        limits = np.array(table["limits"].to_pylist(), np.int64).reshape(len(ids), -1)
        columns = [a[order].tobytes() for a in (ids, table["label"].to_numpy(), table["key"].to_numpy(), limits, matrix)]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int32()), pa.array([matrix.shape[1]], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]],
            ["n", "width", "ids", "labels", "keys", "limits", "vectors"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            while table.num_rows:
                part = table.slice(0, size - n)
                table = table.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    return run


class _Matrix:
    def __init__(self, row, prefix):
        n, self.width = row[f"{prefix}_n"], row[f"{prefix}_width"]
        self.ids, self.labels, self.keys = (np.frombuffer(row[f"{prefix}_{c}"], np.int64) for c in ("ids", "labels", "keys"))
        self.limits = np.frombuffer(row[f"{prefix}_limits"], np.int64).reshape(n, -1)
        self.vectors = np.frombuffer(row[f"{prefix}_vectors"], np.float64).reshape(n, -1)


def _scores(a: _Matrix, b: _Matrix) -> np.ndarray:
    """Integer inner products, exact: in doubles where no sum can round, else in Python's integers."""
    width = min(a.width, b.width)
    if not width:
        return np.zeros((len(a.ids), len(b.ids)), np.int64)
    x, y = a.vectors[:, :width], b.vectors[:, :width]
    if np.abs(x).max() * np.abs(y).max() * width < _EXACT:
        return (x @ y.T).astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in x], object) @ np.array([[int(v) for v in row] for row in y], object).T
    return np.clip(whole, _LEAST, _MOST).astype(np.int64)


class _Best:
    """The ``k`` best (score, id) of each slot of the anchors of one block, best first."""

    def __init__(self, anchors: _Matrix, slots: int, k: int):
        self.anchors, self.slots, self.k = anchors, slots, k
        self.score = np.full((len(anchors.ids) * slots, k), _NONE)
        self.id = np.zeros_like(self.score)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Add candidates that lie in a slot; those that cannot enter it go first."""
        may = score >= self.score[slot, -1]
        slot, score, ids = slot[may], score[may], ids[may]
        if not len(slot):
            return
        touched = np.unique(slot)
        old = self.score[touched] > _NONE
        slot = np.concatenate([touched.repeat(old.sum(1)), slot])
        score = np.concatenate([self.score[touched][old], score])
        ids = np.concatenate([self.id[touched][old], ids])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - first.repeat(np.diff(first, append=len(slot)))
        top = rank < self.k
        self.score[slot[top], rank[top]], self.id[slot[top], rank[top]] = score[top], ids[top]

    def rows(self) -> pa.RecordBatch:
        place, rank = np.nonzero(self.score > _NONE)
        at, slot = place // self.slots, place % self.slots
        columns = [self.anchors.ids[at], self.anchors.keys[at], slot.astype(np.int32), self.id[place, rank], self.score[place, rank]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "key", "slot", "vec_id", "score"])


def _positives(anchors: _Matrix, rows: _Matrix, score: np.ndarray):
    fits = (anchors.labels[:, None] == rows.labels) & (anchors.ids[:, None] != rows.ids)
    at, row = np.nonzero(fits)
    return at, score[at, row], rows.ids[row]


def _negatives(low):
    def pick(anchors: _Matrix, rows: _Matrix, score: np.ndarray):
        top, least = anchors.limits[:, :1], anchors.limits[:, -1:]
        whole, rest = np.divmod(least, 100)
        floor = whole * low - (-rest * low) // 100  # low * least / 100, rounded up, without leaving 64 bits
        at, row = np.nonzero((anchors.labels[:, None] != rows.labels) & (score <= top) & (score >= floor))
        found = score[at, row]
        slot = (anchors.limits[at] >= found[:, None]).sum(1) - 1
        return at * anchors.limits.shape[1] + slot, found, rows.ids[row]

    return pick


def _search(pick, slots, k):
    """Best rows of each block of anchors over all chunks that a task meets."""

    def run(batches):
        best: dict[bytes, _Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                anchors, rows = _Matrix(row, "a"), _Matrix(row, "b")
                block = row["a_keys"] + row["a_ids"][:8]
                if block not in best:
                    if sum(len(b.anchors.ids) for b in best.values()) >= HELD:
                        for b in best.values():
                            yield b.rows()
                        best.clear()
                    best[block] = _Best(anchors, slots, k)
                best[block].add(*pick(anchors, rows, _scores(anchors, rows)))
        for b in best.values():
            yield b.rows()

    return run


_FOUND = "anchor_id bigint, key bigint, slot int, vec_id bigint, score bigint"


def _matched(anchors: DataFrame, rows: DataFrame, pick, slots: int, k: int) -> DataFrame:
    """The ``k`` best rows of each slot of each anchor, of all rows."""
    n = anchors.count()
    blocks = anchors.repartition(max(1, -(-n // BLOCK))).mapInArrow(_pack(BLOCK), _PACKED)
    pairs = rows.select([F.col(c).alias(f"b_{c}") for c in rows.columns]).crossJoin(blocks.select([F.col(c).alias(f"a_{c}") for c in blocks.columns]))
    found = pairs.mapInArrow(_search(pick, slots, k), _FOUND)
    order = Window.partitionBy("anchor_id", "key", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors, label=None, positives: int = 5, k: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of (vec_id, embedding, label).

    ``anchors`` is a condition on ``vec_id`` and ``label`` an expression of the label to use, by default the column.
    """
    scratch = Scratch(rows.sparkSession, "hard-negatives")
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = (F.col("label") if label is None else label).cast("bigint")
    usable = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), own.alias("label"), vector.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    unlimited = F.array(F.lit(0).cast("bigint")).alias("limits")
    all_anchors = usable.filter(anchors).withColumn("key", F.xxhash64("vec_id", "label", "embedding")).dropDuplicates(["vec_id", "key"])
    all_anchors = scratch.keep(all_anchors, "anchors")
    packed = usable.select("vec_id", "label", "embedding", F.lit(0).cast("bigint").alias("key"), unlimited).mapInArrow(_pack(CHUNK), _PACKED)
    packed = scratch.keep(packed, "rows")
    columns = ["vec_id", "label", "embedding", "key"]
    best = _matched(all_anchors.select(*columns, unlimited), packed, _positives, 1, positives).filter("score >= 0")
    best = scratch.keep(best.select("anchor_id", "key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("place")), "positives")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"])
    limits = best.groupBy(F.col("anchor_id").alias("vec_id"), "key").agg(ranked.alias("limits"))
    # fewer positives than slots: the last limit again, whose slot is then the last one
    filled = F.concat("limits", F.array_repeat(F.element_at("limits", -1), F.lit(positives) - F.size("limits"))).alias("limits")
    limited = all_anchors.join(limits, ["vec_id", "key"]).select(*columns, filled)
    kept = _matched(limited, packed, _negatives(low), positives, k)
    slots = kept.groupBy("anchor_id", "key").agg(*[
        F.collect_list(F.when(F.col("slot") == j, F.struct((-F.col("score")).alias("order"), F.col("vec_id").alias("negative_id")))).alias(f"slot_{j}")
        for j in range(positives)])
    for j in reversed(range(positives - 1)):  # descending suffix merges: a window holds its own slot and all lower ones
        slots = slots.withColumn(f"slot_{j}", F.slice(F.array_sort(F.concat(f"slot_{j}", f"slot_{j + 1}")), 1, k))
    slots = slots.withColumn(f"slot_{positives - 1}", F.array_sort(f"slot_{positives - 1}"))
    window = F.array(*[F.col(f"slot_{j}") for j in range(positives)])
    # equal limits share a window: the last of them has it
    answers = best.join(slots.select("anchor_id", "key", window.alias("windows")), ["anchor_id", "key"])
    answers = answers.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.col("windows")[F.col("place")]).alias("at", "negative"))
    score = -F.col("negative.order")
    whole = lambda c: c.cast("decimal(38,0)")
    return answers.filter(whole(score) * 100 >= whole(F.col("positive_score")) * low).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.negative_id").alias("negative_id"),
        "positive_score", score.alias("negative_score"))
