"""Order statistics from a table of values and counts, without any task that holds a whole column.

Values are counted by a two-level aggregate, so a hot value is one row per task. The counts are summed by bucket of the value range, the
sums of the buckets are accumulated, and only the bucket that holds a wanted rank is read value by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import as_double

BUCKETS = 1024
_LARGEST = 8e307  # twice this is still a number


@dataclass(frozen=True)
class Wanted:
    """Ranks, counted from 0, among the values of a column in [lo, hi]."""

    column: str
    lo: float
    hi: float
    ranks: tuple[int, ...]


def ranked_values(df: DataFrame, wanted: Sequence[Wanted]) -> dict[tuple[int, int], float]:
    """The value at each rank of each request, keyed by the request's place and the rank."""
    if not wanted:
        return {}
    cells = [as_double(w.column).cast("double") for w in wanted]
    cells = [F.when(c.between(w.lo, w.hi), c) for c, w in zip(cells, wanted)]
    rows = df.filter(reduce(lambda a, b: a | b, [c.isNotNull() for c in cells])).select(*[c.alias(str(i)) for i, c in enumerate(cells)])
    values = rows.unpivot([], [str(i) for i in range(len(wanted))], "slot", "value").filter("value is not null")
    counts = values.select(F.col("slot").cast("int").alias("slot"), "value").groupBy("slot", "value").agg(F.count("*").alias("n"))
    ends = [(min(max(w.lo, -_LARGEST), _LARGEST), min(max(w.hi, -_LARGEST), _LARGEST)) for w in wanted]
    low = F.array(*[F.lit(lo) for lo, _ in ends])[F.col("slot")]
    grain = F.array(*[F.lit((hi - lo) or 1.0) for lo, hi in ends])[F.col("slot")]
    place = F.greatest(F.lit(0.0), F.least(F.lit(BUCKETS - 1.0), (F.col("value") - low) / grain * BUCKETS))
    counts = counts.withColumn("bucket", place.cast("int"))
    order = Window.partitionBy("slot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("slot", "bucket").agg(F.sum("n").alias("held"))
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))
    ranks = F.array(*[F.array(*[F.lit(r).cast("bigint") for r in w.ranks]) for w in wanted])[F.col("slot")]
    targets = sums.withColumn("rank", F.explode(ranks)).filter("before <= rank and rank < before + held").select("slot", "bucket", "before", "rank")
    # as many rows as ranks are wanted
    near = counts.join(F.broadcast(targets), ["slot", "bucket"])
    running = Window.partitionBy("slot", "bucket", "rank").orderBy("value")
    found = near.withColumn("upto", F.col("before") + F.sum("n").over(running)).filter("upto > rank and upto - n <= rank")
    return {(r["slot"], r["rank"]): r["value"] for r in found.select("slot", "rank", "value").collect()}
