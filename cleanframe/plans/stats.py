"""Fitted numeric statistics: moments in one pass, exact quantiles in a few more.

Exact quantiles never gather a column. A column of few distinct values is counted by value, and ranks are looked up in the
counts. Elsewhere a sketch brackets each wanted rank, a counting pass proves where the bracket lies, and the bracket narrows
several hundredfold per round until few distinct values are left, or one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import INTEGRAL, as_double, nan_to_null
from .fused import agg_values, chunks
from .ranks import Wanted, ranked_values
from .state import remembered_state

MAP_LIMIT = 100_000  # values that are counted one by one
SKETCH_K = 4_000  # rank error of the bracketing sketch is about 0.1 %
SKETCH_MARGIN = 0.002
SKETCH_PARTS = 256  # groups of tasks whose sketches merge before the last merge
MAX_ROUNDS = 64
MOMENT_CHUNK = 60  # a deviation or skewness takes several buffers; more do not compile

MOMENTS = {
    "count": lambda c: F.count(c),
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "skew_pop": lambda c: F.skewness(c),
    "zeros": lambda c: F.count_if(c == 0),
    "negatives": lambda c: F.count_if(c < 0),
}


@dataclass
class ColumnStats:
    """Fitted values of one numeric column; fields that were not asked for stay None."""

    column: str
    count: int = 0
    mean: float | None = None
    std: float | None = None
    min: float | None = None
    max: float | None = None
    skew_pop: float | None = None
    zeros: int | None = None
    negatives: int | None = None
    quantiles: dict[float, float | None] = field(default_factory=dict)

    @property
    def skew(self) -> float:
        """Bias-corrected skewness; 0 for fewer than three values or a constant column."""
        n, g = self.count, self.skew_pop
        if n < 3 or g is None or math.isnan(g):
            return 0.0
        return g * math.sqrt(n * (n - 1)) / (n - 2)

    @property
    def q1(self) -> float | None:
        return self.quantiles.get(0.25)

    @property
    def median(self) -> float | None:
        return self.quantiles.get(0.5)

    @property
    def q3(self) -> float | None:
        return self.quantiles.get(0.75)

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1


def skew_expr(c: Column) -> Column:
    """Bias-corrected skewness as an aggregate expression."""
    n = F.count(c).cast("double")
    skew = F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.coalesce(F.nanvl(skew, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


def numeric_stats(
    df: DataFrame,
    columns: Sequence[str],
    want: Iterable[str] = ("count", "mean", "std", "min", "max"),
    probs: Sequence[float] = (),
    quantiles: str = "exact",
) -> dict[str, ColumnStats]:
    """Fit ``want`` (keys of MOMENTS) and the quantiles ``probs`` for every column, all columns per pass."""
    if quantiles not in ("exact", "approx"):
        raise ValueError("quantiles must be 'exact' or 'approx'")
    state, df = remembered_state(df), nan_to_null(df)
    fields = dict.fromkeys(["count", *want])
    exprs = {(c, f): MOMENTS[f](as_double(c)) for c in columns for f in fields}
    if probs:
        exprs.update({(c, f): MOMENTS[f](as_double(c)) for c in columns for f in ("min", "max")})
    values = {(c, f): getattr(state.columns[c], f) for c, f in exprs} if state else agg_values(df, exprs, chunk=MOMENT_CHUNK)
    stats = {c: ColumnStats(c, **{f: values[(c, f)] for f in fields}) for c in columns}
    if probs and quantiles == "exact":
        _exact_quantiles(df, stats, {c: (values[(c, "min")], values[(c, "max")]) for c in columns}, probs)
    elif probs:
        held = [c for c in columns if stats[c].count]
        for group in chunks(held, 60):
            found = _sketched(df, {c: (as_double(c).cast("double"), list(probs)) for c in group})
            for c in group:
                stats[c].quantiles = dict(zip(probs, found[c]))
        for c in set(columns) - set(held):
            stats[c].quantiles = dict.fromkeys(probs)
    return stats


@dataclass
class _Bracket:
    """Values in [lo, hi] hold the order statistics ``rank`` and ``top`` (the next one), both counted from 0."""

    column: str
    prob: float
    rank: int
    share: float
    top: int
    lo: float
    hi: float
    below: int
    inside: int

    @property
    def holds(self) -> Column:
        return as_double(self.column).between(self.lo, self.hi)

    def moved(self, lo: float, hi: float, below: int, inside: int) -> bool:
        """Take a narrower bracket if the counts prove that both wanted values lie in it."""
        if below <= self.rank and self.top < below + inside and (inside < self.inside or hi - lo < self.hi - self.lo):
            self.lo, self.hi, self.below, self.inside = lo, hi, below, inside
            return True
        return False


def _exact_quantiles(df: DataFrame, stats: dict[str, ColumnStats], ranges: dict, probs: Sequence[float]) -> None:
    small, brackets = [], []
    for c, s in stats.items():
        s.quantiles = dict.fromkeys(probs)
        if not s.count:
            continue
        low, high = ranges[c]
        whole = isinstance(df.schema[c].dataType, INTEGRAL)
        if s.count <= MAP_LIMIT or (whole and high - low < MAP_LIMIT):
            small.append(c)
            continue
        finite = _finite(df, c, s.count) if math.isinf(low) or math.isinf(high) else (low, high, 0, s.count)
        low, high, below, inside = finite
        for p in probs:
            position = (s.count - 1) * p
            rank = min(int(position), s.count - 1)
            share, top = position - rank, min(rank + 1, s.count - 1)
            ends = [-math.inf if r < below else math.inf if r >= below + inside else None for r in (rank, top)]
            if ends[0] is not None:  # the wanted value is itself an infinity
                s.quantiles[p] = ends[0] if share == 0 or ends[1] is None or ends[0] == ends[1] else math.nan
            elif ends[1] is not None and share > 0:
                s.quantiles[p] = ends[1]
            else:
                brackets.append(_Bracket(c, p, rank, share, rank if ends[1] is not None else top, low, high, below, inside))
    for group in chunks(small, 8):
        places = {c: [((stats[c].count - 1) * p, p) for p in probs] for c in group}
        ranks = {c: sorted({r for x, _ in places[c] for r in (math.floor(x), math.ceil(x))}) for c in group}
        found = ranked_values(df, [Wanted(c, *ranges[c], tuple(ranks[c])) for c in group])
        for i, c in enumerate(group):
            for x, p in places[c]:
                stats[c].quantiles[p] = _between(found[(i, math.floor(x))], found[(i, math.ceil(x))], x - math.floor(x))
    for group in chunks(brackets, 24):
        _narrow(df, group)
        _read(df, group, stats)


def _finite(df: DataFrame, name: str, count: int) -> tuple[float, float, int, int]:
    """Range of a column's finite values, the infinities below them, and the number of finite values."""
    c = as_double(name).cast("double")
    real = F.when(F.abs(c) < F.lit(math.inf), c)
    found = agg_values(df, {"low": F.min(real), "high": F.max(real), "below": F.count_if(c == F.lit(-math.inf)), "inside": F.count(real)})
    return found["low"], found["high"], found["below"], found["inside"]


def _between(low: float, high: float, share: float) -> float:
    if share == 0 or low == high:
        return low
    return low * (1 - share) + high * share if math.isinf(low) or math.isinf(high) else low + (high - low) * share


def _read(df: DataFrame, brackets: list[_Bracket], stats: dict[str, ColumnStats]) -> None:
    """Read the order statistics of narrow brackets, from only the rows inside one of them."""
    open_ = [b for b in brackets if b.lo < b.hi]
    ends = {id(b): (b.rank - b.below, b.top - b.below) for b in open_}
    found = ranked_values(df, [Wanted(b.column, b.lo, b.hi, tuple(sorted(set(ends[id(b)])))) for b in open_])
    for i, b in enumerate(open_):
        low, high = (found[(i, r)] for r in ends[id(b)])
        stats[b.column].quantiles[b.prob] = _between(low, high, b.share)
    for b in brackets:
        if b.lo == b.hi:
            stats[b.column].quantiles[b.prob] = b.lo


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Shrink every bracket until few values are left; each round is one sketch pass and one counting pass.

    A bracket that is still wide after all rounds is read as it is: more values are counted, with the same result.
    """
    for turn in range(MAX_ROUNDS):
        wide = [b for b in brackets if b.lo < b.hi and b.inside > MAP_LIMIT]
        if not wide:
            return
        # Hot values can fill a bracket with rows but few distinct values, which can be counted.
        if turn:
            rough = agg_values(df, {i: F.approx_count_distinct(F.when(b.holds, as_double(b.column))) for i, b in enumerate(wide)})
            wide = [b for i, b in enumerate(wide) if rough[i] > MAP_LIMIT // 2]
            if not wide:
                return
        spans: dict[tuple, list[_Bracket]] = {}
        for b in wide:
            spans.setdefault((b.column, b.lo, b.hi), []).append(b)
        sketches = {}
        for key, members in spans.items():
            c = as_double(key[0]).cast("double")
            sketches[key] = (F.when(members[0].holds, c), [x for b in members for x in _ranks(b)])
        found = _sketched(df, sketches)
        tries = [(b, *found[key][2 * j : 2 * j + 2]) for key, members in spans.items() for j, b in enumerate(members)]
        counts = {}
        for i, (b, lo, hi) in enumerate(tries):
            c = as_double(b.column)
            counts[(i, "below")] = F.count_if(c < lo)
            counts[(i, "inside")] = F.count_if(c.between(lo, hi))
        counted = agg_values(df, counts)
        for i, (b, lo, hi) in enumerate(tries):
            if not b.moved(lo, hi, counted[(i, "below")], counted[(i, "inside")]):
                _bisect(df, b)


def _sketched(df: DataFrame, wanted: dict[tuple, tuple[Column, list[float]]]) -> dict[tuple, list[float]]:
    """Quantiles of each column from sketches, merged in two levels: sketches of some tasks first, then theirs."""
    part = (F.spark_partition_id() % SKETCH_PARTS).alias("part")
    partial = df.groupBy(part).agg(*[F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(f"s{i}") for i, (c, _) in enumerate(wanted.values())])
    merged = partial.agg(*[
        F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(F.col(f"s{i}"), F.lit(SKETCH_K)), F.array(*[F.lit(r) for r in ranks])).alias(f"q{i}")
        for i, (_, ranks) in enumerate(wanted.values())
    ]).first()
    return {key: merged[i] for i, key in enumerate(wanted)}


def _ranks(b: _Bracket) -> tuple[float, float]:
    """Ranks inside the bracket that enclose the wanted ones with room for the sketch's error."""
    last = max(b.inside - 1, 1)
    lo = max(0.0, (b.rank - b.below) / last - SKETCH_MARGIN)
    hi = min(1.0, (b.top - b.below) / last + SKETCH_MARGIN)
    return lo, hi


def _bisect(df: DataFrame, b: _Bracket) -> None:
    """Split a bracket by value; the exact way on when a sketch misses the rank."""
    mid = b.lo + (b.hi - b.lo) / 2
    c = as_double(b.column)
    left, right = c.between(b.lo, mid), (c > mid) & (c <= b.hi)
    found = agg_values(
        df,
        {"n": F.count_if(left), "left_max": F.max(F.when(left, c)), "right_min": F.min(F.when(right, c))},
    )
    edge = b.below + found["n"]
    if b.top < edge:
        b.hi, b.inside = found["left_max"], found["n"]
    elif b.rank >= edge:
        b.lo, b.inside, b.below = found["right_min"], b.inside - found["n"], edge
    else:
        # The two wanted values straddle the middle: they are its neighbours.
        lo, hi = found["left_max"], found["right_min"]
        counted = agg_values(df, {"below": F.count_if(c < lo), "inside": F.count_if(c.between(lo, hi))})
        b.lo, b.hi, b.below, b.inside = lo, hi, counted["below"], counted["inside"]
