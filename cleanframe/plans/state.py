"""Statistics of all columns from one pass, shared by the scans of one table.

The state of a column is a few numbers: rows, missing and disguised cells, texts that read as numbers, and the central moments, range and
signs of numbers. States of two parts of a table merge into that of the whole, so an appended part needs no second look at
the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_disguised, numeric_text
from ..functions.types import as_double, col, nan_to_null, numeric_columns, text_columns
from .fused import agg_values

STATE_CHUNK = 60


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


@dataclass(frozen=True)
class ColumnState:
    """``m2`` and ``m3`` are sums of squared and cubed deviations from the mean."""

    n_rows: int = 0
    missing: int = 0
    disguised: int = 0
    numeric_texts: int = 0
    mean: float | None = None
    m2: float = 0.0
    m3: float = 0.0
    min: float | None = None
    max: float | None = None
    zeros: int = 0
    negatives: int = 0

    @property
    def count(self) -> int:
        return self.n_rows - self.missing

    @property
    def std(self) -> float | None:
        return math.sqrt(max(self.m2, 0.0) / (self.count - 1)) if self.count > 1 else None

    @property
    def skew_pop(self) -> float | None:
        """Skewness of the values there are; NaN for a constant, as Spark has it."""
        if not self.count:
            return None
        return math.nan if self.m2 == 0 else math.sqrt(self.count) * self.m3 / self.m2**1.5

    def merge(self, other: ColumnState) -> ColumnState:
        a, b = (self, other) if self.count else (other, self)
        n, m = a.count, b.count
        mean, m2, m3 = a.mean, a.m2, a.m3
        if m and b.mean is not None and a.mean is not None:
            d, total = b.mean - a.mean, n + m
            mean = a.mean + d * m / total
            m2 = a.m2 + b.m2 + d * d * n * m / total
            m3 = a.m3 + b.m3 + d**3 * n * m * (n - m) / total**2 + 3 * d * (n * b.m2 - m * a.m2) / total
        return ColumnState(
            a.n_rows + b.n_rows, a.missing + b.missing, a.disguised + b.disguised, a.numeric_texts + b.numeric_texts, mean, m2, m3,
            _least(a.min, b.min), _most(a.max, b.max), a.zeros + b.zeros, a.negatives + b.negatives)


@dataclass(frozen=True)
class TableState:
    """The states of the columns of one table."""

    columns: dict[str, ColumnState] = field(default_factory=dict)

    def merge(self, other: TableState) -> TableState:
        if set(self.columns) != set(other.columns):
            raise ValueError("states of different columns cannot be merged")
        return TableState({c: s.merge(other.columns[c]) for c, s in self.columns.items()})


def fit_state(df: DataFrame) -> TableState:
    """All states in one pass; a wide table is read in chunks of columns, each of them once."""
    clean = nan_to_null(df)
    text, numeric = set(text_columns(df)), set(numeric_columns(df))
    exprs = {}
    for c in df.columns:
        exprs[(c, "n_rows")] = F.count("*")
        exprs[(c, "missing")] = F.count_if(col(c).isNull())
        if c in text:
            exprs[(c, "disguised")] = F.count_if(is_disguised(col(c)))
            exprs[(c, "numeric_texts")] = F.count(numeric_text(col(c)))
        elif c in numeric:
            x = as_double(c)
            exprs |= {(c, "mean"): F.avg(x), (c, "std"): F.stddev_samp(x), (c, "skew"): F.skewness(x), (c, "min"): F.min(x), (c, "max"): F.max(x),
                      (c, "zeros"): F.count_if(x == 0), (c, "negatives"): F.count_if(x < 0)}
    values = agg_values(clean, exprs, chunk=STATE_CHUNK)
    states = {}
    for c in df.columns:
        own = {name: v for (of, name), v in values.items() if of == c}
        std, skew = own.pop("std", None), own.pop("skew", None)
        n = own["n_rows"] - own["missing"]
        m2 = std * std * (n - 1) if std is not None else 0.0
        m3 = skew * m2**1.5 / math.sqrt(n) if skew is not None and not math.isnan(skew) else 0.0 if m2 == 0 else math.nan
        states[c] = ColumnState(**own, m2=m2, m3=m3)
    return TableState(states)


_remembered: list[tuple[DataFrame, TableState]] = []


@contextmanager
def remembered(df: DataFrame, state: TableState | None) -> Iterator[None]:
    """Within the block, scans of this DataFrame read ``state`` and not the table."""
    if state is None:
        yield
        return
    _remembered.append((df, state))
    try:
        yield
    finally:
        _remembered.remove((df, state))


def remembered_state(df: DataFrame) -> TableState | None:
    return next((s for d, s in reversed(_remembered) if d is df), None)
