"""Pearson correlation over pairwise complete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import col, nan_to_null, numeric_columns
from ..functions.vocab import CORRELATION_LIMIT
from ..plans.fused import agg_values, empty, local_report
from ..plans.gram import correlations, pair_sums

_PAIRS = "col_a string, col_b string, correlation double"


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Upper triangle in long form; NULL where a column is constant over the rows both have."""
    names, r = _matrix(df, columns)
    rows = [(a, names[j], _value(r[i, j])) for i, a in enumerate(names) for j in range(i + 1, len(names))]
    return local_report(df, rows, _PAIRS)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full matrix in long form, the diagonal included."""
    names, r = _matrix(df, columns)
    rows = [(a, b, _value(1.0 if i == j and r[i, j] == r[i, j] else r[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return local_report(df, rows, _PAIRS)


def _matrix(df: DataFrame, columns: Sequence[str] | None):
    names = numeric_columns(df, columns)
    return names, correlations(pair_sums(nan_to_null(df), names)[1]) if names else None


def _value(r: float) -> float | None:
    return None if r != r else float(r)


def high_correlations(df: DataFrame, threshold: float = CORRELATION_LIMIT, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs at or above ``threshold`` in absolute value, strongest first, and which column to drop.

    The column with more missing cells is the one to drop, the second on a tie.
    """
    names = numeric_columns(df, columns)
    if len(names) < 2:
        return empty(df, _PAIRS + ", drop_candidate string")
    missing = agg_values(nan_to_null(df), {c: F.count_if(col(c).isNull()) for c in names})
    lookup = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(missing[c]))])
    strong = correlation_pairs(df, names).filter(F.abs("correlation") >= threshold)
    drop = F.when(lookup[F.col("col_a")] > lookup[F.col("col_b")], F.col("col_a")).otherwise(F.col("col_b"))
    return strong.withColumn("drop_candidate", drop).orderBy(F.round(F.abs("correlation"), 4).desc(), "col_a", "col_b")
