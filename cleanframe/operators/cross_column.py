"""Rules between two columns of the same row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import col, nan_to_null, require_columns
from ..functions.vocab import AGE_TOLERANCE
from ..plans.result import FixResult
from .rules import current_year

RULES = ("end_after_start", "age_matches_birth_year", "a_less_than_b", "a_greater_than_b")


def pair_violation(rule: str, col_a: str, col_b: str, tolerance: float = AGE_TOLERANCE, as_of_year: int | None = None) -> Column:
    """True where both values are present and contradict the rule, false elsewhere."""
    a, b = col(col_a), col(col_b)
    if rule == "end_after_start":
        broken = b < a
    elif rule == "age_matches_birth_year":
        year = current_year() if as_of_year is None else as_of_year
        # As doubles: a sentinel such as the least integer must not overflow.
        broken = F.abs(a.cast("double") - (F.lit(float(year)) - b.cast("double"))) > tolerance
    elif rule == "a_less_than_b":
        broken = a >= b
    elif rule == "a_greater_than_b":
        broken = a <= b
    else:
        raise ValueError(f"unknown rule '{rule}'; valid: {', '.join(RULES)}")
    return F.coalesce(broken, F.lit(False))


def cross_column_report(df: DataFrame, rule: str, col_a: str, col_b: str, **params) -> DataFrame:
    """One row: rows where both are present, violations, passed."""
    require_columns(df, [col_a, col_b])
    broken = pair_violation(rule, col_a, col_b, **params)
    return nan_to_null(df).agg(
        F.lit(rule).alias("rule"),
        F.count_if(col(col_a).isNotNull() & col(col_b).isNotNull()).alias("rows_checked"),
        F.count_if(broken).alias("violations"),
    ).withColumn("passed", F.col("violations") == 0)


def cross_column_samples(df: DataFrame, rule: str, col_a: str, col_b: str, order_by: Sequence[str], k: int = 5, **params) -> DataFrame:
    """First ``k`` contradicting rows: the order key and both values."""
    require_columns(df, [col_a, col_b, *order_by])
    shown = list(dict.fromkeys([*order_by, col_a, col_b]))
    bad = nan_to_null(df).filter(pair_violation(rule, col_a, col_b, **params))
    return bad.orderBy(*[col(c) for c in order_by]).limit(k).select(*[col(c) for c in shown])


def fix_cross_column(df: DataFrame, rule: str, col_a: str, col_b: str, clear: str, **params) -> FixResult:
    """Clear one chosen column where the rule is broken now; the other column stays."""
    require_columns(df, [col_a, col_b, clear])
    broken = pair_violation(rule, col_a, col_b, **params)
    out = nan_to_null(df).withColumn(clear, F.when(~broken, col(clear)))
    return FixResult(out, [{"column": clear, "rule": rule}])
