"""Dates and year columns outside an accepted range of years."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import MAXYEAR, MINYEAR, date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import col, datetime_columns, is_datetime, is_numeric, name_matches, nan_to_null, numeric_columns
from ..functions.vocab import MIN_YEAR, YEAR_RANGE_KEYWORDS
from ..plans.fused import column_report, empty, top_per_group, union_all
from ..plans.result import FixResult
from .rules import current_year


def year_columns(df: DataFrame, match: str = "substring") -> list[str]:
    return [c for c in numeric_columns(df) if name_matches(c, YEAR_RANGE_KEYWORDS, match)]


def _outside(df: DataFrame, name: str, min_year: int, max_year: int) -> Column:
    """Comparison with the first days of years, which a Parquet scan can use to skip row groups."""
    c = col(name)
    if is_datetime(df, name):
        early = c < F.lit(date(min_year, 1, 1)) if MINYEAR <= min_year <= MAXYEAR else F.lit(min_year > MAXYEAR) & c.isNotNull()
        late = c >= F.lit(date(max_year + 1, 1, 1)) if MINYEAR <= max_year + 1 <= MAXYEAR else F.lit(max_year < MINYEAR) & c.isNotNull()
        return early | late
    return (c < min_year) | (c > max_year)


def out_of_range(df: DataFrame, name: str, min_year: int, max_year: int) -> Column:
    return F.coalesce(_outside(df, name, min_year, max_year), F.lit(False))


def date_range_report(df: DataFrame, min_year: int = MIN_YEAR, max_year: int | None = None, match: str = "substring") -> DataFrame:
    """Violations per date column and per numeric year column; only columns with violations."""
    top = current_year() if max_year is None else max_year
    names = [*datetime_columns(df), *year_columns(df, match)]
    report = column_report(
        nan_to_null(df), names,
        {
            "non_null": lambda c: F.count(col(c)),
            "violations": lambda c: F.count_if(out_of_range(df, c, min_year, top)),
        },
        "column string, dtype string, non_null bigint, violations bigint",
        facts=lambda c: {"dtype": df.schema[c].dataType.simpleString()},
    )
    return report.filter("violations > 0")


def date_range_samples(
    df: DataFrame, min_year: int = MIN_YEAR, max_year: int | None = None, k: int = 5, match: str = "substring"
) -> DataFrame:
    """Up to ``k`` violating values per column, earliest first."""
    top = current_year() if max_year is None else max_year
    clean = nan_to_null(df)
    parts = []
    for c in [*datetime_columns(df), *year_columns(df, match)]:
        bad = clean.filter(_outside(df, c, min_year, top)).select(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
        parts.append(bad)
    if not parts:
        return empty(df, "column string, rank int, value string")
    return top_per_group(union_all(parts), ["column"], [F.col("value")], k).select("column", "rank", "value")


def fix_date_range(df: DataFrame, columns: Sequence[str] | str, min_year: int = MIN_YEAR, max_year: int | None = None) -> FixResult:
    """Clear dates or years outside the range; rows stay."""
    top = current_year() if max_year is None else max_year
    names = [columns] if isinstance(columns, str) else list(columns)
    errors, exprs = [], {}
    for c in names:
        if c not in df.columns:
            errors.append(f"'{c}' not in the table")
        elif not (is_datetime(df, c) or is_numeric(df, c)):
            errors.append(f"'{c}' is neither a date nor a numeric column")
        else:
            exprs[c] = F.when(~out_of_range(df, c, min_year, top), col(c))
    out = nan_to_null(df)
    return FixResult(out.withColumns(exprs) if exprs else out, [{"column": c, "range": [min_year, top]} for c in exprs], errors)
