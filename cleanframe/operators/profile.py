"""Profiling scans over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double, col, dtype_name, nan_to_null, numeric_columns, text_columns
from ..plans.fused import column_report, empty, local_report, top_per_group, value_counts
from ..plans.frequent import top_texts
from ..plans.stats import numeric_stats


def overview(df: DataFrame) -> DataFrame:
    """One row: table shape and column list."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                                                       names.alias("column_names"))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First rows under a stated order; a distributed table has no order of its own."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def numeric_describe(df: DataFrame, columns: Sequence[str] | None = None, quantiles: str = "exact") -> DataFrame:
    """count, mean, sample std, min, quartiles and max; a statistic that does not exist is 0."""
    names = numeric_columns(df, columns)
    stats = numeric_stats(df, names, probs=(0.25, 0.5, 0.75), quantiles=quantiles)
    rows = []
    for c in names:
        s = stats[c]
        found = (s.mean, s.std, s.min, s.q1, s.median, s.q3, s.max)
        rows.append((c, s.count, *[0.0 if v is None else v for v in found]))
    return local_report(
        df, rows, "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )


def categorical_describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, distinct values, most frequent value (smallest on a tie) and its frequency, per text column."""
    names = text_columns(df, columns)
    schema = "column string, count bigint, n_unique bigint, top string, freq bigint"
    if not names:
        return empty(df, schema)
    tops, totals = top_texts(df, names, 1)
    rows = [(c, *totals[c], *(tops[c][0] if tops[c] else ("NaN", None))) for c in names]
    return local_report(df, rows, schema)


def column_info(df: DataFrame) -> DataFrame:
    """Type and non-missing count of every column."""
    clean = nan_to_null(df)
    return column_report(
        clean, df.columns, {"non_null": lambda c: F.count(col(c))}, "column string, dtype string, non_null bigint",
        facts=lambda c: {"dtype": dtype_name(df, c)},
    )


def missing_counts(clean: DataFrame) -> DataFrame:
    """(column, n_rows, missing) of every column, read in chunks of columns, so that wide tables compile."""
    return column_report(
        clean, clean.columns, {"n_rows": lambda c: F.count("*"), "missing": lambda c: F.count_if(col(c).isNull())},
        "column string, n_rows bigint, missing bigint",
    )


def status(df: DataFrame) -> DataFrame:
    """One row: shape and total missing cells; each column is read once."""
    return missing_counts(nan_to_null(df)).agg(
        F.max("n_rows").alias("n_rows"),
        F.count("*").alias("n_columns"),
        F.sum("missing").alias("missing_cells"),
    )


def fix_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a fix did, in numbers: rows and missing cells before and after. Each side is read once, when asked for."""
    sides = status(before).select(F.lit("before").alias("side"), "n_rows", "missing_cells").union(status(after).select(F.lit("after"), "n_rows", "missing_cells"))
    one = {f"{c}_{s}": F.max(F.when(F.col("side") == s, F.col(c))) for c in ("n_rows", "missing_cells") for s in ("before", "after")}
    row = sides.agg(*[e.alias(name) for name, e in one.items()])
    return row.withColumns({"rows_removed": F.col("n_rows_before") - F.col("n_rows_after"), "missing_added": F.col("missing_cells_after") - F.col("missing_cells_before")})


def min_max(df: DataFrame) -> DataFrame:
    """Range of every numeric column, as context for range rules."""
    return column_report(
        nan_to_null(df), numeric_columns(df),
        {"min": lambda c: F.min(as_double(c)), "max": lambda c: F.max(as_double(c))},
        "column string, min double, max double",
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min and max of numeric columns."""
    return column_report(
        nan_to_null(df), numeric_columns(df, columns),
        {
            "count": lambda c: F.count(col(c)),
            "mean": lambda c: F.avg(as_double(c)),
            "std": lambda c: F.stddev_samp(as_double(c)),
            "min": lambda c: F.min(as_double(c)),
            "max": lambda c: F.max(as_double(c)),
        },
        "column string, count bigint, mean double, std double, min double, max double", weight=8,
    )


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each non-numeric column (ties: smallest value), with the column's count."""
    wanted = list(columns) if columns is not None else text_columns(df)
    names = [c for c in wanted if c not in numeric_columns(df)]
    if not names:
        return empty(df, "column string, rank int, value string, n bigint")
    texts = text_columns(df, names)
    tops, _ = top_texts(df, texts, k)
    rows = [(c, i, value, n) for c in texts for i, (value, n) in enumerate(tops[c], 1)]
    report = local_report(df, rows, "column string, rank int, value string, n bigint")
    others = [c for c in names if c not in texts]
    if not others:
        return report
    counts = value_counts(df, others).filter(F.col("value").isNotNull())
    return report.unionByName(top_per_group(counts, ["column"], [F.col("n").desc(), F.col("value")], k).select("column", "rank", "value", "n"))
