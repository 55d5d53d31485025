"""Outliers of single columns by z-score and by interquartile range."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double, col, is_numeric, nan_to_null, numeric_columns
from ..functions.vocab import IQR_FACTOR, MIN_VALUES_OUTLIER, Z_LIMIT
from ..plans.fused import column_report, empty, long_values, top_per_group
from ..plans.result import FixResult
from ..plans.stats import ColumnStats, numeric_stats

METHODS = ("cap_iqr", "cap_zscore", "remove", "do_nothing")
_REPORT = (
    "column string, n bigint, mean double, std double, min double, max double, q1 double, q3 double, iqr double, "
    "lower_fence double, upper_fence double, zscore_outliers bigint, iqr_outliers bigint"
)


def fit_outliers(df: DataFrame, columns: Sequence[str] | None = None, quantiles: str = "exact") -> dict[str, ColumnStats]:
    """Moments and quartiles of the numeric columns that hold at least four values."""
    stats = numeric_stats(df, numeric_columns(df, columns), probs=(0.25, 0.75), quantiles=quantiles)
    return {c: s for c, s in stats.items() if s.count >= MIN_VALUES_OUTLIER}


def fences(s: ColumnStats) -> tuple[float, float]:
    """Lower and upper fence; where the quartiles are not finite there is none on either side."""
    lo, hi = s.q1 - IQR_FACTOR * s.iqr, s.q3 + IQR_FACTOR * s.iqr
    return (lo, hi) if math.isfinite(lo) and math.isfinite(hi) else (-math.inf, math.inf)


def has_z(s: ColumnStats) -> bool:
    """Whether z-scores exist: an infinity leaves a column without mean or deviation, a constant without deviation."""
    return bool(s.std) and math.isfinite(s.mean) and math.isfinite(s.std)


def is_z_outlier(s: ColumnStats) -> Column:
    x = as_double(s.column)
    if not has_z(s):
        return x.isNotNull() & F.lit(False)
    return F.abs((x - F.lit(s.mean)) / F.lit(s.std)) > Z_LIMIT


def is_iqr_outlier(s: ColumnStats) -> Column:
    lo, hi = fences(s)
    x = as_double(s.column)
    return (x < lo) | (x > hi)


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None, quantiles: str = "exact") -> DataFrame:
    """Per column: statistics, fences, and how many values each method flags. All columns share each pass."""
    fitted = fit_outliers(df, columns, quantiles)

    def facts(c: str) -> dict[str, object]:
        s, (lo, hi) = fitted[c], fences(fitted[c])
        return {"n": s.count, "mean": s.mean, "std": s.std, "min": s.min, "max": s.max, "q1": s.q1, "q3": s.q3,
                "iqr": s.iqr, "lower_fence": lo, "upper_fence": hi}

    report = column_report(
        nan_to_null(df), list(fitted),
        {
            "zscore_outliers": lambda c: F.count_if(is_z_outlier(fitted[c])),
            "iqr_outliers": lambda c: F.count_if(is_iqr_outlier(fitted[c])),
        },
        _REPORT, facts,
    )
    return report.withColumns(
        {
            "has_outliers": (F.col("zscore_outliers") > 0) | (F.col("iqr_outliers") > 0),
            "most_flagged": F.greatest("zscore_outliers", "iqr_outliers"),
        }
    )


def skipped_columns(df: DataFrame, columns: Sequence[str] | None = None, need: int = MIN_VALUES_OUTLIER) -> DataFrame:
    """Numeric columns with fewer values than a report needs, which it leaves out: (column, n, reason)."""
    report = column_report(nan_to_null(df), numeric_columns(df, columns), {"n": lambda c: F.count(col(c))}, "column string, n bigint")
    return report.filter(F.col("n") < need).withColumn("reason", F.concat(F.lit("fewer than "), F.lit(str(need)), F.lit(" values")))


def outlier_totals(df: DataFrame, columns: Sequence[str] | None = None, quantiles: str = "exact") -> DataFrame:
    """One row: columns analysed, with outliers, clean, and skipped for want of values."""
    report = outlier_report(df, columns, quantiles).select("has_outliers", F.lit(False).alias("skipped"))
    left_out = skipped_columns(df, columns).select(F.lit(False).alias("has_outliers"), F.lit(True).alias("skipped"))
    return report.union(left_out).agg(
        F.count_if(~F.col("skipped")).alias("analysed"), F.count_if("has_outliers").alias("with_outliers"),
        F.count_if(~F.col("skipped") & ~F.col("has_outliers")).alias("clean"), F.count_if("skipped").alias("skipped"),
    )


def outlier_samples(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, quantiles: str = "exact") -> DataFrame:
    """Up to ``k`` values outside the fences per column, smallest first."""
    fitted = fit_outliers(df, columns, quantiles)
    if not fitted:
        return empty(df, "column string, rank int, value double")
    flagged = nan_to_null(df).select(*[F.when(is_iqr_outlier(s), as_double(c)).alias(c) for c, s in fitted.items()])
    values = long_values(flagged, list(fitted)).filter("value is not null").withColumn("value", F.col("value").cast("double"))
    return top_per_group(values, ["column"], [F.col("value")], k).select("column", "rank", "value")


@dataclass(frozen=True)
class OutlierFit:
    """Caps and kept ranges in plan order; ``apply`` is row-local."""

    steps: tuple[tuple[str, str, float, float], ...] = ()
    applied: tuple = ()
    errors: tuple = field(default=())

    row_local = True

    def apply(self, df: DataFrame) -> DataFrame:
        out = nan_to_null(df)
        for c, action, lo, hi in self.steps:
            x = col(c).cast("double")
            if action == "cap":
                out = out.withColumn(c, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))))
            else:
                out = out.filter(x.isNull() | x.between(lo, hi))
        return out


def fit_outlier_fix(df: DataFrame, plan: dict[str, str], quantiles: str = "exact") -> OutlierFit:
    """Fit a plan column by column in its own order.

    A removal changes what later columns see, so statistics are fitted afresh after each removal; the steps up to and
    including a removal share one fit.
    """
    errors, wanted = [], []
    for c, method in plan.items():
        if c not in df.columns:
            errors.append(f"'{c}' not in the table")
        elif method not in METHODS:
            errors.append(f"'{c}': unknown method '{method}'; valid: {', '.join(METHODS)}")
        elif not is_numeric(df, c):
            errors.append(f"'{c}' is not numeric")
        else:
            wanted.append((c, method))
    segments: list[list[tuple[str, str]]] = [[]]
    for c, method in wanted:
        segments[-1].append((c, method))
        if method == "remove":
            segments.append([])
    steps, applied = [], []
    for segment in segments:
        names = [c for c, method in segment if method != "do_nothing"]
        current = OutlierFit(tuple(steps)).apply(df)
        stats = numeric_stats(current, names, probs=(0.25, 0.75), quantiles=quantiles) if names else {}
        for c, method in segment:
            if method == "do_nothing":
                applied.append({"column": c, "method": method})
                continue
            s = stats[c]
            if s.count < MIN_VALUES_OUTLIER:
                errors.append(f"'{c}' has fewer than {MIN_VALUES_OUTLIER} values")
                continue
            lo, hi = fences(s)
            if method == "cap_zscore":
                if not has_z(s):
                    note = "constant column, no change" if s.std == 0 else "not all values are finite, no change"
                    applied.append({"column": c, "method": method, "note": note})
                    continue
                lo, hi = s.mean - Z_LIMIT * s.std, s.mean + Z_LIMIT * s.std
            if math.isinf(lo):
                applied.append({"column": c, "method": method, "note": "quartiles are not finite, no change"})
                continue
            steps.append((c, "keep" if method == "remove" else "cap", lo, hi))
            applied.append({"column": c, "method": method, "lower": lo, "upper": hi})
    return OutlierFit(tuple(steps), tuple(applied), tuple(errors))


def fix_outliers(df: DataFrame, plan: dict[str, str], quantiles: str = "exact") -> FixResult:
    """Fit the plan and apply it. A capped column becomes double."""
    fit = fit_outlier_fix(df, plan, quantiles)
    return FixResult(fit.apply(df), list(fit.applied), list(fit.errors))
