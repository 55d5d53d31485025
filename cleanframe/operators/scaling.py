"""Numeric ranges and rescaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double, col, is_numeric, nan_to_null, numeric_columns
from ..functions.vocab import MIN_VALUES_SCALE
from ..plans.fused import column_report
from ..plans.result import FixResult
from ..plans.stats import numeric_stats

METHODS = ("minmax", "zscore", "robust", "do_nothing")


def scaling_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Range and moments per numeric column, widest range first, and whether it is already scaled."""
    report = column_report(
        nan_to_null(df), numeric_columns(df, columns),
        {
            "n": lambda c: F.count(col(c)),
            "min": lambda c: F.min(as_double(c)),
            "max": lambda c: F.max(as_double(c)),
            "mean": lambda c: F.avg(as_double(c)),
            "std": lambda c: F.stddev_samp(as_double(c)),
        },
        "column string, n bigint, min double, max double, mean double, std double", weight=8,
    ).filter(F.col("n") >= MIN_VALUES_SCALE)
    return (
        report.withColumn("range", F.col("max") - F.col("min"))
        .withColumns(
            {
                "already_minmax": (F.col("min") >= -0.01) & (F.col("max") <= 1.01) & (F.col("range") <= 1.01),
                "already_zscore": (F.abs("mean") < 0.1) & (F.abs(F.col("std") - 1.0) < 0.1),
            }
        )
        .orderBy(F.col("range").desc(), "column")
    )


@dataclass(frozen=True)
class ScaleFit:
    """Per column: subtract a centre, divide by a spread; ``apply`` is row-local."""

    steps: tuple[tuple[str, float, float], ...] = ()
    applied: tuple = ()
    errors: tuple = ()

    row_local = True

    def apply(self, df: DataFrame) -> DataFrame:
        clean = nan_to_null(df)
        exprs = {c: (as_double(c) - F.lit(centre)) / F.lit(spread) for c, centre, spread in self.steps}
        return clean.withColumns(exprs) if exprs else clean


def fit_scale(df: DataFrame, plan: dict[str, str], quantiles: str = "exact") -> ScaleFit:
    """Fit a plan; a constant column stays as it is under minmax and zscore."""
    errors, wanted = [], {}
    for c, method in plan.items():
        if c not in df.columns:
            errors.append(f"'{c}' not in the table")
        elif method not in METHODS:
            errors.append(f"'{c}': unknown method '{method}'; valid: {', '.join(METHODS)}")
        elif not is_numeric(df, c):
            errors.append(f"'{c}' is not numeric")
        else:
            wanted[c] = method
    robust = [c for c, m in wanted.items() if m == "robust"]
    stats = numeric_stats(df, [c for c in wanted if c not in robust]) if len(robust) < len(wanted) else {}
    if robust:
        stats.update(numeric_stats(df, robust, want=(), probs=(0.25, 0.5, 0.75), quantiles=quantiles))
    steps, applied = [], []
    for c, method in wanted.items():
        s = stats[c]
        if method == "do_nothing":
            applied.append({"column": c, "method": method})
            continue
        if s.count < MIN_VALUES_SCALE:
            errors.append(f"'{c}' has fewer than {MIN_VALUES_SCALE} values")
            continue
        if method == "minmax":
            centre, spread = s.min, s.max - s.min
        elif method == "zscore":
            centre, spread = s.mean, s.std
        else:
            centre, spread = s.median, s.iqr or 1.0
        if not math.isfinite(centre) or not math.isfinite(spread):
            errors.append(f"'{c}' has values that are not finite; {method} has no scale")
        elif spread:
            steps.append((c, centre, spread))
            applied.append({"column": c, "method": method, "centre": centre, "spread": spread})
        else:
            applied.append({"column": c, "method": method, "note": "constant column, no change"})
    return ScaleFit(tuple(steps), tuple(applied), tuple(errors))


def fix_scale(df: DataFrame, plan: dict[str, str], quantiles: str = "exact") -> FixResult:
    """Fit the plan and apply it. A scaled column becomes double."""
    fit = fit_scale(df, plan, quantiles)
    return FixResult(fit.apply(df), list(fit.applied), list(fit.errors))
