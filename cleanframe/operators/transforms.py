"""Skewness and the transforms that reduce it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_double, col, is_numeric, nan_to_null, numeric_columns
from ..functions.vocab import MIN_VALUES_SKEW
from ..plans.fused import column_report, local_report
from ..plans.result import FixResult
from ..plans.state import remembered_state
from ..plans.stats import numeric_stats, skew_expr
from .lambda_search import boxcox, boxcox_lambdas, yeojohnson, yeojohnson_lambdas

METHODS = ("log", "log1p", "sqrt", "boxcox", "yeojohnson", "reciprocal", "do_nothing")
_NEEDS_POSITIVE = ("log", "boxcox", "reciprocal")
_NEEDS_NON_NEGATIVE = ("log1p", "sqrt")


def skew_level(skew: Column) -> Column:
    size = F.abs(skew)
    return F.when(size < 0.5, "symmetric").when(size < 1.0, "moderate").otherwise("high")


def skew_direction(skew: Column) -> Column:
    return F.when(skew > 0, "right").when(skew < 0, "left").otherwise("none")


def recommended_transform(skew: Column, zeros: Column, negatives: Column) -> Column:
    size = F.abs(skew)
    return (
        F.when(size < 0.5, "do_nothing")
        .when(negatives > 0, "yeojohnson")
        .when((skew > 0) & (size >= 1.0) & (zeros > 0), "log1p")
        .when((skew > 0) & (size >= 1.0), "log")
        .when(skew > 0, "sqrt")
        .otherwise("yeojohnson")
    )


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness per numeric column; 0 for a constant or fewer than three values."""
    return column_report(
        nan_to_null(df), numeric_columns(df, columns),
        {"n": lambda c: F.count(col(c)), "skewness": lambda c: skew_expr(as_double(c))},
        "column string, n bigint, skewness double", weight=6,
    )


def skewness_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Skew class, recommended transform and which transforms apply, all from one pass.

    A column with an infinity has no skewness and counts as 0.
    """
    schema, state = "column string, n bigint, skewness double, zeros bigint, negatives bigint, min double, max double", remembered_state(df)
    if state:
        stats = numeric_stats(df, numeric_columns(df, columns), want=("min", "max", "skew_pop", "zeros", "negatives"))
        report = local_report(df, [(c, s.count, s.skew, s.zeros, s.negatives, s.min, s.max) for c, s in stats.items()], schema)
    else:
        report = column_report(
            nan_to_null(df), numeric_columns(df, columns),
            {
                "n": lambda c: F.count(col(c)),
                "skewness": lambda c: skew_expr(as_double(c)),
                "zeros": lambda c: F.count_if(as_double(c) == 0),
                "negatives": lambda c: F.count_if(as_double(c) < 0),
                "min": lambda c: F.min(as_double(c)),
                "max": lambda c: F.max(as_double(c)),
            },
            schema, weight=10,
        )
    report = report.filter(F.col("n") >= MIN_VALUES_SKEW)
    skew, positive = F.round("skewness", 4), F.col("min") > 0  # classes go by four decimals
    flags = {f"can_{m}": positive for m in _NEEDS_POSITIVE}
    flags.update({f"can_{m}": F.col("min") >= 0 for m in _NEEDS_NON_NEGATIVE})
    return report.withColumns(
        {
            "level": skew_level(skew),
            "direction": skew_direction(skew),
            "recommended": recommended_transform(skew, F.col("zeros"), F.col("negatives")),
            "needs_transform": F.abs(skew) >= 0.5,
            **flags,
            "can_yeojohnson": F.lit(True),
        }
    )


@dataclass(frozen=True)
class TransformFit:
    """One method per column, with the fitted power where it has one; ``apply`` is row-local."""

    steps: tuple[tuple[str, str, float | None], ...] = ()
    applied: tuple = ()
    errors: tuple = ()

    row_local = True

    def apply(self, df: DataFrame) -> DataFrame:
        clean = nan_to_null(df)
        exprs = {c: transform_expr(as_double(c), m, power) for c, m, power in self.steps}
        return clean.withColumns(exprs) if exprs else clean


def transform_expr(x: Column, method: str, power: float | None = None) -> Column:
    if method == "log":
        return F.ln(x)
    if method == "log1p":
        return F.log1p(x)
    if method == "sqrt":
        return F.sqrt(x)
    if method == "reciprocal":
        return F.try_divide(F.lit(1.0), x)
    if method == "boxcox":
        return boxcox(x, power)
    return yeojohnson(x, power)


def fit_transform(df: DataFrame, plan: dict[str, str]) -> TransformFit:
    """Check every column's domain in one pass and search the powers; a refused column does not stop the others."""
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
    stats = numeric_stats(df, list(wanted), want=("min", "max", "skew_pop")) if wanted else {}
    steps: list[tuple[str, str, float | None]] = []
    applied, search = [], {"boxcox": [], "yeojohnson": []}
    for c, method in wanted.items():
        s = stats[c]
        if s.count < MIN_VALUES_SKEW:
            errors.append(f"'{c}' has fewer than {MIN_VALUES_SKEW} values")
        elif method in _NEEDS_POSITIVE and s.min <= 0:
            errors.append(f"'{c}': {method} needs every value above 0")
        elif method in _NEEDS_NON_NEGATIVE and s.min < 0:
            errors.append(f"'{c}': {method} needs every value at or above 0")
        elif method in search and s.min == s.max:
            errors.append(f"'{c}' is constant; {method} has no best power")
        elif method in search:
            search[method].append(c)
            steps.append((c, method, None))
        elif method == "do_nothing":
            applied.append({"column": c, "method": method})
        else:
            steps.append((c, method, None))
    powers = {**boxcox_lambdas(df, search["boxcox"]), **yeojohnson_lambdas(df, search["yeojohnson"])}
    errors += [f"'{c}': no power is best; its likelihood is not finite or has no maximum" for c, p in powers.items() if p is None]
    steps = [(c, m, powers.get(c)) for c, m, _ in steps if powers.get(c, 0.0) is not None]
    applied += [{"column": c, "method": m, "lambda": p, "skew_before": stats[c].skew} for c, m, p in steps]
    return TransformFit(tuple(steps), tuple(applied), tuple(errors))


def fix_skew(df: DataFrame, plan: dict[str, str]) -> FixResult:
    """Fit the plan and apply it. A transformed column becomes double."""
    fit = fit_transform(df, plan)
    return FixResult(fit.apply(df), list(fit.applied), list(fit.errors))


def skew_change(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skewness before and after a transform, and by how much its size shrank."""
    old = skewness(before, columns).select("column", F.col("skewness").alias("skew_before"))
    new = skewness(after, columns).select("column", F.col("skewness").alias("skew_after"))
    both = old.join(new, "column")
    gain = F.abs("skew_before") - F.abs("skew_after")
    return both.withColumns({"improvement": gain, "improved": gain > 0})
