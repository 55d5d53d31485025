"""Missing cells: text that stands for missing, reports, and fills or drops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_disguised
from ..functions.types import (
    INTEGRAL, as_double, col, dtype_name, is_numeric, is_text, nan_to_null, numeric_columns, require_columns, text_columns,
)
from ..functions.vocab import CORRELATED_MISSING_PCT, SEVERITY_LOW, SEVERITY_MEDIUM
from ..plans.fused import agg_values, column_report, empty, local_report, value_counts
from ..plans.frequent import top_texts
from ..plans.result import FixResult
from ..plans.state import remembered_state
from ..plans.stats import numeric_stats
from .profile import categorical_summary, missing_counts, numeric_summary

METHODS = ("fill_mean", "fill_median", "fill_mode", "fill_custom", "drop_rows", "drop_column", "do_nothing")


def hide_disguised(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn text that stands for missing ("N/A", "-", ...) into NULL, and float NaN too."""
    clean = nan_to_null(df)
    names = text_columns(df, columns)
    if not names:
        return clean
    return clean.withColumns({c: F.when(~is_disguised(col(c)), col(c)) for c in names})


def disguised_report(df: DataFrame) -> DataFrame:
    """Cells per text column that stand for missing; true NULLs do not count."""
    report = column_report(
        df, text_columns(df), {"disguised": lambda c: F.count_if(is_disguised(col(c)))}, "column string, disguised bigint"
    )
    return report.filter("disguised > 0")


def severity(pct: Column) -> Column:
    return F.when(pct < SEVERITY_LOW, "low").when(pct < SEVERITY_MEDIUM, "medium").otherwise("high")


def missing_report(df: DataFrame, replace_disguised: bool = True) -> DataFrame:
    """Columns with missing cells: count, percent, type, severity. One pass."""
    clean, state = hide_disguised(df) if replace_disguised else nan_to_null(df), remembered_state(df)
    schema = "column string, dtype string, n_rows bigint, missing_count bigint"
    if state:
        counted = [(c, dtype_name(df, c), s.n_rows, s.missing + s.disguised * replace_disguised) for c, s in state.columns.items()]
        report = local_report(df, counted, schema)
    else:
        fields = {"n_rows": lambda c: F.count("*"), "missing_count": lambda c: F.count_if(col(c).isNull())}
        report = column_report(clean, df.columns, fields, schema, facts=lambda c: {"dtype": dtype_name(df, c)})
    report = report.filter("missing_count > 0")
    pct = F.try_divide(100.0 * F.col("missing_count"), F.col("n_rows"))
    return report.withColumn("missing_pct", pct).withColumn("severity", severity(F.round("missing_pct", 2)))


def missing_summary(df: DataFrame, replace_disguised: bool = True) -> DataFrame:
    """One row for the table: missing cells, rows with any, clean columns and disguised cells.

    Columns are counted in chunks; rows with any missing cell are counted in one pass over all columns.
    """
    clean = hide_disguised(df) if replace_disguised else nan_to_null(df)
    zero = F.lit(0).cast("bigint")
    columns = missing_counts(clean).select("n_rows", "missing", (F.col("missing") == 0).cast("bigint").alias("is_clean"), F.lit(1).cast("bigint").alias("is_column"), zero.alias("rows"), zero.alias("disguised"))
    some = F.exists(F.array(*[col(c).isNull() for c in df.columns]), lambda missing: missing)
    rows = clean.agg(F.count("*").alias("n_rows"), F.count_if(some).alias("rows")).select("n_rows", zero.alias("missing"), zero.alias("is_clean"), zero.alias("is_column"), "rows", zero.alias("disguised"))
    parts = columns.unionByName(rows)
    if replace_disguised and text_columns(df):
        hidden = disguised_report(df).select(zero.alias("n_rows"), zero.alias("missing"), zero.alias("is_clean"), zero.alias("is_column"), zero.alias("rows"), "disguised")
        parts = parts.unionByName(hidden)
    row = parts.agg(
        F.max("n_rows").alias("n_rows"), F.sum("is_column").alias("n_columns"), F.sum("missing").alias("missing_cells"),
        F.sum("rows").alias("rows_with_missing"), F.sum("is_clean").alias("clean_columns"), F.sum("disguised").alias("disguised_cells"),
    )
    return row.withColumns(
        {
            "missing_pct": F.try_divide(100.0 * F.col("missing_cells"), F.col("n_rows") * F.col("n_columns")),
            "rows_missing_pct": F.try_divide(100.0 * F.col("rows_with_missing"), F.col("n_rows")),
        }
    )


def correlated_missing(df: DataFrame, replace_disguised: bool = True, min_pct: float = CORRELATED_MISSING_PCT) -> DataFrame:
    """Column pairs that are missing on the same rows: shared rows and the share of each column's missing rows.

    Rows are counted by their list of missing columns first, and only the distinct lists are expanded to pairs.
    """
    schema = "col_a string, col_b string, shared_rows bigint, pct_of_a double, pct_of_b double"
    clean = hide_disguised(df) if replace_disguised else nan_to_null(df)
    counts = agg_values(clean, {c: F.count_if(col(c).isNull()) for c in df.columns})
    names = [c for c in df.columns if counts[c] > 0]
    if len(names) < 2:
        return empty(df, schema)
    ids = F.filter(F.array(*[F.when(col(c).isNull(), F.lit(i)) for i, c in enumerate(names)]), lambda i: i.isNotNull())
    holes = clean.select(ids.alias("ids")).filter(F.size("ids") > 1)
    pairs = F.flatten(
        F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    lists = holes.groupBy("ids").agg(F.count("*").alias("rows"))
    shared = lists.select("rows", F.inline(pairs)).groupBy("a", "b").agg(F.sum("rows").alias("shared_rows"))
    name = F.array(*[F.lit(c) for c in names])
    total = F.array(*[F.lit(counts[c]).cast("bigint") for c in names])
    report = shared.select(
        name[F.col("a")].alias("col_a"), name[F.col("b")].alias("col_b"), "shared_rows",
        (100.0 * F.col("shared_rows") / total[F.col("a")]).alias("pct_of_a"),
        (100.0 * F.col("shared_rows") / total[F.col("b")]).alias("pct_of_b"),
    )
    return report.filter((F.round("pct_of_a", 1) >= min_pct) | (F.round("pct_of_b", 1) >= min_pct))


def missing_rows(df: DataFrame, column: str, order_by: Sequence[str], k: int = 5, replace_disguised: bool = True) -> DataFrame:
    """First ``k`` rows where a column is missing."""
    require_columns(df, [column])
    clean = hide_disguised(df) if replace_disguised else nan_to_null(df)
    return clean.filter(col(column).isNull()).orderBy(*[col(c) for c in order_by]).limit(k)


def mode_values(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on a tie; no entry for a column without values.

    Values are counted by a two-level aggregate, so no task holds a column's value map, and texts under their digests.
    """
    texts = text_columns(df, columns)
    tops, _ = top_texts(df, texts, 1)
    modes: dict[str, object] = {c: top[0][0] for c, top in tops.items() if top}
    columns = [c for c in columns if c not in texts]
    if not columns:
        return modes
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    whole = [c for c in columns if isinstance(df.schema[c].dataType, INTEGRAL)]
    numeric = numeric_columns(df, columns)
    # Ties compare as integers, then as doubles, then as text, each only where the column has that kind.
    order = F.struct(
        (-F.col("n")).alias("minus_n"),
        F.when(F.col("column").isin(whole), F.col("value").try_cast("decimal(20,0)")).alias("as_long"),
        F.when(F.col("column").isin(numeric), F.col("value").try_cast("double")).alias("as_double"),
        F.col("value").alias("value"),
    )
    best = counts.groupBy("column").agg(F.min(order).alias("best")).select("column", F.col("best.value").alias("value"))
    return modes | {r["column"]: r["value"] for r in best.collect()}  # one row a column


def fill_options(df: DataFrame, replace_disguised: bool = True) -> DataFrame:
    """Fill value each method would use, per column with missing cells; NULL where a method does not apply."""
    clean = hide_disguised(df) if replace_disguised else nan_to_null(df)
    counts = agg_values(clean, {c: F.count_if(col(c).isNull()) for c in df.columns})
    names = [c for c in df.columns if counts[c] > 0]
    stats = numeric_stats(clean, numeric_columns(df, names), want=("mean",), probs=(0.5,))
    modes = mode_values(clean, [c for c in names if isinstance(df.schema[c].dataType, T.AtomicType)])
    rows = [
        (c, dtype_name(df, c), counts[c], stats[c].mean if c in stats else None, stats[c].median if c in stats else None, modes.get(c))
        for c in names
    ]
    return local_report(
        df, rows, "column string, dtype string, missing_count bigint, fill_mean double, fill_median double, fill_mode string"
    )


@dataclass(frozen=True)
class MissingFit:
    """Fitted fills and drops; ``apply`` is row-local."""

    fills: dict[str, tuple[object, str]] = field(default_factory=dict)
    drop_columns: tuple[str, ...] = ()
    drop_rows: tuple[str, ...] = ()
    replace_disguised: bool = True
    applied: tuple = ()
    errors: tuple = ()
    warnings: tuple = ()

    row_local = True

    def apply(self, df: DataFrame) -> DataFrame:
        out = hide_disguised(df) if self.replace_disguised else nan_to_null(df)
        if self.fills:
            out = out.withColumns(
                {c: F.coalesce(col(c).cast(kind), F.lit(v).cast(kind)) for c, (v, kind) in self.fills.items()}
            )
        if self.drop_columns:
            out = out.drop(*[col(c) for c in self.drop_columns])
        for c in self.drop_rows:
            out = out.filter(col(c).isNotNull())
        return out


def fit_missing(df: DataFrame, plan: dict[str, dict], replace_disguised: bool = True) -> MissingFit:
    """Fit a per-column plan. All fills and column drops come before any row drop, whatever the plan's order."""
    clean = hide_disguised(df) if replace_disguised else nan_to_null(df)
    errors, warnings, applied = [], [], []
    fills: dict[str, tuple[object, str]] = {}
    wanted: dict[str, list[str]] = {m: [] for m in METHODS}
    for c, spec in plan.items():
        method = spec.get("method", "")
        if c not in df.columns:
            errors.append(f"'{c}' not in the table")
        elif method not in METHODS:
            errors.append(f"'{c}': unknown method '{method}'; valid: {', '.join(METHODS)}")
        elif method in ("fill_mean", "fill_median") and not is_numeric(df, c):
            errors.append(f"'{c}' is not numeric; use fill_mode or fill_custom")
        elif method == "fill_custom" and spec.get("value") is None:
            errors.append(f"'{c}': fill_custom needs a value")
        else:
            wanted[method].append(c)
    means = agg_values(clean, {c: F.avg(as_double(c)) for c in wanted["fill_mean"]})
    medians = numeric_stats(clean, wanted["fill_median"], want=(), probs=(0.5,)) if wanted["fill_median"] else {}
    modes = mode_values(clean, wanted["fill_mode"])
    for c in wanted["fill_mean"]:
        fills[c] = (means[c], "double")
    for c in wanted["fill_median"]:
        fills[c] = (medians[c].median, "double")
    for c in wanted["fill_mode"]:
        if c not in modes:
            errors.append(f"'{c}' has no mode: every value is missing")
        else:
            fills[c] = (modes[c], df.schema[c].dataType.simpleString())
    for c in wanted["fill_custom"]:
        value, kind = plan[c]["value"], df.schema[c].dataType.simpleString()
        if is_numeric(df, c) and isinstance(value, str):
            warnings.append(f"'{c}': text fill in a numeric column, the column becomes text")
            kind = "string"
        elif is_text(df, c) and not isinstance(value, str):
            warnings.append(f"'{c}': number fill in a text column, stored as text")
        elif isinstance(df.schema[c].dataType, INTEGRAL) and isinstance(value, float) and value != int(value):
            kind = "double"
        fills[c] = (value, kind)
    applied += [{"column": c, "method": plan[c]["method"], "value": fills[c][0]} for c in plan if c in fills]
    applied += [{"column": c, "method": m} for m in ("drop_column", "do_nothing", "drop_rows") for c in wanted[m]]
    return MissingFit(fills, tuple(wanted["drop_column"]), tuple(wanted["drop_rows"]), replace_disguised,
                      tuple(applied), tuple(errors), tuple(warnings))


def fix_missing(df: DataFrame, plan: dict[str, dict], replace_disguised: bool = True) -> FixResult:
    """Fit the plan and apply it."""
    fit = fit_missing(df, plan, replace_disguised)
    return FixResult(fit.apply(df), list(fit.applied), list(fit.errors), list(fit.warnings))


def rows_lost(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What dropping rows would cost per column: rows lost and their percent."""
    report = missing_report(df)
    kept = report if columns is None else report.filter(F.col("column").isin(list(columns)))
    return kept.select("column", F.col("missing_count").alias("rows_lost"), F.col("missing_pct").alias("rows_lost_pct"))


def distribution_change(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns before and after a fix: moments, their change, and cells filled."""
    names = [c for c in (columns or before.columns) if c in after.columns and is_numeric(before, c) and is_numeric(after, c)]
    old = numeric_summary(before, names)
    new = numeric_summary(after, names)
    joined = old.alias("b").join(new.alias("a"), "column")
    stats = ("count", "mean", "std", "min", "max")
    return joined.select(
        "column",
        *[F.col(f"b.{s}").alias(f"{s}_before") for s in stats],
        *[F.col(f"a.{s}").alias(f"{s}_after") for s in stats],
    ).withColumns(
        {
            "filled": F.col("count_after") - F.col("count_before"),
            "mean_delta": F.col("mean_after") - F.col("mean_before"),
            "std_delta": F.col("std_after") - F.col("std_before"),
            "mean_changed": F.abs(F.round(F.col("mean_after") - F.col("mean_before"), 4)) >= 0.01,
        }
    )


def top_values_change(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns before and after a fix: the five most frequent values and whether their ranking moved."""
    names = [c for c in (columns or text_columns(before)) if c in after.columns]

    def ranked(df: DataFrame, label: str) -> DataFrame:
        top = categorical_summary(df, names)
        listed = F.array_sort(F.collect_list(F.struct("rank", "value")))  # five rows a column
        return top.groupBy("column").agg(F.transform(listed, lambda r: r["value"]).alias(label))

    both = ranked(before, "top_before").join(ranked(after, "top_after"), "column", "full")
    return both.withColumn("top_changed", ~F.col("top_before").eqNullSafe(F.col("top_after")))
