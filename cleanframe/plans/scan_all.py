"""All six scans over one table, and how many of them found something."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import columns_report
from ..operators.duplicates import duplicate_count
from ..operators.missing import missing_report
from ..operators.outliers import outlier_report
from ..operators.rules import suggested_rules_report
from ..operators.transforms import skewness_report
from .fused import local_report
from .state import TableState, fit_state, remembered

TASKS = ("columns", "missing", "duplicates", "outliers", "transforms", "validation")


@dataclass
class ScanOutcome:
    """The report of one scan, or why it failed."""

    report: DataFrame | None
    error: str | None = None


def _scans(as_of_year: int | None, quantiles: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {
        "columns": columns_report,
        "missing": missing_report,
        "duplicates": duplicate_count,
        "outliers": lambda df: outlier_report(df, quantiles=quantiles),
        "transforms": skewness_report,
        "validation": lambda df: suggested_rules_report(df, as_of_year),
    }


def _state(df: DataFrame) -> TableState | None:
    """Shared statistics; where they fail, every scan reads the table by itself, and only those fail that must."""
    try:
        return fit_state(df)
    except Exception:
        return None


def scan_all(df: DataFrame, as_of_year: int | None = None, quantiles: str = "exact") -> dict[str, ScanOutcome]:
    """Run the scans in order; one that fails, when it is planned or when it reads the data, does not stop the others.

    A report has a row per column or rule, so it is read at once and held as local rows. Counts, moments and ranges of all
    columns come from one pass that the scans share.
    """
    out = {}
    with remembered(df, _state(df)):
        for task, scan in _scans(as_of_year, quantiles).items():
            try:
                report = scan(df)
                out[task] = ScanOutcome(df.sparkSession.createDataFrame(report.collect(), report.schema))
            except Exception as exc:
                out[task] = ScanOutcome(None, str(exc))
    return out


def issue_report(df: DataFrame, as_of_year: int | None = None, quantiles: str = "exact", tasks: Sequence[str] = TASKS) -> DataFrame:
    """(task, signal, has_issue, error): columns with issues, missing cells, redundant rows, columns with outliers, columns
    to transform, suggested rules. A failed scan counts as an issue, shows a NULL signal and says why."""
    signals: dict[str, Callable[[], DataFrame]] = {
        "columns": lambda: columns_report(df).agg(F.count_if("has_issue")),
        "missing": lambda: missing_report(df).agg(F.coalesce(F.sum("missing_count"), F.lit(0))),
        "duplicates": lambda: duplicate_count(df).select("duplicate_count"),
        "outliers": lambda: outlier_report(df, quantiles=quantiles).agg(F.count_if("has_outliers")),
        "transforms": lambda: skewness_report(df).agg(F.count_if("needs_transform")),
        "validation": lambda: suggested_rules_report(df, as_of_year).agg(F.count("*")),
    }
    rows = []
    shared = sum(task in ("columns", "missing", "outliers", "transforms") for task in tasks) > 1
    with remembered(df, _state(df) if shared else None):
        for task in tasks:
            try:
                value = signals[task]().first()[0]
                rows.append((task, value, value > 0, None))
            except Exception as exc:
                rows.append((task, None, True, str(exc)))
    return local_report(df, rows, "task string, signal bigint, has_issue boolean, error string")


def issue_count(df: DataFrame, as_of_year: int | None = None, quantiles: str = "exact") -> DataFrame:
    """One row: tasks run and tasks with an issue."""
    report = issue_report(df, as_of_year, quantiles)
    return report.agg(F.count("*").alias("tasks_run"), F.count_if("has_issue").alias("tasks_with_issues"))
