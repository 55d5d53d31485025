"""What a fix did, measured by the job that writes its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.types import col, nan_to_null
from ..sources.readers import write_table
from .fused import local_report
from .result import FixResult

SIDES = ("before", "after")


def _missing_cells(df: DataFrame) -> Column:
    cells = F.array(*[col(c).isNull() for c in df.columns]) if df.columns else F.array().cast("array<boolean>")
    return F.coalesce(F.sum(F.size(F.filter(cells, lambda missing: missing))), F.lit(0)).cast("bigint")


def write_fixed(
    df: DataFrame, fix, path: str, fmt: str = "parquet", mode: str = "errorifexists", measures: dict[str, Callable[[DataFrame], Column]] | None = None
) -> DataFrame:
    """Apply ``fix``, write the result, and say what it did: one row, as ``fix_effect`` has it, without reading either side again.

    ``fix`` is a fitted fix, or a function of the table that returns one or a ``FixResult``; what it fits, it fits first. ``measures``
    are more aggregates of either side, by name, each a function of the table: ``{"total": lambda t: F.sum("price")}`` adds
    ``total_before`` and ``total_after``. A measure of a column that the fix drops is missing afterwards.
    """
    wanted = {"n_rows": lambda t: F.count("*"), "missing_cells": _missing_cells, **(measures or {})}
    seen = {side: Observation(f"{side}") for side in SIDES}

    def watched(table: DataFrame, side: str) -> DataFrame:
        exprs = []
        for name, make in wanted.items():
            usable = not measures or name not in measures or _resolves(table, make(table))
            exprs.append((make(table) if usable else F.max(F.lit(None).cast("double"))).alias(name))
        return table.observe(seen[side], *exprs)

    before = watched(nan_to_null(df), "before")
    fixed = fix.apply(before) if hasattr(fix, "apply") else fix(before)
    fixed = fixed.df if isinstance(fixed, FixResult) else fixed
    write_table(watched(nan_to_null(fixed), "after"), path, fmt, mode)
    values = {side: seen[side].get for side in SIDES}
    row = {f"{name}_{side}": values[side][name] for name in wanted for side in SIDES}
    row["rows_removed"] = row["n_rows_before"] - row["n_rows_after"]
    row["missing_added"] = row["missing_cells_after"] - row["missing_cells_before"]
    kinds = {k: "bigint" if isinstance(v, int) else "string" if isinstance(v, str) else "double" for k, v in row.items()}
    return local_report(df, [tuple(float(v) if kinds[k] == "double" and v is not None else v for k, v in row.items())], ", ".join(f"`{k}` {kinds[k]}" for k in row))


def _resolves(table: DataFrame, measure: Column) -> bool:
    try:
        return bool(table.limit(0).agg(measure).schema)
    except Exception:
        return False
