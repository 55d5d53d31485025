"""Fitted fixes on a stream.

Fits are made on a bounded table; an apply that looks at one row at a time needs no state, so the same expressions run
on a streaming DataFrame. Deduplication and refits do look at other rows and have no place here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def apply_fits(df: DataFrame, *fits) -> DataFrame:
    """Apply fitted, row-local fixes in order to a batch or streaming DataFrame."""
    for fit in fits:
        if not getattr(fit, "row_local", False):
            raise TypeError(f"{type(fit).__name__} is not row-local")
        df = fit.apply(df)
    return df
