"""Type changes. ``strict`` refuses a column with any bad value; ``try`` turns bad values into missing and counts them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised, parse_double, parse_long, strip
from ..functions.types import col, dtype_name, is_datetime, is_numeric, is_text, nan_to_null
from ..functions.vocab import FALSE_WORDS, TRUE_WORDS
from ..plans.fused import agg_values
from ..plans.result import FixResult
from .dates import KNOWN_FORMATS, best_formats, parse_date

TYPES = ("int64", "float64", "object", "bool", "datetime64[ns]", "category")


@dataclass(frozen=True)
class Cast:
    column: str
    to: str
    expr: Callable[[], Column]
    strict: bool


def to_bool(c: Column) -> Column:
    word = normalised(c.cast("string"))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def _expr(df: DataFrame, name: str, to: str, formats: dict[str, str]) -> Column:
    c = col(name)
    text = is_text(df, name)
    if to == "int64":
        return parse_long(strip(c)) if text else c.try_cast("bigint")
    if to == "float64":
        return parse_double(strip(c)) if text else c.try_cast("double")
    if to == "bool":
        if is_numeric(df, name):
            return F.when(c == 1, True).when(c == 0, False)
        return to_bool(c)
    if to == "datetime64[ns]":
        return parse_date(c, formats[name]) if text else c.try_cast("timestamp_ntz")
    return c.cast("string")


def cast_columns(df: DataFrame, changes: dict[str, str], mode: str = "strict") -> FixResult:
    """Cast columns to int64, float64, bool, category, datetime64[ns] or text (any other name).

    In ``strict`` mode int64 and float64 fail as a whole on a bad or (int64) missing value, as one pass of counts
    over all named columns shows before anything is changed. So does a date column none of whose values fits a known
    format. Other bad dates, and booleans, always become missing.
    """
    errors, applied, warnings = [], [], []
    clean = nan_to_null(df)
    known = {c: to for c, to in changes.items() if c in df.columns}
    errors += [f"'{c}' not in the table" for c in changes if c not in known]
    dates = [c for c, to in known.items() if to == "datetime64[ns]" and is_text(df, c)]
    formats = best_formats(clean, dates) if dates else {}
    unknown = {c for c in dates if not formats.get(c)}
    formats |= dict.fromkeys(unknown, KNOWN_FORMATS[0])
    exprs = {c: _expr(clean, c, to, formats) for c, to in known.items()}
    counts = agg_values(
        clean,
        {(c, k): v for c, e in exprs.items() for k, v in
         (("bad", F.count_if(col(c).isNotNull() & e.isNull())), ("missing", F.count_if(col(c).isNull())))},
    )
    accepted: dict[str, Column] = {}
    for c, to in known.items():
        bad, missing = counts[(c, "bad")], counts[(c, "missing")]
        whole = to in ("int64", "float64")
        if mode == "strict" and whole and (bad or (to == "int64" and missing)):
            errors.append(f"'{c}' cannot become {to}: {bad} bad and {missing} missing values")
            continue
        if mode == "strict" and c in unknown and bad:
            errors.append(f"'{c}' cannot become {to}: none of its {bad} values fits one of {', '.join(KNOWN_FORMATS)}")
            continue
        if is_datetime(df, c) and to == "datetime64[ns]":
            continue
        metadata = {"category": True} if to == "category" else {"category": False}
        accepted[c] = exprs[c].alias(c, metadata=metadata)
        applied.append({"column": c, "from": dtype_name(df, c), "to": to, "failed": bad})
        if bad:
            warnings.append(f"'{c}': {bad} values could not become {to} and are now missing")
    out = clean.select(*[accepted.get(c, col(c).alias(c)) for c in df.columns])
    return FixResult(out, applied, errors, warnings)


def category_domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a category column."""
    return df.select(col(column).alias("value")).filter("value is not null").distinct()
