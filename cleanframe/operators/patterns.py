"""Text formats: named patterns, detection and checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.types import col, require_columns, text_columns
from ..functions.vocab import PATTERN_RATE, PATTERNS
from ..plans.fused import agg_values, empty, local_report
from .columns import sample_values


def pattern_regex(pattern: str, custom_regex: str | None = None) -> str:
    """Java regex of a named pattern, or of a custom one anchored at the start only."""
    if pattern == "custom":
        if not custom_regex:
            raise ValueError("pattern 'custom' needs custom_regex")
        # Named groups are spelled (?P<name> in one dialect and (?<name> in the other.
        java = re.sub(r"\(\?P<", "(?<", custom_regex)
        java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
        return f"(?U)^(?:{java})"
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern '{pattern}'; valid: {', '.join([*PATTERNS, 'custom'])}")
    return "(?U)" + PATTERNS[pattern]


def matches(c: Column, pattern: str, custom_regex: str | None = None) -> Column:
    return strip(c.cast("string")).rlike(pattern_regex(pattern, custom_regex))


def _check_regex(df: DataFrame, pattern: str, custom_regex: str | None) -> None:
    """Compile a custom pattern before it meets data, so that a bad one is a plain error."""
    regex = pattern_regex(pattern, custom_regex)
    if pattern == "custom":
        try:
            re.compile(custom_regex)
            df.sparkSession.range(1).select(F.lit("").rlike(regex)).first()
        except Exception as exc:
            raise ValueError(f"invalid regex: {custom_regex}") from exc


def detect_patterns(df: DataFrame, sample: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Best named pattern per text column where at least 80 % of the values match; the earlier pattern wins a tie.

    All values are tested in one pass; ``sample`` decides from the first values under ``order_by`` and then counts
    the violations of the chosen pattern over all values.
    """
    names = text_columns(df)
    schema = "column string, pattern string, n_values bigint, match_rate double, violations bigint"
    if not names:
        return empty(df, schema)

    def counts_of(frame: DataFrame) -> dict:
        exprs = {(c, "n"): F.count(col(c)) for c in names}
        exprs.update({(c, p): F.count_if(matches(col(c), p)) for c in names for p in PATTERNS})
        return agg_values(frame, exprs)

    if sample is None:
        decide = counts_of(df)
    else:
        picked = sample_values(df, names, order_by, sample)
        decide = {(c, k): 0 for c in names for k in ("n", *PATTERNS)}
        tests = [F.count_if(matches(F.col("value"), p)).alias(p) for p in PATTERNS]
        for row in picked.groupBy("column").agg(F.count("*").alias("n"), *tests).collect():  # one row a column
            decide.update({(row["column"], k): row[k] for k in ("n", *PATTERNS)})
    chosen = {}
    for c in names:
        n = decide[(c, "n")]
        best = max(PATTERNS, key=lambda p, c=c: decide[(c, p)])
        if n and decide[(c, best)] / n >= PATTERN_RATE:
            chosen[c] = (best, 100.0 * decide[(c, best)] / n)
    if sample is None:
        full = {c: (decide[(c, "n")], decide[(c, p)]) for c, (p, _) in chosen.items()}
    else:
        exprs = {(c, "n"): F.count(col(c)) for c in chosen}
        exprs.update({(c, "ok"): F.count_if(matches(col(c), p)) for c, (p, _) in chosen.items()})
        found = agg_values(df, exprs)
        full = {c: (found[(c, "n")], found[(c, "ok")]) for c in chosen}
    rows = [(c, p, full[c][0], rate, full[c][0] - full[c][1]) for c, (p, rate) in chosen.items()]
    return local_report(df, rows, schema)


def check_pattern(df: DataFrame, column: str, pattern: str, custom_regex: str | None = None) -> DataFrame:
    """One row: values checked, violations, pass rate (100 for an empty column) and passed."""
    require_columns(df, [column])
    _check_regex(df, pattern, custom_regex)
    c = col(column)
    row = df.agg(
        F.lit(pattern).alias("pattern"),
        F.count(c).alias("values_checked"),
        F.count_if(~matches(c, pattern, custom_regex)).alias("violations"),
    )
    share = F.try_divide(100.0 * (F.col("values_checked") - F.col("violations")), F.col("values_checked"))
    return row.withColumns({"pass_rate": F.coalesce(share, F.lit(100.0)), "passed": F.col("violations") == 0})


def pattern_violations(
    df: DataFrame, column: str, pattern: str, order_by: Sequence[str], k: int | None = 5, custom_regex: str | None = None
) -> DataFrame:
    """Rows whose value does not match: the first ``k`` under ``order_by``, or all when ``k`` is None."""
    require_columns(df, [column, *order_by])
    _check_regex(df, pattern, custom_regex)
    bad = df.filter(~matches(col(column), pattern, custom_regex))
    shown = bad.select(*[col(c) for c in dict.fromkeys([*order_by, column])])
    return shown if k is None else shown.orderBy(*[col(c) for c in order_by]).limit(k)

