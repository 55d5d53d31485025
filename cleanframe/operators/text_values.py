"""Formatting problems in text cells, and the methods that clean them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TEXT_METHODS, has_outer_space, has_special
from ..functions.types import col, is_text, text_columns
from ..plans.fused import column_report, empty, long_values, top_per_group
from ..plans.frequent import known, texts_of, variant_keys
from ..plans.result import FixResult


def whitespace_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _share_scan(df, columns, has_outer_space)


def special_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _share_scan(df, columns, has_special)


def _share_scan(df: DataFrame, columns, test) -> DataFrame:
    report = column_report(
        df, text_columns(df, columns),
        {"non_null": lambda c: F.count(col(c)), "affected": lambda c: F.count_if(test(col(c)))},
        "column string, non_null bigint, affected bigint",
    )
    return report.withColumn("affected_pct", F.try_divide(100.0 * F.col("affected"), F.col("non_null")))


def text_samples(df: DataFrame, test, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """Up to ``k`` distinct affected values per column, smallest first."""
    names = text_columns(df, columns)
    if not names:
        return empty(df, "column string, rank int, value string")
    hits = long_values(df, names).filter(test(F.col("value"))).distinct()
    return top_per_group(hits, ["column"], [F.col("value")], k).select("column", "rank", "value")


def case_variants(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: distinct values, distinct values ignoring case, and how many are mere variants."""
    names = text_columns(df, columns)
    if not names:
        return empty(df, "column string, n_distinct bigint, n_distinct_lower bigint, n_variants bigint")
    cells = df.select(*[F.when(col(c).isNotNull(), F.struct(known(col(c)).alias("own"), known(F.lower(col(c))).alias("lower"))).alias(str(i)) for i, c in enumerate(names)])
    cells = cells.unpivot([], [str(i) for i in range(len(names))], "slot", "value").filter("value is not null")
    label = F.array(*[F.lit(c) for c in names])[F.col("slot").cast("int")]
    values = cells.groupBy("slot", "value").agg(F.count("*").alias("n")).select(label.alias("column"), "value.lower")
    per_lower = values.groupBy("column", "lower").agg(F.count("*").alias("spellings"))
    return per_lower.groupBy("column").agg(
        F.sum("spellings").alias("n_distinct"),
        F.count("*").alias("n_distinct_lower"),
        (F.sum("spellings") - F.count("*")).alias("n_variants"),
    )


def case_variant_groups(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """The first ``k`` groups per column of values that differ only by case, one row per spelling."""
    names = text_columns(df, columns)
    schema = "column string, lower_value string, rank int, value string"
    if not names:
        return empty(df, schema)
    keys = variant_keys(df, names, F.lower, k)
    if not keys:
        return empty(df, schema)
    label = F.array(*[F.lit(c) for c in names])[F.col("slot")]
    spelled = texts_of(df, names, keys, F.lower).select(label.alias("column"), F.lower("text").alias("lower_value"), F.col("text").alias("value"))
    window = Window.partitionBy("column").orderBy("lower_value")
    return spelled.withColumn("rank", F.dense_rank().over(window)).filter(F.col("rank") <= k).select("column", "lower_value", "rank", "value")


def text_value_report(df: DataFrame) -> DataFrame:
    """Whitespace, case and special-character problems side by side; only columns with a problem."""
    spaces = column_report(
        df, text_columns(df),
        {
            "non_null": lambda c: F.count(col(c)),
            "whitespace_count": lambda c: F.count_if(has_outer_space(col(c))),
            "special_count": lambda c: F.count_if(has_special(col(c))),
        },
        "column string, non_null bigint, whitespace_count bigint, special_count bigint",
    )
    cases = case_variants(df).select("column", F.col("n_variants").alias("case_variants"))
    joined = spaces.join(cases, "column", "left").withColumn("case_variants", F.coalesce("case_variants", F.lit(0)))
    return joined.filter("whitespace_count > 0 or case_variants > 0 or special_count > 0")


def clean_text(df: DataFrame, plan: dict[str, str]) -> FixResult:
    """Apply one cleaning method per column; missing stays missing, and a bad entry does not stop the others."""
    errors, exprs = [], {}
    for name, method in plan.items():
        if name not in df.columns:
            errors.append(f"'{name}' not in the table")
        elif not is_text(df, name):
            errors.append(f"'{name}' is not a text column")
        elif method not in TEXT_METHODS:
            errors.append(f"'{name}': unknown method '{method}'; valid: {', '.join(TEXT_METHODS)}")
        else:
            exprs[name] = TEXT_METHODS[method](col(name))
    out = df.withColumns(exprs) if exprs else df
    return FixResult(out, [{"column": c, "method": plan[c]} for c in exprs], errors)
