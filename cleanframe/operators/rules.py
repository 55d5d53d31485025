"""Value rules on single columns: suggestion, evaluation and fixes. A fix re-evaluates the rule, never row numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import col, is_numeric, name_matches, nan_to_null, numeric_columns
from ..functions.vocab import (
    AGE_KEYWORDS, COUNT_KEYWORDS, MIN_YEAR, MONEY_KEYWORDS, PERCENT_KEYWORDS, YEAR_KEYWORDS,
)
from ..plans.fused import column_report, empty, local_report, top_per_group
from ..plans.result import FixResult

RULES = ("no_future_year", "no_past_year", "no_negative", "percentage", "custom_range", "no_nulls")


@dataclass(frozen=True)
class Rule:
    column: str
    rule: str
    params: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        shown = ",".join(f"{k}={self.params[k]}" for k in sorted(self.params))
        return f"{self.rule}({shown})" if shown else self.rule


def current_year() -> int:
    return date.today().year


def suggest_rules(df: DataFrame, as_of_year: int | None = None, match: str = "substring") -> list[Rule]:
    """Rules that numeric column names suggest; the first matching kind wins."""
    year = current_year() if as_of_year is None else as_of_year
    rules = []
    for c in numeric_columns(df):
        if name_matches(c, YEAR_KEYWORDS, match):
            rules.append(Rule(c, "no_future_year", {"year": year}))
            rules.append(Rule(c, "custom_range", {"min": MIN_YEAR, "max": year}))
        elif name_matches(c, AGE_KEYWORDS, match):
            rules.append(Rule(c, "custom_range", {"min": 0, "max": 150}))
        elif name_matches(c, PERCENT_KEYWORDS, match):
            rules.append(Rule(c, "percentage"))
        elif name_matches(c, MONEY_KEYWORDS, match) or name_matches(c, COUNT_KEYWORDS, match):
            rules.append(Rule(c, "no_negative"))
    return rules


def suggested_rules_report(df: DataFrame, as_of_year: int | None = None, match: str = "substring") -> DataFrame:
    rows = [(r.column, r.label) for r in suggest_rules(df, as_of_year, match)]
    return local_report(df, rows, "column string, rule string")


def check_rule(df: DataFrame, rule: Rule) -> str | None:
    """Why a rule cannot run on this table, or None."""
    if rule.column not in df.columns:
        return f"'{rule.column}' not in the table"
    if rule.rule not in RULES:
        return f"unknown rule '{rule.rule}'; valid: {', '.join(RULES)}"
    if rule.rule != "no_nulls" and not is_numeric(df, rule.column):
        return f"'{rule.column}' is not numeric; {rule.rule} needs numbers"
    if rule.rule == "custom_range" and rule.params.get("min") is None and rule.params.get("max") is None:
        return "custom_range needs min, max or both"
    return None


def _broken(rule: Rule) -> Column:
    """The plain comparison, which a filter can push into a scan; NULL where the value is missing."""
    c, p = col(rule.column), rule.params
    if rule.rule == "no_nulls":
        return c.isNull()
    if rule.rule == "no_future_year":
        return c > F.lit(p.get("year", current_year()))
    if rule.rule == "no_past_year":
        return c < F.lit(p.get("min_year", MIN_YEAR))
    if rule.rule == "no_negative":
        return c < 0
    lo, hi = (0, 100) if rule.rule == "percentage" else (p.get("min"), p.get("max"))
    if lo is None or hi is None:
        return c < F.lit(lo) if hi is None else c > F.lit(hi)
    return (c < F.lit(lo)) | (c > F.lit(hi))


def violation(rule: Rule) -> Column:
    """True where a row breaks the rule, false elsewhere; a missing value breaks only ``no_nulls``."""
    return F.coalesce(_broken(rule), F.lit(False))


def run_rules(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[str]]:
    """Evaluate all rules together: (column, rule, violations, passed) and the errors of rules that cannot run."""
    errors = [e for r in rules if (e := check_rule(df, r))]
    usable = [r for r in rules if not check_rule(df, r)]
    report = column_report(
        nan_to_null(df), usable,
        {"violations": lambda r: F.count_if(violation(r))}, "column string, rule string, violations bigint",
        facts=lambda r: {"column": r.column, "rule": r.label},
    )
    return report.withColumn("passed", F.col("violations") == 0), errors


def rules_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("rules_run"),
        F.count_if(F.col("passed")).alias("rules_passed"),
        F.count_if(~F.col("passed")).alias("rules_failed"),
        F.coalesce(F.sum("violations"), F.lit(0)).alias("total_violations"),
    )


def violating_rows(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """One row per broken rule and table row: (keep..., column, rule, value as text)."""
    usable = [r for r in rules if not check_rule(df, r)]
    if not usable:
        return empty(df, "column string, rule string, value string")
    broken = F.array(*[
        F.when(violation(r), F.struct(F.lit(r.column).alias("column"), F.lit(r.label).alias("rule"), col(r.column).cast("string").alias("value")))
        for r in usable
    ])
    suspects = df
    if not any(r.rule == "no_nulls" for r in usable):
        # Looser than the rules only for NaN; it lets the scan skip row groups without violations.
        suspects = df.filter(reduce(lambda a, b: a | b, [_broken(r) for r in usable]))
    return nan_to_null(suspects).select(*[col(k) for k in keep], F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("b")).select(
        *[col(k) for k in keep], "b.column", "b.rule", "b.value"
    )


def rule_samples(df: DataFrame, rules: Sequence[Rule], order_by: Sequence[str], k: int = 5) -> DataFrame:
    """First ``k`` violating values per rule under ``order_by``."""
    rows = violating_rows(df, rules, order_by)
    order = [col(c) for c in order_by] + [F.col("value")]
    return top_per_group(rows, ["column", "rule"], order, k).select("column", "rule", "rank", "value")


def _fitting(df: DataFrame, name: str, value) -> tuple[object, str | None]:
    """A replacement in the column's own kind, or why there is none."""
    if is_numeric(df, name):
        try:
            return (value if isinstance(value, (int, float)) else float(value)), None
        except (TypeError, ValueError):
            return None, f"'{name}' holds numbers; '{value}' is not one"
    if isinstance(df.schema[name].dataType, T.StringType):
        return str(value), None
    return value, None


def fix_violations(df: DataFrame, rule: Rule, action: str, value=None) -> FixResult:
    """``replace`` by a value, ``set_null`` or ``drop_rows`` where the rule is broken now."""
    problem = check_rule(df, rule)
    if problem is None and action not in ("replace", "set_null", "drop_rows"):
        problem = f"unknown action '{action}'; valid: replace, set_null, drop_rows"
    if problem is None and action == "replace" and value is None:
        problem = "replace needs a value"
    if problem is None and action == "replace":
        value, problem = _fitting(df, rule.column, value)
    if problem:
        return FixResult(df, errors=[problem])
    clean, broken, c = nan_to_null(df), violation(rule), col(rule.column)
    if action == "replace":
        out = clean.withColumn(rule.column, F.when(broken, F.lit(value)).otherwise(c))
    elif action == "set_null":
        out = clean.withColumn(rule.column, F.when(~broken, c))
    else:
        out = clean.filter(~broken)
    return FixResult(out, [{"column": rule.column, "rule": rule.label, "action": action}])

