"""Column names and type suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_name, name_issues, normalised, numeric_text, parse_double, strip
from ..functions.types import (
    NUMERIC, as_double, col, dtype_name, name_matches, nan_to_null, text_columns,
)
from ..functions.vocab import CARDINALITY_FLOOR, CARDINALITY_SHARE, FALSE_WORDS, ID_KEYWORDS, TRUE_WORDS
from ..plans.fused import agg_values, approx_distinct, column_report, exact_distinct, local_report, long_values, top_per_group
from ..plans.result import FixResult
from ..plans.state import remembered_state

APPROX_SLACK = 0.65  # the screen is about 5 % off; this leaves seven standard errors


def numeric_as_text(df: DataFrame, sample: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Text columns whose values all read as numbers once ``, $ %`` are removed.

    All values are tested; ``sample`` tests the first values under ``order_by`` instead.
    """
    names = text_columns(df)
    schema = "column string, values_checked bigint, numeric_values bigint, numeric_as_text boolean"
    if sample is None:
        found = column_report(
            df, names,
            {
                "values_checked": lambda c: F.count(col(c)),
                "numeric_values": lambda c: F.count(numeric_text(col(c))),
                "numeric_as_text": lambda c: (F.count(col(c)) > 0) & (F.count(col(c)) == F.count(numeric_text(col(c)))),
            },
            schema,
        )
        return found
    first = sample_values(df, names, order_by, sample)
    return (
        first.groupBy("column")
        .agg(F.count("*").alias("values_checked"), F.count(numeric_text(F.col("value"))).alias("numeric_values"))
        .withColumn("numeric_as_text", F.col("values_checked") == F.col("numeric_values"))
    )


def sample_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int = 3) -> DataFrame:
    """First ``k`` non-missing values of each column: under ``order_by``, else the smallest values as text."""
    keep = [f"__order_{i}" for i in range(len(order_by))]
    keyed = nan_to_null(df).withColumns({k_: col(c) for k_, c in zip(keep, order_by)})
    cells = long_values(keyed, columns, keep).filter(F.col("value").isNotNull())
    order = [F.col(c) for c in keep] + [F.col("value")]
    return top_per_group(cells, ["column"], order, k).select("column", "rank", "value")


def columns_report(df: DataFrame) -> DataFrame:
    """Per column: suggested name, type, issues in the name, and whether it holds numbers as text."""
    text = set(text_columns(df))
    none = F.array().cast("array<string>")
    issues = {c: name_issues(c) for c in df.columns}
    schema = "column string, suggested_name string, needs_fix boolean, dtype string, issues array<string>"
    state = remembered_state(df)

    def all_issues(c: str):
        named = F.array(*[F.lit(i) for i in issues[c]]) if issues[c] else none
        if c not in text:
            return named
        counted = F.count(col(c))
        numeric = (counted > 0) & (counted == F.count(numeric_text(col(c))))
        return F.concat(named, F.when(numeric, F.array(F.lit("numeric_as_text"))).otherwise(none))

    def facts(c: str) -> dict[str, object]:
        return {"suggested_name": clean_name(c), "needs_fix": clean_name(c) != c, "dtype": dtype_name(df, c)}

    if state:
        numbers = {c: ["numeric_as_text"] for c, s in state.columns.items() if c in text and 0 < s.count == s.numeric_texts}
        found = local_report(df, [(c, *facts(c).values(), [*issues[c], *numbers.get(c, [])]) for c in df.columns], schema)
    else:
        found = column_report(df, df.columns, {"issues": all_issues}, schema, facts=facts)
    return found.withColumn("has_issue", F.col("needs_fix") | (F.size("issues") > 0))


def rename_clean(df: DataFrame) -> FixResult:
    """Rename every column to its clean form; refused as a whole when two names would collide."""
    mapping = {c: clean_name(c) for c in df.columns}
    by_target: dict[str, list[str]] = {}
    for old, new in mapping.items():
        by_target.setdefault(new, []).append(old)
    clashes = {new: olds for new, olds in by_target.items() if len(olds) > 1 or not new}
    if clashes:
        return FixResult(df, errors=[f"columns {olds} would all become '{new}'" for new, olds in clashes.items()])
    changed = {old: new for old, new in mapping.items() if old != new}
    return FixResult(_renamed(df, changed), applied=[{"rename": old, "to": new} for old, new in changed.items()])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> FixResult:
    """Rename some columns; a bad pair is reported and the others proceed."""
    errors, changed = [], {}
    for old, new in mapping.items():
        target = new.strip()
        if old not in df.columns:
            errors.append(f"'{old}' not in the table")
        elif not target:
            errors.append(f"'{old}': the new name is blank")
        elif target != old:
            changed[old] = target
    result = [changed.get(c, c) for c in df.columns]
    for old in list(changed):
        if result.count(changed[old]) > 1:
            errors.append(f"'{old}': a column '{changed[old]}' already exists")
            del changed[old]
    return FixResult(_renamed(df, changed), [{"rename": o, "to": n} for o, n in changed.items()], errors)


def _renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[col(c).alias(mapping.get(c, c), metadata=df.schema[c].metadata) for c in df.columns])


def type_findings(df: DataFrame, match: str = "substring") -> DataFrame:
    """Hidden booleans, likely identifiers and high-cardinality text, as (column, finding, dtype, n_unique, n_rows).

    A distinct sketch rules most columns out; only columns near or over a limit are counted exactly.
    """
    clean = nan_to_null(df)
    flat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    numbers = [c for c in flat if isinstance(df.schema[c].dataType, NUMERIC)]
    named = [c for c in flat if name_matches(c, ID_KEYWORDS, match)]
    texts = text_columns(df)
    screened = list(dict.fromkeys(named + texts))
    exprs = {"rows": F.count("*")}
    for c in numbers:
        x = as_double(c)
        exprs[(c, "bool")] = (F.min(x) == 0) & (F.max(x) == 1) & (F.count_if((x != 0) & (x != 1)) == 0)
    # Sketches run in their own pass: beside them Spark would not compile the plain aggregates.
    values = agg_values(clean, exprs)
    rough = approx_distinct(clean, screened)
    rows = values["rows"]
    maybe_id = [c for c in named if rough[c] >= APPROX_SLACK * rows]
    maybe_high = [c for c in texts if rough[c] >= APPROX_SLACK * CARDINALITY_SHARE * rows]
    exact = exact_distinct(clean, list(dict.fromkeys(maybe_id + maybe_high)))
    found = []
    for c in df.columns:
        kind = dtype_name(df, c)
        if values.get((c, "bool")):
            found.append((c, "hidden_boolean", kind, 2, rows))
        if c in maybe_id and exact[c] == rows:
            found.append((c, "likely_id", kind, exact[c], rows))
        if c in maybe_high and rows and exact[c] / rows > CARDINALITY_SHARE and exact[c] > CARDINALITY_FLOOR:
            found.append((c, "high_cardinality", kind, exact[c], rows))
    return local_report(df, found, "column string, finding string, dtype string, n_unique bigint, n_rows bigint").withColumn(
        "unique_share", F.try_divide(F.col("n_unique"), F.col("n_rows"))
    )


def empty_columns(df: DataFrame) -> DataFrame:
    """Columns without a single value."""
    report = column_report(nan_to_null(df), df.columns, {"non_null": lambda c: F.count(col(c))}, "column string, non_null bigint")
    return report.filter(F.col("non_null") == 0).select("column")


def mixed_content(df: DataFrame) -> DataFrame:
    """Share of text values that read as a number, a boolean word or an ISO date; mixed when some but not all do."""
    def number(c):
        return F.count(parse_double(strip(col(c))))

    def boolean(c):
        return F.count_if(normalised(col(c)).isin(*TRUE_WORDS, *FALSE_WORDS) & parse_double(strip(col(c))).isNull())

    def date(c):
        return F.count(F.try_to_date(strip(col(c)), "yyyy-MM-dd"))

    report = column_report(
        df, text_columns(df),
        {"non_null": lambda c: F.count(col(c)), "numbers": number, "booleans": boolean, "dates": date},
        "column string, non_null bigint, numbers bigint, booleans bigint, dates bigint",
    )
    plain = F.col("non_null") - F.col("numbers") - F.col("booleans") - F.col("dates")
    kinds = sum((F.when(c > 0, 1).otherwise(0) for c in (F.col("numbers"), F.col("booleans"), F.col("dates"), plain)), F.lit(0))
    return report.withColumn("is_mixed", kinds > 1)

