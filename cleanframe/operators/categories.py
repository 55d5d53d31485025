"""Different spellings of one category, and their harmonisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised
from ..functions.types import col, require_columns, text_columns
from ..functions.vocab import CATEGORY_LIMIT
from ..plans.fused import approx_distinct, empty, exact_distinct, value_counts
from ..plans.result import FixResult

LITERAL_MAP_LIMIT = 50  # a literal map is searched pair by pair
BROADCAST_PAIRS = 1_000_000

_GROUPS = "column string, norm string, value string, n bigint, canonical string, group_rows bigint, affected bigint"


def category_columns(df: DataFrame, columns: Sequence[str] | None = None, limit: int = CATEGORY_LIMIT) -> list[str]:
    """Text columns with at most ``limit`` distinct values: a sketch first, an exact count only when it is close."""
    names = text_columns(df, columns)
    if not names:
        return []
    rough = approx_distinct(df, names)
    near = [c for c in names if rough[c] <= 2 * limit]
    exact = exact_distinct(df, near)
    return [c for c in near if exact[c] <= limit]


def variant_groups(df: DataFrame, columns: Sequence[str] | None = None, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """One row per spelling of every value that is spelled more than one way.

    ``canonical`` is the most frequent spelling, the smallest on a tie; ``affected`` counts the rows of the group that
    are spelled otherwise. The result has at most ``limit`` rows per column.
    """
    names = category_columns(df, columns, limit)
    if not names:
        return empty(df, _GROUPS)
    counts = value_counts(df, names).filter(F.col("value").isNotNull()).withColumn("norm", normalised(F.col("value")))
    groups = (
        counts.groupBy("column", "norm")
        .agg(
            F.collect_list(F.struct("value", "n")).alias("spellings"),
            F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value").alias("value"))).alias("best"),
            F.sum("n").alias("group_rows"),
        )
        .filter(F.size("spellings") > 1)
    )
    return groups.select(
        "column", "norm", F.inline("spellings"), F.col("best.value").alias("canonical"), "group_rows",
        (F.col("group_rows") + F.col("best.minus_n")).alias("affected"),
    )


def harmonise_mapping(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Dry run: the (column, variant, canonical) replacements that ``harmonise`` would make."""
    groups = variant_groups(df, columns)
    return groups.filter(F.col("value") != F.col("canonical")).select("column", F.col("value").alias("variant"), "canonical")


def apply_mapping(df: DataFrame, column: str, mapping: dict[str, str] | DataFrame) -> DataFrame:
    """Replace variants by their canonical form; other values and missing stay.

    A small dict becomes a literal map and the fix stays row-local. A DataFrame (variant, canonical), or a larger dict, is
    joined instead: broadcast up to a counted number of pairs, else by a shuffle that missing values take no part in.
    A variant that is listed twice takes its smallest form.
    """
    require_columns(df, [column])
    if isinstance(mapping, dict) and len(mapping) <= LITERAL_MAP_LIMIT:
        return df.withColumn(column, _lookup(col(column), mapping)) if mapping else df
    if isinstance(mapping, dict):
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), "variant string, canonical string")
    pairs = mapping.filter("variant is not null").groupBy(F.col("variant").alias("__variant")).agg(F.min("canonical").alias("__canonical"))
    few = pairs.count() <= BROADCAST_PAIRS
    there = df if few else df.filter(col(column).isNotNull())
    joined = there.join(F.broadcast(pairs) if few else pairs, col(column) == F.col("__variant"), "left")
    mapped = joined.withColumn(column, F.coalesce("__canonical", col(column))).drop("__variant", "__canonical")
    return mapped if few else mapped.unionByName(df.filter(col(column).isNull()))


def _lookup(c: Column, mapping: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def harmonise(df: DataFrame, columns: Sequence[str] | None = None) -> FixResult:
    """Replace every variant by its canonical spelling, in all or the named text columns."""
    per_column: dict[str, dict[str, str]] = {}
    for row in harmonise_mapping(df, columns).collect():  # at most CATEGORY_LIMIT rows a column
        per_column.setdefault(row["column"], {})[row["variant"]] = row["canonical"]
    out = df.withColumns({c: _lookup(col(c), m) for c, m in per_column.items()}) if per_column else df
    return FixResult(out, [{"column": c, "variants": len(m), "forms": len(set(m.values()))} for c, m in per_column.items()])


def mapping_effect(df: DataFrame, column: str, mapping: dict[str, str]) -> dict[str, int]:
    """Distinct values of a column before and after a mapping."""
    both = df.select(col(column).alias("before"), _lookup(col(column), mapping).alias("after"))
    counts = exact_distinct(both, ["before", "after"])
    return {"before": counts["before"], "after": counts["after"], "reduced_by": counts["before"] - counts["after"]}

