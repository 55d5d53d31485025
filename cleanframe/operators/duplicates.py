"""Duplicate rows: counts, samples and removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import as_double, col, name_matches, nan_to_null, require_columns
from ..functions.vocab import IDENTITY_KEYWORDS
from ..plans.fused import agg_values, empty, value_counts
from ..plans.result import FixResult

BROADCAST_KEYS = 1_000_000  # 8 bytes each
METHODS = ("keep_first", "keep_last", "drop_all", "do_nothing")


def _fingerprint(df: DataFrame) -> Column:
    """64-bit hash of a row; equal rows always agree, and rows that agree by chance are compared exactly later."""
    return F.xxhash64(*[col(c) for c in df.columns])


def _repeated(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """The table with the hash of its keys, the hashes that occur more than once, and their number."""
    keyed = _groupable(df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keys)]))
    hashed = keyed.select(_fingerprint(keyed).alias("__fp"))
    repeated = hashed.groupBy("__fp").agg(F.count("*").alias("n")).filter("n > 1").select("__fp")
    exprs = {f.name: (F.sort_array(F.map_entries(col(f.name))) if isinstance(f.dataType, T.MapType) else (col(f.name) + F.lit(0.0)).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else col(f.name))
             for f in df.schema.fields if f.name in keys}
    return df.withColumn("__fp", F.xxhash64(*[exprs[c] for c in keys])), repeated, agg_values(repeated, {"n": F.count("*")})["n"]


def _copies(df: DataFrame) -> DataFrame | None:
    """Distinct rows that may be repeated, with their number of copies; None when no row is repeated.

    First only 8-byte hashes are shuffled. If few of them repeat, their counted list is broadcast and only the rows it
    names move; otherwise whole rows are grouped, and copies combine in the map tasks before they move.
    """
    marked = df.withColumn("__fp", _fingerprint(df))
    repeated = marked.groupBy("__fp").agg(F.count("*").alias("n")).filter("n > 1").select("__fp")
    found = agg_values(repeated, {"n": F.count("*")})["n"]
    if found == 0:
        return None
    if found <= BROADCAST_KEYS:
        df = marked.join(F.broadcast(repeated), "__fp", "left_semi").drop("__fp")
    return df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("__copies"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, redundant copies (all but the first of each group) and their percent."""
    clean = _groupable(nan_to_null(df))
    groups = _copies(clean)
    total = clean.agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("rows"))
    if groups is not None:
        redundant = groups.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("n"), F.lit(0).cast("bigint").alias("rows"))
        total = total.union(redundant)
    return (
        total.agg(F.sum("rows").alias("n_rows"), F.sum("n").alias("duplicate_count"))
        .withColumn("duplicate_pct", F.try_divide(100.0 * F.col("duplicate_count"), F.col("n_rows")))
    )


def duplicate_samples(df: DataFrame, order_by: Sequence[str], k: int = 5) -> DataFrame:
    """First ``k`` duplicated rows with their number of redundant copies."""
    clean = _groupable(nan_to_null(df))
    groups = _copies(clean)
    if groups is None:
        return clean.withColumn("redundant_copies", F.lit(0).cast("bigint")).limit(0)
    counted = groups.withColumn("redundant_copies", F.col("__copies") - 1).drop("__copies")
    return counted.filter("redundant_copies > 0").orderBy(*[col(c) for c in order_by]).limit(k)


def _groupable(df: DataFrame) -> DataFrame:
    """Maps cannot be grouped or hashed; their sorted entries can. -0.0 and 0.0 become one value."""
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            exprs[f.name] = F.sort_array(F.map_entries(col(f.name)))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs[f.name] = (col(f.name) + F.lit(0.0)).cast(f.dataType)
    return df.withColumns(exprs) if exprs else df


def identity_duplicates(df: DataFrame, match: str = "substring") -> DataFrame:
    """Repeated values in columns whose name says they identify something; only columns with repeats."""
    flat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    names = [c for c in flat if name_matches(c, IDENTITY_KEYWORDS, match)]
    if not names:
        return empty(df, "column string, dup_count bigint")
    counts = value_counts(nan_to_null(df), names, digest=True)
    return counts.groupBy("column").agg(F.sum(F.col("n") - 1).alias("dup_count")).filter("dup_count > 0")


def drop_duplicate_rows(
    df: DataFrame, method: str = "keep_first", subset: Sequence[str] | None = None, order_by: Sequence[str] | None = None
) -> FixResult:
    """Remove duplicates over all columns, or over ``subset``.

    Keeping the first or last row of a subset needs ``order_by``; the remaining columns break ties. Every form limits
    or combines a group inside each map task before the shuffle, so a hot key does not gather its rows in one task.
    """
    if method not in METHODS:
        return FixResult(df, errors=[f"unknown method '{method}'; valid: {', '.join(METHODS)}"])
    require_columns(df, [*(subset or ()), *(order_by or ())])
    if method == "do_nothing":
        return FixResult(df, [{"method": method}])
    clean = nan_to_null(df)
    keys = list(subset) if subset else list(df.columns)
    whole_row = set(keys) == set(df.columns)
    done = [{"method": method, "subset": list(subset) if subset else None}]
    maps = [f.name for f in clean.schema.fields if isinstance(f.dataType, T.MapType)]
    if whole_row and maps:
        # Maps cannot be grouped: their sorted entries stand for them, and one row of each group is returned.
        plain = _groupable(clean.select(F.struct("*").alias("__row"), *[col(c).alias(f"__k{i}") for i, c in enumerate(clean.columns)]))
        groups = plain.groupBy(*[f"__k{i}" for i in range(len(clean.columns))]).agg(F.count("*").alias("__copies"), F.first("__row").alias("__row"))
        return FixResult((groups.filter("__copies = 1") if method == "drop_all" else groups).select("__row.*"), done)
    if whole_row:
        if method != "drop_all":
            return FixResult(clean.dropDuplicates(), done)
        counted = clean.groupBy(*[col(c) for c in keys]).agg(F.count("*").alias("__copies"))
        return FixResult(counted.filter("__copies = 1").select(*[col(c) for c in df.columns]), done)
    if method == "drop_all":
        # Rows whose key hash occurs once stay where they are; only the others are grouped, exactly.
        marked, repeated, found = _repeated(clean, keys)
        if found == 0:
            return FixResult(clean, done)
        alone = None
        if found <= BROADCAST_KEYS:
            alone = marked.join(F.broadcast(repeated), "__fp", "left_anti").drop("__fp")
            clean = marked.join(F.broadcast(repeated), "__fp", "left_semi").drop("__fp")
        rest = [c for c in df.columns if c not in keys]
        single = clean.groupBy(*[col(c) for c in keys]).agg(
            F.count("*").alias("__copies"), F.first(F.struct(*[col(c) for c in rest])).alias("__row")
        )
        picked = {c: F.col("__row").getField(c) for c in rest}
        out = single.filter("__copies = 1").select(*[picked[c].alias(c) if c in picked else col(c) for c in df.columns])
        return FixResult(out if alone is None else alone.unionByName(out), done)
    if not order_by:
        return FixResult(df, errors=[f"{method} over a subset needs order_by: rows of a distributed table have no order"])
    ties = [c for c in df.columns if c not in keys and c not in order_by and not isinstance(df.schema[c].dataType, T.MapType)]
    order = [col(c) for c in [*order_by, *ties]]
    window = Window.partitionBy(*[col(c) for c in keys]).orderBy(*[c.desc() if method == "keep_last" else c.asc() for c in order])
    out = clean.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")
    return FixResult(out, done)


def deduplication_impact(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """One row: count, mean and sum of a numeric column before and after deduplication."""

    def measured(df: DataFrame, label: str) -> DataFrame:
        x = as_double(column)
        return nan_to_null(df).select(F.lit(label).alias("side"), x.alias("x"))

    both = measured(before, "before").union(measured(after, "after"))
    side = F.col("side")
    exprs = []
    for label in ("before", "after"):
        x = F.when(side == label, F.col("x"))
        exprs += [F.count(x).alias(f"count_{label}"), F.avg(x).alias(f"mean_{label}"), F.sum(x).alias(f"sum_{label}")]
    return both.agg(*exprs).withColumns(
        {
            "mean_change": F.col("mean_after") - F.col("mean_before"),
            "sum_change": F.col("sum_after") - F.col("sum_before"),
        }
    )
