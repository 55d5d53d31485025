"""Whole-table aggregates fused over columns.

A scan states, per column, the aggregates it wants; these helpers put many of them into one pass. Passes are cut
into chunks so generated code stays small, and each chunk reads only its own columns, so a columnar source is still
read once in total. Only one row per chunk, or rows bounded by the number of columns, ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import as_key, col

AGG_CHUNK = 100


def chunks(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def local_report(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Report over fitted values; the row count is bounded by the number of columns."""
    return df.sparkSession.createDataFrame(rows, schema) if rows else empty(df, schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    fields = T._parse_datatype_string(schema).fields
    return df.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def agg_values(df: DataFrame, exprs: dict, chunk: int = AGG_CHUNK) -> dict:
    """Evaluate named aggregates eagerly, ``chunk`` of them per pass."""
    values: dict = {}
    for group in chunks(list(exprs.items()), chunk):
        row = df.agg(*[e.alias(f"v{i}") for i, (_, e) in enumerate(group)]).first()
        values.update({name: row[i] for i, (name, _) in enumerate(group)})
    return values


def column_report(
    df: DataFrame,
    keys: Sequence,
    fields: dict[str, Callable[..., Column]],
    schema: str,
    facts: Callable[..., dict[str, object]] | None = None,
    weight: int | None = None,
) -> DataFrame:
    """Lazy long report: one row per key (a column name or a rule).

    ``fields`` are aggregates; ``facts`` are values known without looking at data (the column name by default, or in
    addition). ``weight`` is the number of aggregation buffers a key takes, when that is more than its fields.
    """
    if not keys:
        return empty(df, schema)
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}

    def known(key) -> dict[str, object]:
        return {**({"column": key} if isinstance(key, str) else {}), **(facts(key) if facts else {})}

    parts = []
    for group in chunks(keys, max(1, AGG_CHUNK // (weight or len(fields)))):
        wide = df.agg(*[fn(key).alias(f"{i}_{f}") for i, key in enumerate(group) for f, fn in fields.items()])
        rows = [
            F.struct(
                *[F.lit(v).cast(kinds[n]).alias(n) for n, v in known(key).items()],
                *[F.col(f"{i}_{f}").cast(kinds[f]).alias(f) for f in fields],
            )
            for i, key in enumerate(group)
        ]
        parts.append(conform(wide.select(F.inline(F.array(*rows))), schema))
    return union_all(parts)


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: (keep..., column, value as text)."""
    cells = df.select(*[col(k) for k in keep], *[as_key(df, c).cast("string").alias(f"__cell_{i}") for i, c in enumerate(columns)])
    stacked = cells.unpivot(list(keep), [f"__cell_{i}" for i in range(len(columns))], "__slot", "value")
    names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"__cell_{i}"), F.lit(c))])
    return stacked.select(*[col(k) for k in keep], names[F.col("__slot")].alias("column"), "value")


def value_counts(df: DataFrame, columns: Sequence[str], digest: bool = False) -> DataFrame:
    """(column, value as text, n), missing included.

    Columns of one type are counted together in their own type, so rows are expanded and shuffled without turning
    values into text; only distinct values are. Repeats combine before the shuffle, so a hot value costs one row a task.
    With ``digest`` a text beyond 64 characters is known by its SHA-256, for counts that do not show values: whole
    texts are still told apart, but do not move.
    """
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    parts = []
    for names in by_type.values():
        slots = [str(i) for i in range(len(names))]
        cells = df.select(*[_cell(df, c, digest).alias(s) for s, c in zip(slots, names)])
        cells = cells.unpivot([], slots, "slot", "value").withColumn("slot", F.col("slot").cast("int"))
        counted = cells.groupBy("slot", "value").agg(F.count("*").alias("n"))
        label = F.array(*[F.lit(c) for c in names])[F.col("slot")]
        parts.append(counted.select(label.alias("column"), F.col("value").cast("string").alias("value"), "n"))
    return union_all(parts)


def _cell(df: DataFrame, name: str, digest: bool) -> Column:
    key = as_key(df, name)
    if not digest or not isinstance(df.schema[name].dataType, T.StringType):
        return key
    # The marker makes a digest longer than any text that is kept as it is.
    return F.when(F.length(key) > 64, F.concat(F.lit("sha256:"), F.sha2(key, 256))).otherwise(key)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark limits each group inside every map task before it shuffles."""
    window = Window.partitionBy(*[col(g) for g in group]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def approx_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Cheap distinct counts (about 5 % off) used to decide where an exact count is worth a shuffle."""
    return agg_values(df, {c: F.approx_count_distinct(col(c)) for c in columns})


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct non-missing values per column, by grouping and not by COUNT(DISTINCT) over many columns."""
    if not columns:
        return {}
    counts = value_counts(df, columns, digest=True).filter(F.col("value").isNotNull())
    found = {r["column"]: r["n_distinct"] for r in counts.groupBy("column").agg(F.count("*").alias("n_distinct")).collect()}
    return {c: found.get(c, 0) for c in columns}
