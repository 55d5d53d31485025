"""Column classes that steer every operator, and safe column references."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEXT = (T.StringType, T.VarcharType, T.CharType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def col(name: str) -> Column:
    """Reference a column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _of(df: DataFrame, classes: tuple, only: Iterable[str] | None = None) -> list[str]:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, classes)]
    if only is None:
        return names
    wanted = list(only)
    require_columns(df, wanted)
    return [c for c in wanted if c in names]


def numeric_columns(df: DataFrame, only: Iterable[str] | None = None) -> list[str]:
    return _of(df, NUMERIC, only)


def text_columns(df: DataFrame, only: Iterable[str] | None = None) -> list[str]:
    return _of(df, TEXT, only)


def datetime_columns(df: DataFrame, only: Iterable[str] | None = None) -> list[str]:
    return _of(df, DATETIME, only)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, TEXT)


def is_datetime(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, DATETIME)


def dtype_name(df: DataFrame, name: str) -> str:
    """Reported type; the category tag of ``cast_columns`` shows as ``category``."""
    field = df.schema[name]
    return "category" if field.metadata.get("category") else field.dataType.simpleString()


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [c for c in names if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not in the table: {unknown}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Give missing one form: a float NaN becomes NULL, so aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats})


def as_double(name: str) -> Column:
    return col(name).cast("double")


def as_key(df: DataFrame, name: str) -> Column:
    """A value as a grouping key: 0.0 and -0.0 are one value."""
    kind = df.schema[name].dataType
    return (col(name) + F.lit(0.0)).cast(kind) if isinstance(kind, FRACTIONAL) else col(name)


def name_matches(name: str, keywords: Iterable[str], match: str = "substring") -> bool:
    """Keyword test on a column name. ``token`` avoids hits such as "age" inside "page"."""
    low = name.lower()
    if match == "token":
        tokens = "".join(ch if ch.isalnum() else " " for ch in low).split()
        return any(k in tokens or k == low for k in keywords)
    return any(k in low for k in keywords)
