"""Loading one table: CSV, TSV, JSON, Parquet and ORC, by extension, MIME type or name."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_double, parse_long, strip
from ..functions.types import col, nan_to_null
from ..functions.vocab import CSV_NA_TOKENS
from ..plans.fused import agg_values
from .quoted import breaks_quotes, quoted_records

OVERFLOW = "__overflow"

EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}
MIME_TYPES = {
    "text/csv": "csv",
    "text/tab-separated-values": "tsv",
    "application/json": "json",
    "application/vnd.apache.parquet": "parquet",
    "application/vnd.apache.orc": "orc",
}


def format_of(path: str, fmt: str | None = None, mime: str | None = None) -> str:
    """Format by explicit name, else by lower-cased extension, else by MIME type."""
    if fmt:
        if fmt.lower() in EXTENSIONS.values():
            return fmt.lower()
        raise ValueError(f"unsupported format: {fmt}")
    extension = posixpath.splitext(path.rstrip("/").lower())[1]
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    if mime in MIME_TYPES:
        return MIME_TYPES[mime]
    raise ValueError(f"unsupported file type: {mime or path}")


def load(spark: SparkSession, path: str, fmt: str | None = None, mime: str | None = None, **options) -> DataFrame:
    """Read a file, a directory or a glob as one table, with NaN as missing."""
    reader = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet, "orc": read_orc}
    return reader[format_of(path, fmt, mime)](spark, path, **options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.orc(path))


def read_csv(spark: SparkSession, path: str, infer: bool = True, multiline: bool | None = None) -> DataFrame:
    """Comma-separated with a header. Rows with too many fields are skipped, short rows padded with missing.

    Line breaks inside quotes are found by a pass over the lines; such files are then read in splits that start at true
    records. ``multiline`` skips that pass: False where no quotes hold line breaks, True for Spark's reader of unsplit files.
    """
    raw = _delimited(spark, path, ",", multiline)
    return _typed(raw.filter(F.col(OVERFLOW).isNull()).drop(OVERFLOW), infer)


def read_tsv(spark: SparkSession, path: str, infer: bool = True, multiline: bool | None = None) -> DataFrame:
    """Tab-separated with a header. A row with too many fields fails the read."""
    raw = _delimited(spark, path, "\t", multiline)
    width = len(raw.columns) - 1
    too_long = F.raise_error(F.lit(f"a row has more than {width} fields")).cast("boolean")
    checked = raw.filter(F.when(F.col(OVERFLOW).isNull(), F.lit(True)).otherwise(too_long))
    return _typed(checked.drop(OVERFLOW), infer)


def _delimited(spark: SparkSession, path: str, sep: str, multiline: bool | None) -> DataFrame:
    """Every column as text, plus an overflow column that only a row with too many fields fills."""
    split = multiline is None and breaks_quotes(spark, path, sep)
    how = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    reader = spark.read.options(**how, header=True, multiLine=split or bool(multiline))
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]])
    if split:
        fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names)
        raw = quoted_records(spark, path, sep).select(F.from_csv("value", fields, how).alias("r")).select("r.*")
    else:
        raw = reader.schema(schema).csv(path)
    return raw.withColumns({n: F.when(~col(n).isin(*CSV_NA_TOKENS), col(n)) for n in names})


def _typed(raw: DataFrame, infer: bool) -> DataFrame:
    """Give a column the narrowest of bigint, double and boolean that all its values fit; one pass over the data."""
    if not infer or not raw.columns:
        return raw
    tests = {
        "n": lambda c: c,
        "bigint": lambda c: parse_long(strip(c)),
        "double": lambda c: parse_double(strip(c)),
        "boolean": lambda c: F.when(F.lower(c).isin("true", "false"), F.lower(c) == "true"),
    }
    counts = agg_values(raw, {(n, k): F.count(test(col(n))) for n in raw.columns for k, test in tests.items()})
    exprs = []
    for n in raw.columns:
        total = counts[(n, "n")]
        kind = next((k for k in ("bigint", "double", "boolean") if total and counts[(n, k)] == total), None)
        exprs.append((tests[kind](col(n)) if kind else col(n)).alias(n))
    return nan_to_null(raw.select(*exprs))


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON lines, or an array of objects.

    Prefer JSON lines for large data: they split across tasks, while an array is one record of one task. One object that
    spans lines, such as an object of columns, is refused: it is a single record whatever its size.
    """
    if lines is None:
        head = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("v")).limit(1).collect()
        first = head[0]["v"] if head else ""
        lines = first.startswith("{") and first.endswith("}")
        if first.startswith("{") and not lines:
            raise ValueError("a JSON object that spans lines is one record; write JSON lines, an object for each row")
    return nan_to_null(spark.read.option("multiLine", not lines).json(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write the cleaned table as Parquet, ORC, JSON lines, CSV or TSV."""
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        sep = "," if fmt == "csv" else "\t"
        writer.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    elif fmt in ("parquet", "orc", "json"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
