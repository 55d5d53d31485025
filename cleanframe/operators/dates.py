"""Dates held as text: detection, parsing and its report."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import col, is_datetime, is_text, nan_to_null, text_columns
from ..functions.vocab import DATE_FORMATS, DATE_RATE, MORE_DATE_FORMATS, STRFTIME
from ..plans.fused import agg_values, column_report, empty, local_report, value_counts
from ..plans.result import FixResult
from .columns import sample_values


def spark_format(template: str) -> str:
    """Translate a strftime template ("%d/%m/%Y") to a Spark datetime pattern; literal letters are quoted."""
    out, literal, i = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'" if any(ch.isalpha() or ch == "'" for ch in literal) else literal)
            literal = ""

    while i < len(template):
        directive = template[i : i + 2]
        if template[i] != "%":
            literal += template[i]
            i += 1
            continue
        if directive not in STRFTIME:
            raise ValueError(f"unsupported directive '{directive}' in '{template}'")
        flush()
        out.append(STRFTIME[directive])
        i += 2
    flush()
    return "".join(out)


KNOWN_FORMATS = DATE_FORMATS + MORE_DATE_FORMATS

# What a pattern letter can match at most; a failed parse costs an exception, a failed regex next to nothing.
_SHAPES = {
    "MM": "(0[1-9]|1[0-2])", "dd": "(0[1-9]|[12][0-9]|3[01])", "HH": "([01][0-9]|2[0-3])", "hh": "(0[1-9]|1[0-2])",
    "mm": "[0-5][0-9]", "ss": "[0-5][0-9]", "d": "[0-9]{1,2}", "yy": "[0-9]{2}", "yyyy": r"[+-]?[0-9]{4,}",
    "SSSSSS": "[0-9]{1,6}", "XXX": "(Z|[+-][0-9]{2}:[0-9]{2})", "MMM": "[A-Za-z]{3}", "MMMM": "[A-Za-z]{3,9}",
}


def shape(fmt: str) -> str:
    """Regex that every text fitting the pattern matches."""
    out = []
    for piece in re.finditer(r"'(?P<quoted>[^']*)'|(?P<letters>([A-Za-z])\3*)|(?P<other>.)", fmt, re.S):
        if piece["letters"]:
            out.append(_SHAPES.get(piece["letters"], ".+"))
        else:
            out.append(re.escape(piece["quoted"] or piece["other"] or "'"))
    return "^" + "".join(out) + "$"


# The same in classes of characters: 9 for a digit, a for a run of letters.
_CLASSES = {
    "MM": "99", "dd": "99", "HH": "99", "hh": "99", "mm": "99", "ss": "99", "d": "9{1,2}", "yy": "99", "yyyy": r"[+-]?9{4,5}",
    "SSSSSS": "9{1,6}", "XXX": "(a|[+-]99:99)", "MMM": "a", "MMMM": "a",
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TO_CLASS = str.maketrans("0123456789" + _LETTERS, "9" * 10 + "a" * len(_LETTERS))
SHAPE_LETTERS = 64  # no known format writes more


def class_shape(fmt: str) -> str | None:
    """Regex over the character classes of a text that fits the pattern; None for a pattern that ``shape`` knows only roughly."""
    out = []
    for piece in re.finditer(r"'(?P<quoted>[^']*)'|(?P<letters>([A-Za-z])\3*)|(?P<other>.)", fmt, re.S):
        if piece["letters"] and piece["letters"] not in _CLASSES:
            return None
        out.append(_CLASSES[piece["letters"]] if piece["letters"] else re.escape(re.sub("a+", "a", (piece["quoted"] or piece["other"] or "'").translate(_TO_CLASS))))
    joined = re.sub("a+", "a", "".join(out))
    return None if "a(" in joined else joined


def _value_shape(c: Column) -> Column:
    """Character classes of a text that may be a date, else an empty text: few distinct values, whatever the texts are."""
    classes = F.regexp_replace(F.translate(c, "0123456789" + _LETTERS, "9" * 10 + "a" * len(_LETTERS)), "a+", "a")
    short = F.when(F.length(c) <= SHAPE_LETTERS, classes)
    return F.when(c.isNotNull(), F.when(short.contains("9") & short.rlike(r"^[9a +\-/.:,]*$"), short).otherwise(""))


def _fitting(df: DataFrame, columns: Sequence[str], formats: Sequence[str]) -> tuple[dict[str, int], dict[str, list[str]]]:
    """Values of each column, and the formats that the shape of any of them allows; one text pass, few rows to the driver."""
    known = {f: class_shape(f) for f in formats}
    shapes = value_counts(df.select(*[_value_shape(col(c)).alias(c) for c in columns]), columns).filter("value is not null").collect()
    count, allowed = dict.fromkeys(columns, 0), {c: set() for c in columns}
    for r in shapes:
        count[r["column"]] += r["n"]
        if r["value"]:
            allowed[r["column"]] |= {f for f, known_shape in known.items() if re.fullmatch(known_shape, r["value"])}
    return count, {c: [f for f in formats if f in allowed[c]] for c in columns}


def parse_date(c: Column, fmt: str) -> Column:
    """Zone-free timestamp of a text under a Spark pattern, NULL where it does not fit.

    The session's time zone plays no part: a time without an offset is that time on the wall, one with an offset is the
    time in UTC.
    """
    letters = re.sub("'[^']*'", "", fmt)
    if any(ch in letters for ch in "HhSsa"):
        # Read as UTC and counted from the epoch, so that no zone skips or repeats an hour.
        instant = F.try_to_timestamp(c, F.lit(fmt)) if any(ch in letters for ch in "Xx") else F.try_to_timestamp(F.concat(c, F.lit("Z")), F.lit(fmt + "XXX"))
        seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        parsed = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    else:
        parsed = F.try_to_date(c, fmt).cast("timestamp_ntz")
    # the microseconds of a year beyond five digits, which needs a sign, do not fit a timestamp
    return F.when(c.rlike(shape(fmt)) & ~c.rlike("[+-][0-9]{6,}"), parsed)


def _rates(df: DataFrame, columns: Sequence[str], formats: Sequence[str]) -> dict:
    """Values of each column, and how many parse under each format. Only formats that some value's shape allows are tried."""
    if all(class_shape(f) and not set(re.sub("a+|9", "", f.translate(_TO_CLASS))) - set(" +-/.:,'") for f in formats):
        count, fitting = _fitting(df, columns, formats)
    else:
        count, fitting = agg_values(df, {c: F.count(col(c)) for c in columns}), dict.fromkeys(columns, formats)
    rates = agg_values(df, {(c, f): F.count(parse_date(col(c), f)) for c in columns for f in fitting[c]})
    return dict.fromkeys(((c, f) for c in columns for f in formats), 0) | rates | {(c, "n"): count[c] for c in columns}


def best_formats(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = KNOWN_FORMATS) -> dict[str, str | None]:
    """Format under which most values of each column parse; the earlier format wins a tie, None if nothing parses."""
    counts = _rates(df, columns, formats)
    best = {c: max(formats, key=lambda f: counts[(c, f)]) for c in columns}
    return {c: f if counts[(c, f)] else None for c, f in best.items()}


def detect_dates(
    df: DataFrame, formats: Sequence[str] = KNOWN_FORMATS, sample: int | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Text columns of which at least 70 % of the values parse under one format.

    All values are tested; ``sample`` tests the first values of each column under ``order_by`` instead.
    """
    names = text_columns(df)
    schema = "column string, format string, n_values bigint, n_parsed bigint, parse_rate double"
    if not names:
        return empty(df, schema)
    if sample is None:
        counts = _rates(df, names, formats)
    else:
        picked = sample_values(df, names, order_by, sample)
        per_format = [F.count(parse_date(F.col("value"), f)).alias(f"f{i}") for i, f in enumerate(formats)]
        counts = {}
        for row in picked.groupBy("column").agg(F.count("*").alias("n"), *per_format).collect():  # one row a column
            counts[(row["column"], "n")] = row["n"]
            counts.update({(row["column"], f): row[f"f{i}"] for i, f in enumerate(formats)})
        names = [c for c in names if (c, "n") in counts]
    rows = []
    for c in names:
        n, fmt = counts[(c, "n")], max(formats, key=lambda f, c=c: counts[(c, f)])
        if n and counts[(c, fmt)] / n >= DATE_RATE:
            rows.append((c, fmt, n, counts[(c, fmt)], 100.0 * counts[(c, fmt)] / n))
    return local_report(df, rows, schema)


@dataclass(frozen=True)
class DateFit:
    formats: tuple[tuple[str, str], ...] = ()
    applied: tuple = ()
    errors: tuple = ()

    row_local = True

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: parse_date(col(c), f) for c, f in self.formats}) if self.formats else df


def fit_dates(df: DataFrame, columns: Sequence[str], date_format: str | None = None) -> DateFit:
    """Choose a format per column: the strftime template given, else the one most values parse under."""
    errors, applied, wanted = [], [], []
    for c in columns:
        if c not in df.columns:
            errors.append(f"'{c}' not in the table")
        elif is_datetime(df, c):
            applied.append({"column": c, "note": "already a date"})
        elif not is_text(df, c):
            errors.append(f"'{c}' is not a text column")
        else:
            wanted.append(c)
    if date_format:
        formats = dict.fromkeys(wanted, spark_format(date_format))
    else:
        formats = best_formats(df, wanted) if wanted else {}
        errors += [f"'{c}': no known date format fits" for c in wanted if not formats[c]]
    chosen = tuple((c, formats[c]) for c in wanted if formats[c])
    return DateFit(chosen, (*applied, *({"column": c, "format": f} for c, f in chosen)), tuple(errors))


def parse_dates(df: DataFrame, columns: Sequence[str], date_format: str | None = None) -> FixResult:
    """Turn text columns into timestamps; what does not parse becomes missing."""
    fit = fit_dates(df, columns, date_format)
    return FixResult(fit.apply(df), list(fit.applied), list(fit.errors))


def parse_report(df: DataFrame, fit: DateFit) -> DataFrame:
    """Values per column, how many parse and how many newly fail."""
    formats = dict(fit.formats)
    report = column_report(
        nan_to_null(df), list(formats),
        {
            "total": lambda c: F.count(col(c)),
            "parsed": lambda c: F.count(parse_date(col(c), formats[c])),
        },
        "column string, format string, total bigint, parsed bigint", facts=lambda c: {"format": formats[c]},
    )
    return report.withColumns(
        {"failed": F.col("total") - F.col("parsed"), "parsed_pct": F.try_divide(100.0 * F.col("parsed"), F.col("total"))}
    )
