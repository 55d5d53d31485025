"""Text expressions with Unicode semantics, all evaluated inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import MISSING_TOKENS, WHITESPACE

# A special character is anything but a letter, a digit, the underscore and white space.
SPECIAL = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def has_outer_space(c: Column) -> Column:
    return c != strip(c)


def has_special(c: Column) -> Column:
    return c.rlike(SPECIAL)


def normalised(c: Column) -> Column:
    """Form under which two spellings of one category are equal."""
    return F.lower(strip(c))


def titlecase(c: Column) -> Column:
    """Upper-case the first letter of every letter run; ``initcap`` looks at spaces only."""
    runs = F.regexp_extract_all(c, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    capital = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
    )
    return F.array_join(capital, "")


def drop_special(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), SPECIAL, ""))


TEXT_METHODS = {
    "trim": strip,
    "lowercase": lambda c: F.lower(strip(c)),
    "uppercase": lambda c: F.upper(strip(c)),
    "titlecase": lambda c: titlecase(strip(c)),
    "remove_special": drop_special,
    "all": lambda c: drop_special(F.lower(strip(c))),
}


def is_disguised(c: Column) -> Column:
    return normalised(c).isin(*MISSING_TOKENS)


def numeric_text(c: Column) -> Column:
    """The number a money or percent text stands for, or NULL."""
    bare = strip(F.regexp_replace(c, "[,$%]", ""))
    return parse_double(bare)


def parse_double(c: Column) -> Column:
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|(?i)^[+-]?(inf|infinity|nan)$"
    return F.when(c.rlike(number), c.try_cast("double"))


def parse_long(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))


def clean_name(name: str) -> str:
    """Identifier form of a column name: every run of other characters is one underscore."""
    return re.sub(r"[\W_]+", "_", name.strip()).strip("_").lower()


def name_issues(name: str) -> list[str]:
    """Problems in a column name, in the order they are reported."""
    found = []
    if re.search(r"\s", name):
        found.append("whitespace")
    if re.search(r"[^\w\s]", name):
        found.append("special_characters")
    if name != name.lower() and not name.isupper():
        found.append("mixed_case")
    return found
