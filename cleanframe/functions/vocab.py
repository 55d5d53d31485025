"""Word lists, patterns, formats and thresholds that decide results."""

from __future__ import annotations

# --- fixed values: text that stands for a missing cell (compared after strip + lower) ---
MISSING_TOKENS = (
    "n/a", "na", "n.a.", "n.a", "none", "null", "missing", "unknown",
    "-", "--", "---", "?", "??", "", "not available", "not applicable",
)

# --- fixed values: cells a CSV/TSV reader turns into missing ---
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- fixed values: column-name keywords ---
ID_KEYWORDS = ("id", "key", "code", "uuid", "ref", "reference", "number")
IDENTITY_KEYWORDS = ("id", "email", "phone", "name", "code", "number")
YEAR_KEYWORDS = ("year", "yr", "born", "dob", "date_of_birth")
YEAR_RANGE_KEYWORDS = ("year", "yr", "born", "dob")
AGE_KEYWORDS = ("age",)
PERCENT_KEYWORDS = ("pct", "percent", "rate", "ratio", "score")
MONEY_KEYWORDS = (
    "price", "cost", "salary", "amount", "revenue", "income", "wage", "fee", "pay", "earning",
)
COUNT_KEYWORDS = ("count", "qty", "quantity", "num", "number", "total")

# --- fixed values: words accepted by the boolean cast (compared after strip + lower) ---
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")

# --- fixed values: named text formats; earlier wins a tie in detection ---
PATTERNS = {
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "phone_us": r"^(\+1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}$",
    "postal_code_us": r"^\d{5}(-\d{4})?$",
    "postal_code_uk": r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$",
    "url": r"(?i)^https?://[^\s/$.?#].[^\s]*$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "integer_string": r"^-?\d+$",
    "decimal_string": r"^-?\d+(\.\d+)?$",
}

# --- fixed values: thresholds ---
Z_LIMIT = 3.0
IQR_FACTOR = 1.5
MIN_VALUES_OUTLIER = 4
MIN_VALUES_SKEW = 3
MIN_VALUES_SCALE = 2
CARDINALITY_SHARE = 0.5
CARDINALITY_FLOOR = 10
CATEGORY_LIMIT = 50
SEVERITY_LOW = 5.0
SEVERITY_MEDIUM = 20.0
CORRELATED_MISSING_PCT = 50.0
PATTERN_RATE = 0.8
DATE_RATE = 0.7
CONFIDENCE = 0.975
CORRELATION_LIMIT = 0.95
MIN_YEAR = 1900
AGE_TOLERANCE = 2
HISTORY_DEPTH = 20

# Whitespace that Python's str.strip() removes; Spark's trim removes only the space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Date formats tried when none is given, as Spark datetime patterns. Earlier wins a tie.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "MM-dd-yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "d MMM yyyy",
    "MMM d, yyyy",
    "yyyyMMdd",
)
# Further formats, tried after those: minutes only, fractions, offsets, month names.
MORE_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "MMMM d, yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
)

# strftime directive -> Spark datetime pattern
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
    "%j": "DDD", "%z": "xx", "%%": "%",
}
