"""Small column helpers shared by every module."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text strip removes, and the line breaks a text is split on.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
LINE_BREAK = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once and hand it to ``body`` as a lambda variable.

    Without it Catalyst may inline an expensive expression into every place that reads it.
    """
    return F.transform(F.array(value), body)[0]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, or null when the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def lookup(c: Column, pairs: dict) -> Column:
    """Fixed small mapping as a CASE expression; null when the key is unknown."""
    out = None
    for key, value in pairs.items():
        out = (F.when if out is None else out.when)(c == F.lit(key), F.lit(value))
    return out


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open one more line."""
    parts = F.split(text, LINE_BREAK)
    return let(parts, lambda a: F.when(a[F.size(a) - 1] == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def sentences(*parts: Column, sep: str = "; ") -> Column:
    """Join the parts that are not null."""
    return F.array_join(F.array_compact(F.array(*parts)), sep)
