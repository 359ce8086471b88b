"""String functions; arguments of other types are cast to string first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_column


def _text(x) -> Column:
    return as_column(x).cast("string")


def trim(s) -> Column:
    return F.trim(_text(s))


def concat(*cols) -> Column:
    """Joined text, null if any part is null."""
    return F.concat(*[_text(c) for c in cols])


def find(s, part: str) -> Column:
    """1-based position of ``part``, 0 when absent."""
    return F.instr(_text(s), part)


def replace(s, pattern: str, replacement: str) -> Column:
    """Replace every match of a regular expression."""
    return F.regexp_replace(_text(s), pattern, replacement)


def left(s, n: int) -> Column:
    return F.left(_text(s), F.lit(n))


def right(s, n: int) -> Column:
    return F.right(_text(s), F.lit(n))


def length(s) -> Column:
    return F.length(_text(s))


def lower(s) -> Column:
    return F.lower(_text(s))


def upper(s) -> Column:
    return F.upper(_text(s))


def substring(s, position: int, n: int) -> Column:
    return F.substring(_text(s), position, n)
