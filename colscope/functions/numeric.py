"""Arithmetic functions.  ``+``, ``-``, ``*`` and the comparisons are Spark's own Column operators.

Division and remainder by zero give null rather than an ANSI error.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x) -> Column:
    """Columns pass through, strings name a column, anything else is a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def divide(a, b) -> Column:
    return F.try_divide(as_column(a), as_column(b))


def remainder(a, b) -> Column:
    """Remainder with the sign of ``a``."""
    return F.try_mod(as_column(a), as_column(b))


def positive_mod(a, b) -> Column:
    return F.pmod(as_column(a), F.nullif(as_column(b), F.lit(0)))


def power(a, b) -> Column:
    return F.pow(as_column(a), as_column(b))


def row_sum(*cols) -> Column:
    return reduce(operator.add, map(as_column, cols))


def _unless_null(cols: list[Column], value: Column) -> Column:
    complete = reduce(operator.and_, [c.isNotNull() for c in cols])
    return F.when(complete, value)


def row_min(*cols) -> Column:
    """Smallest of the arguments, null if any is null (``least`` alone skips nulls)."""
    cols = [as_column(c) for c in cols]
    return cols[0] if len(cols) == 1 else _unless_null(cols, F.least(*cols))


def row_max(*cols) -> Column:
    """Largest of the arguments, null if any is null."""
    cols = [as_column(c) for c in cols]
    return cols[0] if len(cols) == 1 else _unless_null(cols, F.greatest(*cols))


def ceiling(x) -> Column:
    return F.ceil(as_column(x))


def floor(x) -> Column:
    return F.floor(as_column(x))


def absolute(x) -> Column:
    return F.abs(as_column(x))


def log10(x) -> Column:
    """Base-10 logarithm, null for zero and below."""
    return F.log10(as_column(x))


def ln(x) -> Column:
    """Natural logarithm, null for zero and below."""
    return F.ln(as_column(x))


def round_half_up(x) -> Column:
    return F.round(as_column(x), 0)


def square_root(x) -> Column:
    """Square root, NaN below zero."""
    return F.sqrt(as_column(x))
