"""Boolean and conditional functions with three-valued logic."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_column


def _truth(x) -> Column:
    return as_column(x).cast("boolean")


def all_of(*conditions) -> Column:
    return reduce(operator.and_, map(_truth, conditions))


def any_of(*conditions) -> Column:
    return reduce(operator.or_, map(_truth, conditions))


def negate(condition) -> Column:
    return ~_truth(condition)


def contains(s, part) -> Column:
    """True where ``part`` occurs literally in ``s``; it is no SQL pattern."""
    part = part if isinstance(part, Column) else F.lit(part)
    return F.contains(as_column(s).cast("string"), part.cast("string"))


def one_of(x, values) -> Column:
    return as_column(x).isin(*values)


def is_null(x) -> Column:
    return F.isnull(as_column(x))


def if_null(x, replacement) -> Column:
    replacement = replacement if isinstance(replacement, Column) else F.lit(replacement)
    return F.coalesce(as_column(x), replacement)


def if_then_else(condition: Column, then, otherwise) -> Column:
    """Null where the condition is null, not the else value."""
    return F.when(condition, then).when(~condition, otherwise)


def case_when(x, branches: list[tuple]) -> Column:
    """Value of the last branch whose key equals ``x``; null when none does."""
    x, result = as_column(x), None
    for key, value in reversed(branches):
        result = F.when(x == key, value) if result is None else result.when(x == key, value)
    return F.lit(None) if result is None else result
