"""Column functions for calculated columns; they compose like any other Spark Column."""

from .column_stats import is_outlier, normalize, replace_outlier
from .logic import all_of, any_of, case_when, contains, if_null, if_then_else, is_null, negate, one_of
from .numeric import (
    absolute, ceiling, divide, floor, ln, log10, positive_mod, power, remainder, round_half_up, row_max,
    row_min, row_sum, square_root,
)
from .text import concat, find, left, length, lower, replace, right, substring, trim, upper

__all__ = [
    "absolute", "all_of", "any_of", "case_when", "ceiling", "concat", "contains", "divide", "find", "floor",
    "if_null", "if_then_else", "is_null", "is_outlier", "left", "length", "ln", "log10", "lower", "negate",
    "normalize", "one_of", "positive_mod", "power", "remainder", "replace", "replace_outlier", "right",
    "round_half_up", "row_max", "row_min", "row_sum", "square_root", "substring", "trim", "upper",
]
