"""Data profiling, cleaning and tree modelling as plain Spark DataFrame jobs."""

from .specs import ColumnSpec

__all__ = ["ColumnSpec"]
